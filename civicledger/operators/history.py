"""Versioned project states: tolerant diffs, snapshots, change logs, merges and event feeds."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from civicledger import fixed_values as fv
from civicledger.functions import columns as X
from civicledger.operators.chains import follow, kept_rows  # noqa: F401
from civicledger.operators.ranks import chunked_previous
from civicledger.operators.views import latest_per_key
from civicledger.sources.sinks import upsert

fmt = F.format_string


@dataclass(frozen=True)
class Tolerances:
    monetary: float = 1.00
    percentage: float = 0.10
    risk_score: float = 0.10
    days_delayed: int = 1


MONEY = {"sanctioned_amount": "Sanctioned Amount", "released_amount": "Released Amount", "expenditure_amount": "Expenditure Amount",
         "recommended_amount": "Recommended Amount", "unspent_balance": "Unspent Balance", "cost_overrun_amount": "Cost Overrun Amount", "cost_deviation": "Cost Deviation"}
PERCENT = {"physical_progress_pct": "Physical Progress", "financial_progress_pct": "Financial Progress", "utilization_rate_pct": "Fund Utilization", "progress_gap": "Progress Gap"}
DATES = {"expected_completion_date": "Expected Completion Date", "actual_completion_date": "Actual Completion Date"}


def latest_snapshot(df: DataFrame) -> DataFrame:
    return latest_per_key(df, "project_id", [F.col("snapshot_datetime").desc(), F.col("snapshot_id").desc()])


NAMES = {**MONEY, **PERCENT, **DATES, "project_status": "Project Status", "days_delayed": "Days Delayed", "milestone_status": "Milestone Status",
         "overall_risk_score": "Overall Risk Score", "risk_level": "Risk Tier"}
CATEGORIES = {**dict.fromkeys(MONEY, "financial"), "cost_deviation": "derived", **dict.fromkeys(PERCENT, "progress"), "utilization_rate_pct": "financial", "progress_gap": "derived",
              **dict.fromkeys([*DATES, "days_delayed", "milestone_status"], "timeline"), "project_status": "status", "overall_risk_score": "risk", "risk_level": "risk"}


def _change(name: str, prev: Column, new: Column, delta: Column, text: Column, delta_pct: Column | None = None) -> Column:
    pct = F.lit(None) if delta_pct is None else delta_pct
    return F.struct(F.lit(name).alias("field_name"), F.lit(NAMES[name]).alias("display_name"), F.lit(CATEGORIES[name]).alias("category"),
                    prev.cast("string").alias("previous_value"), new.cast("string").alias("new_value"),
                    delta.cast("double").alias("delta"), pct.cast("double").alias("delta_pct"), text.alias("summary"))


def field_changes(prev: str, cur: str, fields: set[str], tol: Tolerances = Tolerances()) -> Column:
    """Array of changes between two struct columns; ``fields`` are the columns both structs have.
    NULL to a value counts as initialised, a NULL incoming value as not given (dates can be cleared)."""
    p, c = (lambda f: F.col(f"{prev}.{f}")), (lambda f: F.col(f"{cur}.{f}"))
    out = []
    sign = lambda d: F.when(d > 0, "+").otherwise("")
    none = F.lit(None).cast("double")

    def text_field(f, label, same=lambda a, b: a == b):
        a, b = F.trim(p(f)), F.trim(c(f))
        changed = b.isNotNull() & (b != "") & ~F.coalesce(same(a, b), F.lit(False))
        out.append(F.when(changed, _change(f, a, b, none, fmt(label, F.coalesce(a, F.lit("None")), b))))

    if "project_status" in fields:
        text_field("project_status", "Project status changed from '%s' to '%s'.")
    for f, name in MONEY.items():
        if f in fields:
            a, b = p(f).cast("double"), c(f).cast("double")
            d = F.round(b - a, 4)
            pct = F.when(a != 0, d / a * 100)
            pct_text = F.when(pct.isNotNull(), F.concat(F.lit(" ("), sign(d), F.when(pct < 0, "-").otherwise(""), fmt("%.1f%%", X.half_up(F.abs(pct), 1)), F.lit(")"))).otherwise("")
            out.append(F.when(b.isNotNull() & a.isNull(), _change(f, p(f), c(f), b, fmt(name + " initialized to ₹%,.2f.", b))).when(
                F.abs(d) >= tol.monetary, _change(f, p(f), c(f), d, F.concat(fmt(name + " shifted from ₹%,.2f to ₹%,.2f (", a, b), sign(d), fmt("₹%,.2f", d), pct_text, F.lit(").")), X.half_up(pct, 2))))
    for f, name in PERCENT.items():
        if f in fields:
            a, b = p(f).cast("double"), c(f).cast("double")
            d = F.round(b - a, 4)
            out.append(F.when(b.isNotNull() & a.isNull(), _change(f, p(f), c(f), b, fmt(name + " initialized to %.1f%%.", b))).when(
                F.abs(d) >= tol.percentage, _change(f, p(f), c(f), d, F.concat(fmt(name + " changed from %.1f%% to %.1f%% (", a, b), sign(d), fmt("%.1f%%", d), F.lit(").")), d)))
    for f, name in DATES.items():
        if f in fields:
            a, b = p(f), c(f)
            d = F.datediff(b, a)
            out.append(F.when(a.isNull() & b.isNotNull(), _change(f, a, b, none, fmt(name + " set to %s.", b.cast("string")))).when(
                a.isNotNull() & b.isNull(), _change(f, a, b, none, fmt(name + " cleared from %s.", a.cast("string")))).when(
                a != b, _change(f, a, b, d, F.concat(fmt(name + " moved from %s to %s (", a.cast("string"), b.cast("string")), sign(d), fmt("%d days).", d)))))
    if "days_delayed" in fields:
        a, b = F.coalesce(p("days_delayed"), F.lit(0)), c("days_delayed")
        d = b - a
        out.append(F.when(F.abs(d) >= tol.days_delayed, _change("days_delayed", a, b, d, F.concat(fmt("Overdue delay changed from %dd to %dd (", a, b), sign(d), fmt("%dd).", d)))))
    if "milestone_status" in fields:
        text_field("milestone_status", "Milestone status updated from '%s' to '%s'.")
    if "overall_risk_score" in fields:
        a, b = F.coalesce(p("overall_risk_score").cast("double"), F.lit(0.0)), c("overall_risk_score").cast("double")
        d = F.round(b - a, 4)
        out.append(F.when(F.abs(d) >= tol.risk_score, _change("overall_risk_score", a, b, d, F.concat(fmt("Overall risk score adjusted from %.1f to %.1f (", a, b), sign(d), fmt("%.1f).", d)))))
    if "risk_level" in fields:
        norm = lambda t: F.when(F.initcap(t) == "Moderate", "Medium").otherwise(F.initcap(t))
        text_field("risk_level", "Risk classification moved from '%s' to '%s'.", lambda a, b: norm(a) == norm(b))
    return F.array_compact(F.array(*out))


def change_summary(changes: Column, initial: Column) -> Column:
    return F.when(initial, fv.INITIAL_SNAPSHOT).when(F.size(changes) == 0, fv.NO_CHANGE).otherwise(F.concat_ws("; ", F.transform(changes, lambda x: x["summary"])))


def with_changes(df: DataFrame, prev: str, cur: str, fields: set[str], tol: Tolerances = Tolerances()) -> DataFrame:
    """Adds changes, changes_count and change_summary; a row without a previous state is the baseline."""
    initial = F.col(prev).isNull()
    d = df.withColumn("changes", F.when(~initial, field_changes(prev, cur, fields, tol)))
    return d.withColumns({"is_initial": initial, "changes_count": F.when(initial, 1).otherwise(F.size("changes")), "change_summary": change_summary(F.col("changes"), initial)})


# ---- proposals and snapshots ----------------------------------------------------------------------

def propose_state(current: DataFrame, updates: DataFrame, key: str = "project_id") -> DataFrame:
    """Payload over current values with unspent balance, utilization and overrun recomputed."""
    cols = [c for c in current.columns if c != key]
    u = updates.select(key, *[F.col(c).alias("u_" + c) for c in updates.columns if c != key and c in cols])
    pick = lambda c: F.coalesce(F.col("u_" + c), F.col(c)) if "u_" + c in u.columns else F.col(c)
    d = u.join(current, key).select(key, *[pick(c).alias(c) for c in cols])
    r, e, s = (F.col(f"{c}_amount").cast("double") for c in ("released", "expenditure", "sanctioned"))
    return d.withColumns({"unspent_balance": F.when(r.isNotNull() & e.isNotNull(), F.round(F.greatest(F.lit(0.0), r - e), 2)),
                          "utilization_rate_pct": F.when(r > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(e / r * 100.0, 2)))),
                          "cost_overrun_amount": F.when(s.isNotNull() & e.isNotNull(), F.round(F.greatest(F.lit(0.0), e - s), 2))})


def append_snapshots(latest: DataFrame, proposed: DataFrame, fields: set[str], force: bool = False, tol: Tolerances = Tolerances()) -> DataFrame:
    """New snapshot rows: only meaningful (or forced) changes; missing values carry forward."""
    cols = sorted(fields)
    have = [c for c in cols if c in proposed.columns]
    p = latest.select("project_id", F.struct(*cols).alias("prev"))
    n = proposed.select("project_id", F.struct(*have).alias("given")).join(p, "project_id", "left")
    keep = lambda c: F.coalesce(F.col(f"given.{c}"), F.col(f"prev.{c}")) if c in have else F.col(f"prev.{c}")
    n = n.withColumn("cur", F.struct(*[keep(c).alias(c) for c in cols]))
    d = with_changes(n, "prev", "cur", fields, tol)
    return d.filter(F.lit(force) | F.col("is_initial") | (F.col("changes_count") > 0)).select("project_id", "cur.*", "is_initial", "changes_count", "change_summary")


def snapshot_chain(updates: DataFrame, fields: dict[str, float], key: str = "project_id", order: tuple[str, str] = ("event_ts", "update_id")) -> DataFrame:
    """Accepted versions of a full-state update feed: an update is kept when some field is at least its
    tolerance away from the last *kept* version, so slow drift adds up and a plain lag would be wrong.
    Histories are followed in blocks (``chains``), so a long one is spread over tasks however slowly it moves."""
    return follow(updates, key, list(order), fields)


def change_log(snapshots: DataFrame, fields: set[str], tol: Tolerances = Tolerances(), chunk: Column | None = None) -> DataFrame:
    """Changes between consecutive stored snapshots, the first one as baseline, with the snapshot compared
    against and the names of the changed fields."""
    chunk = F.date_trunc("hour", "snapshot_datetime") if chunk is None else chunk
    cols = sorted(fields)
    d = chunked_previous(snapshots, "project_id", ["snapshot_datetime", "snapshot_id"], chunk, [*cols, "snapshot_id"]).withColumn("cur", F.struct(*cols))
    names = F.when(F.col("is_initial"), F.array(F.lit("initial_baseline"))).otherwise(F.transform("changes", lambda x: x["field_name"]))
    return with_changes(d, "previous", "cur", fields, tol).select(
        "project_id", "snapshot_id", "snapshot_datetime", "is_initial", "changes_count", "change_summary", "changes",
        F.col("previous.snapshot_id").alias("previous_snapshot_id"), names.alias("modified_fields"))


def history_series(df: DataFrame, order_col: str = "snapshot_datetime", newest_first: bool = False, k: int | None = None) -> DataFrame:
    """All versions per project, numbered from the oldest. With ``k`` only the first k; that limit is
    applied before the shuffle."""
    o = F.col(order_col)
    tie = F.col("snapshot_id")
    w = Window.partitionBy("project_id").orderBy(*([o.desc(), tie.desc()] if newest_first else [o, tie]))
    numbered = df.withColumn("version_no", F.row_number().over(w))
    return numbered if k is None else numbered.filter(F.col("version_no") <= k)


def timeline(history: DataFrame) -> DataFrame:
    return history.orderBy("project_id", F.col("event_timestamp").desc(), F.col("history_id").desc())


def risk_history(snapshots: DataFrame, scores: DataFrame) -> DataFrame:
    """At most one risk row per snapshot."""
    s = scores.select("project_id", F.col("overall_risk_score").alias("evaluated_score"), F.col("risk_level").alias("evaluated_level"))
    return (snapshots.select("snapshot_id", "project_id", F.col("snapshot_datetime").alias("calculated_at")).join(s, "project_id")
            .withColumn("evaluated_level", X.history_tier("evaluated_level")).dropDuplicates(["snapshot_id"]))


def status_events(snapshots: DataFrame, performed_by: str = "System Admin", chunk: Column | None = None) -> DataFrame:
    """'Status Changed' events where consecutive snapshots differ in status."""
    chunk = F.date_trunc("hour", "snapshot_datetime") if chunk is None else chunk
    d = chunked_previous(snapshots, "project_id", ["snapshot_datetime", "snapshot_id"], chunk, ["project_status"])
    old, new = F.col("previous.project_status"), F.col("project_status")
    return d.filter(old.isNotNull() & (old != new)).select(
        "project_id", F.lit("Status Changed").alias("event_type"), old.alias("previous_status"), new.alias("new_status"), F.col("snapshot_datetime").alias("event_timestamp"),
        F.lit(performed_by).alias("performed_by"), fmt("Status transitioned from '%s' to '%s' by %s.", old, new, F.lit(performed_by)).alias("event_description"))


# ---- merges --------------------------------------------------------------------------------------------

def stage_of(pct) -> Column:
    p = X.lit_if(pct)
    return (F.when(p.isNull(), "Structure").when(p >= 100, "Completed").when(p >= 80, "Finishing").when(p >= 30, "Structure").when(p > 0, "Foundation").otherwise("Feasibility"))


def milestone_of(c) -> Column:
    s = F.trim(X.lit_if(c))
    low = F.lower(s)
    return (F.when(s.isin(fv.MILESTONES), s).when(F.contains(low, F.lit("critical")), "Critical").when(F.contains(low, F.lit("delay")), "Delayed")
            .when(F.contains(low, F.lit("complete")), "Completed").otherwise("On Track"))


def merge_progress(progress: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert a day's report or update that day's report; stage follows from the physical percentage."""
    u = latest_per_key(updates, ["project_id", "reported_date"], [F.col("event_ts").desc(), F.col("update_id").desc()])
    u = u.select("project_id", "reported_date", "physical_progress_pct", stage_of("physical_progress_pct").alias("current_stage"), milestone_of("milestone_status").alias("milestone_status"))
    return upsert(progress.select(*u.columns), u, ["project_id", "reported_date"])


def apply_transactions(fin: DataFrame, projects: DataFrame, tx: DataFrame) -> DataFrame:
    """Fund releases add up; expenditure and sanction are replaced by their newest transaction, and a
    sanction also sets status and agency. tx: project_id, kind, amount, event_ts, agency."""
    kind = F.col("kind")
    when = lambda k, c: F.max_by(c, F.when(kind == k, F.struct("event_ts", "tx_id")))
    g = tx.groupBy("project_id").agg(F.sum(F.when(kind == "release", F.col("amount"))).alias("more"), F.max(F.when(kind == "release", F.to_date("event_ts"))).alias("paid_on"),
                                     when("expenditure", "amount").alias("spent"), when("sanction", "amount").alias("granted"), when("sanction", "agency").alias("new_agency"),
                                     F.max(F.when(kind == "sanction", F.to_date("event_ts"))).alias("granted_on"))
    d = projects.join(fin, "project_id").join(g, "project_id", "left")
    dec = lambda c: c.cast("decimal(14,2)")
    return d.select("project_id", F.when(F.col("granted").isNotNull(), "Sanctioned").otherwise(F.col("current_status")).alias("current_status"),
                    F.coalesce("granted_on", "sanction_date").alias("sanction_date"), F.coalesce("new_agency", "implementing_agency").alias("implementing_agency"),
                    dec(F.coalesce("granted", "sanctioned_amount")).alias("sanctioned_amount"), dec(F.col("released_amount") + F.coalesce("more", F.lit(0))).alias("released_amount"),
                    dec(F.coalesce("spent", "expenditure_amount")).alias("expenditure_amount"), F.coalesce("paid_on", "last_disbursement_date").alias("last_disbursement_date"))


def ingest_new_projects(t, new: DataFrame, performed_by: str = "System Admin") -> dict[str, DataFrame]:
    """Accepted projects with their first finance row and event, and rejects with the reason."""
    old = t["projects"].select(F.col("project_id").alias("o_id")), t["projects"].select(F.col("project_code").alias("o_code"))
    states = t["states"].select(F.col("state_id").alias("s_id"))
    seats = t["constituencies"].select(F.col("constituency_id").alias("c_id"))
    w = lambda c: Window.partitionBy(c).orderBy("project_id", "project_code")
    d = (new.join(states, F.col("state_id") == F.col("s_id"), "left").join(seats, F.col("constituency_id") == F.col("c_id"), "left")
         .join(old[0], F.col("project_id") == F.col("o_id"), "left").join(old[1], F.col("project_code") == F.col("o_code"), "left")
         .withColumn("__i", F.row_number().over(w("project_id"))).withColumn("__c", F.row_number().over(w("project_code"))))
    why = (F.when(F.col("s_id").isNull(), "Invalid state_id").when(F.col("c_id").isNull(), "Invalid constituency_id").when(F.col("o_code").isNotNull() | (F.col("__c") > 1), "Project code already exists")
           .when(F.col("o_id").isNotNull() | (F.col("__i") > 1), "Project ID already exists"))
    d = d.withColumn("reject_reason", why).drop("s_id", "c_id", "o_id", "o_code", "__i", "__c")
    ok = d.filter("reject_reason is null").drop("reject_reason")
    st, zero = F.col("current_status"), F.lit(0).cast("decimal(14,2)")
    fin = ok.select("project_id", F.lit("INR").alias("currency"), "recommended_amount", F.when(st != "Recommended", F.col("recommended_amount")).alias("sanctioned_amount"),
                    zero.alias("released_amount"), zero.alias("expenditure_amount"), zero.alias("cost_overrun_amount"))
    ev = ok.select("project_id", F.lit("Created").alias("event_type"), F.lit(None).cast("string").alias("previous_status"), st.alias("new_status"), F.lit(performed_by).alias("performed_by"),
                   fmt("Project created with status '%s' by %s.", st, F.lit(performed_by)).alias("event_description"))
    return {"projects": ok, "financials": fin, "history": ev, "rejects": d.filter("reject_reason is not null")}


def citizen_reports(reports: DataFrame, k: int | None = None) -> DataFrame:
    """Reports with ticket and triage status; with k the newest ones."""
    d = reports.withColumns({"report_id": F.concat(F.lit("CIT-REP-"), F.col("report_no") + 1001), "triage_status": F.lit(fv.TRIAGE_STATUS)})
    return d.orderBy(F.col("reported_at").desc(), F.col("report_no").desc()).limit(k) if k else d
