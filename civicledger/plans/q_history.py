"""Versioning, merge and streaming queries."""
from pyspark.sql import functions as F

from civicledger.operators import history as K
from civicledger.plans.oracle_tables import CTES, sql
from civicledger.plans.registry import query
from civicledger.streaming import jobs as L

SNAP = {"project_status", "sanctioned_amount", "released_amount", "expenditure_amount", "physical_progress_pct", "financial_progress_pct", "expected_completion_date",
        "actual_completion_date", "days_delayed", "milestone_status", "overall_risk_score", "risk_level"}
FOLD = {"physical_progress_pct": 20.0, "expenditure_amount": 20000.0, "days_delayed": 40.0}

CTES["pairs"] = (("snapshots",), """
  SELECT *, lag(snapshot_id) OVER w IS NULL AS first, lag(project_status) OVER w AS p_status, lag(released_amount) OVER w AS p_rel, lag(expenditure_amount) OVER w AS p_exp, lag(physical_progress_pct) OVER w AS p_phy,
    lag(financial_progress_pct) OVER w AS p_fin, lag(expected_completion_date) OVER w AS p_ed, lag(actual_completion_date) OVER w AS p_ad, lag(days_delayed) OVER w AS p_dd, lag(milestone_status) OVER w AS p_ms,
    lag(overall_risk_score) OVER w AS p_rs, lag(risk_level) OVER w AS p_rl FROM snapshots WINDOW w AS (PARTITION BY project_id ORDER BY snapshot_datetime, snapshot_id)""")
CTES["changed"] = (("pairs",), """
  SELECT *, list_filter([CASE WHEN project_status <> p_status THEN 'project_status' END, CASE WHEN abs(released_amount - p_rel) >= 1 THEN 'released_amount' END, CASE WHEN abs(expenditure_amount - p_exp) >= 1 THEN 'expenditure_amount' END,
    CASE WHEN abs(physical_progress_pct - p_phy) >= 0.1 THEN 'physical_progress_pct' END, CASE WHEN financial_progress_pct IS NOT NULL AND (p_fin IS NULL OR abs(financial_progress_pct - p_fin) >= 0.1) THEN 'financial_progress_pct' END,
    CASE WHEN expected_completion_date IS DISTINCT FROM p_ed THEN 'expected_completion_date' END, CASE WHEN actual_completion_date IS DISTINCT FROM p_ad THEN 'actual_completion_date' END, CASE WHEN abs(days_delayed - p_dd) >= 1 THEN 'days_delayed' END,
    CASE WHEN milestone_status <> p_ms THEN 'milestone_status' END, CASE WHEN abs(overall_risk_score - p_rs) >= 0.1 THEN 'overall_risk_score' END,
    CASE WHEN replace(risk_level, 'Moderate', 'Medium') <> replace(p_rl, 'Moderate', 'Medium') THEN 'risk_level' END], lambda x: x IS NOT NULL) AS ch FROM pairs""")


@query("k1_latest_snapshots", sql("SELECT project_id, snapshot_id, project_status FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY snapshot_datetime DESC, snapshot_id DESC) AS r FROM snapshots) WHERE r = 1", "snapshots"))
def _(t):
    return K.latest_snapshot(t["snapshots"]).select("project_id", "snapshot_id", "project_status")


@query("k2_field_changes", sql("SELECT snapshot_id, array_to_string(ch, '|') AS changed_fields FROM changed WHERE NOT first", "changed"))
def _(t):
    d = K.change_log(t["snapshots"], SNAP).filter(~F.col("is_initial"))
    return d.select("snapshot_id", F.transform("changes", lambda x: x["field_name"]).alias("changed_fields"))


# one decimal of the shortest form of a double, halves away from zero; a small negative number keeps its sign
_one = lambda x: f"(CASE WHEN ({x}) < 0 AND round(({x})::DOUBLE::VARCHAR::DECIMAL(38, 15), 1) = 0 THEN '-' ELSE '' END || format('{{:.1f}}', round(({x})::DOUBLE::VARCHAR::DECIMAL(38, 15), 1)::DOUBLE))"
_money = lambda x: f"format('{{:,.2f}}', ({x})::DOUBLE)"
_sign = lambda d: f"CASE WHEN {d} > 0 THEN '+' ELSE '' END"


def _money_text(name: str, a: str, b: str) -> str:
    d = f"({b} - {a})"
    return (f"'{name} shifted from ₹' || {_money(a)} || ' to ₹' || {_money(b)} || ' (' || {_sign(d)} || '₹' || {_money(d)} || "
            f"CASE WHEN {a} <> 0 THEN ' (' || {_sign(d)} || {_one(f'{d}::DOUBLE / {a}::DOUBLE * 100')} || '%)' ELSE '' END || ').'")


def _percent_text(name: str, a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL THEN '{name} initialized to ' || {_one(b)} || '%.' ELSE '{name} changed from ' || {_one(a)} || '% to ' || {_one(b)} || '% (' || "
            f"{_sign(f'({b} - {a})')} || {_one(f'{b} - {a}')} || '%).' END")


def _date_text(name: str, a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL THEN '{name} set to ' || {b} || '.' WHEN {b} IS NULL THEN '{name} cleared from ' || {a} || '.' "
            f"ELSE '{name} moved from ' || {a} || ' to ' || {b} || ' (' || {_sign(f'({b} - {a})')} || ({b} - {a}) || ' days).' END")


STATUS_TEXT = "'Project status changed from ''' || p_status || ''' to ''' || project_status || '''.'"
CHANGE_TEXTS = {
    "project_status": STATUS_TEXT,
    "released_amount": _money_text("Released Amount", "p_rel", "released_amount"),
    "expenditure_amount": _money_text("Expenditure Amount", "p_exp", "expenditure_amount"),
    "physical_progress_pct": _percent_text("Physical Progress", "p_phy", "physical_progress_pct"),
    "financial_progress_pct": _percent_text("Financial Progress", "p_fin", "financial_progress_pct"),
    "expected_completion_date": _date_text("Expected Completion Date", "p_ed", "expected_completion_date"),
    "actual_completion_date": _date_text("Actual Completion Date", "p_ad", "actual_completion_date"),
    "days_delayed": f"'Overdue delay changed from ' || p_dd || 'd to ' || days_delayed || 'd (' || {_sign('(days_delayed - p_dd)')} || (days_delayed - p_dd) || 'd).'",
    "milestone_status": "'Milestone status updated from ''' || p_ms || ''' to ''' || milestone_status || '''.'",
    "overall_risk_score": f"'Overall risk score adjusted from ' || {_one('p_rs')} || ' to ' || {_one('overall_risk_score')} || ' (' || "
                          f"{_sign('(overall_risk_score - p_rs)')} || {_one('overall_risk_score - p_rs')} || ').'",
    "risk_level": "'Risk classification moved from ''' || p_rl || ''' to ''' || risk_level || '''.'"}
TEXT_LIST = ", ".join(f"CASE WHEN list_contains(ch, '{f}') THEN {x} END" for f, x in CHANGE_TEXTS.items())


@query("k3_change_summaries", sql(f"""SELECT snapshot_id, CASE WHEN first THEN 1 ELSE len(ch) END AS changes_count,
  CASE WHEN first THEN 'Initial baseline project snapshot recorded upon first ingestion.' WHEN len(ch) = 0 THEN 'No meaningful project changes detected within numeric tolerance thresholds.'
    ELSE array_to_string(list_filter([{TEXT_LIST}], lambda x: x IS NOT NULL), '; ') END AS change_summary,
  CASE WHEN project_status <> p_status THEN {STATUS_TEXT} END AS status_text FROM changed""", "changed"))
def _(t):
    d = K.change_log(t["snapshots"], SNAP)
    status = F.filter("changes", lambda x: x["field_name"] == "project_status")
    return d.select("snapshot_id", "changes_count", "change_summary", F.when(F.size(status) > 0, F.element_at(status, 1)["summary"]).alias("status_text"))


_digits = lambda x, n: f"round(({x})::DOUBLE::VARCHAR::DECIMAL(38, 15), {n})::DOUBLE"
_before = {"project_status": "p_status", "released_amount": "p_rel", "expenditure_amount": "p_exp", "physical_progress_pct": "p_phy", "financial_progress_pct": "p_fin",
           "expected_completion_date": "p_ed", "actual_completion_date": "p_ad", "days_delayed": "p_dd", "milestone_status": "p_ms", "overall_risk_score": "p_rs", "risk_level": "p_rl"}


def _delta(f: str) -> str:
    a = _before[f]
    if f in K.MONEY or f in K.PERCENT:
        return f"CASE WHEN {a} IS NULL THEN {f}::DOUBLE ELSE {_digits(f'{f}::DOUBLE - {a}::DOUBLE', 4)} END"
    if f == "overall_risk_score":
        return _digits(f"{f} - coalesce({a}, 0)", 4)
    return f"({f} - {a})::DOUBLE" if f in K.DATES or f == "days_delayed" else "NULL::DOUBLE"


def _delta_pct(f: str) -> str:
    a = _before[f]
    if f in K.MONEY:
        return f"CASE WHEN {a} <> 0 THEN {_digits(f'{_delta(f)} / {a}::DOUBLE * 100', 2)} END"
    return f"CASE WHEN {a} IS NOT NULL THEN {_delta(f)} END" if f in K.PERCENT else "NULL::DOUBLE"


_per_field = lambda value: "CASE f " + " ".join(f"WHEN '{f}' THEN {value(f)}" for f in CHANGE_TEXTS) + " END"


@query("k2_change_records", sql(f"""SELECT snapshot_id, f AS field_name, {_per_field(lambda f: f"'{K.NAMES[f]}'")} AS display_name, {_per_field(lambda f: f"'{K.CATEGORIES[f]}'")} AS category,
  {_per_field(_delta)} AS delta, {_per_field(_delta_pct)} AS delta_pct, {_per_field(lambda f: CHANGE_TEXTS[f])} AS summary FROM (SELECT *, unnest(ch) AS f FROM changed WHERE NOT first)""", "changed"))
def _(t):
    d = K.change_log(t["snapshots"], SNAP).select("snapshot_id", F.explode("changes").alias("c"))
    return d.select("snapshot_id", *[f"c.{c}" for c in ("field_name", "display_name", "category", "delta", "delta_pct", "summary")])


def payload(t):
    """Every third project gets new money figures."""
    k = F.col("project_id")
    return t["projects"].filter(k % 3 == 0).select(k, F.when(k % 2 == 0, (F.col("price") * 2).cast("decimal(14,2)")).alias("expenditure_amount"), F.when(k % 5 == 0, F.lit("1000.00").cast("decimal(14,2)")).alias("released_amount"))


CTES["proposed"] = (("projects", "financials"), """
  SELECT project_id, sanctioned_amount::DOUBLE AS s, coalesce(CASE WHEN project_id % 5 = 0 THEN 1000.0 END, released_amount)::DOUBLE AS r, coalesce(CASE WHEN project_id % 2 = 0 THEN price * 2 END, expenditure_amount)::DOUBLE AS e,
    released_amount::DOUBLE AS r0, expenditure_amount::DOUBLE AS e0 FROM projects JOIN financials USING (project_id) WHERE project_id % 3 = 0""")
MONEY = ["sanctioned_amount", "released_amount", "expenditure_amount"]


@query("k4_proposed_states", sql("SELECT project_id, r AS released_amount, e AS expenditure_amount, round(greatest(0, r - e), 2)::DOUBLE AS unspent_balance, CASE WHEN r > 0 THEN least(100, round(e / r * 100, 2)) END::DOUBLE AS utilization_rate_pct, CASE WHEN s IS NOT NULL THEN round(greatest(0, e - s), 2) END::DOUBLE AS cost_overrun_amount FROM proposed", "proposed"))
def _(t):
    cur = t["financials"].select("project_id", *MONEY)
    return K.propose_state(cur, payload(t)).drop("sanctioned_amount")


@query("k5_appended_snapshots", sql("SELECT project_id, r AS released_amount, e AS expenditure_amount, (abs(r - r0) >= 1)::INT + (abs(e - e0) >= 1)::INT AS changes_count FROM proposed WHERE abs(r - r0) >= 1 OR abs(e - e0) >= 1", "proposed"))
def _(t):
    cur = t["financials"].select("project_id", *MONEY)
    prop = K.propose_state(cur, payload(t))
    return K.append_snapshots(cur, prop, set(MONEY)).select("project_id", "released_amount", "expenditure_amount", "changes_count")


CTES["rd"] = (("readings",), "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY event_ts, update_id) AS rn FROM readings")
FOLD_BODY = """WITH chain AS (SELECT project_id, rn, update_id, physical_progress_pct AS a, expenditure_amount AS b, days_delayed AS c, true AS kept FROM rd WHERE rn = 1
  UNION ALL SELECT r.project_id, r.rn, r.update_id, CASE WHEN k THEN r.physical_progress_pct ELSE a END, CASE WHEN k THEN r.expenditure_amount ELSE b END, CASE WHEN k THEN r.days_delayed ELSE c END, k
    FROM (SELECT chain.a, chain.b, chain.c, r.*, (abs(r.physical_progress_pct - a) >= 20 OR abs(r.expenditure_amount - b) >= 20000 OR abs(r.days_delayed - c) >= 40) AS k FROM chain JOIN rd r ON r.project_id = chain.project_id AND r.rn = chain.rn + 1) r)
  SELECT project_id, update_id, a AS physical_progress_pct, b AS expenditure_amount, c AS days_delayed FROM chain WHERE kept"""
FOLD_SQL = sql(FOLD_BODY, "rd", recursive=True)
FOLD_COLS = ["project_id", "update_id", *FOLD]


@query("k6_snapshot_chain", FOLD_SQL)
def _(t):
    return K.snapshot_chain(t["readings"], FOLD).select(*FOLD_COLS)


@query("k7_change_log", sql("SELECT project_id, count(*) AS versions, count(*) FILTER (first) AS baselines, sum(CASE WHEN first THEN 1 ELSE len(ch) END)::BIGINT AS changes FROM changed GROUP BY 1", "changed"))
def _(t):
    return K.change_log(t["snapshots"], SNAP).groupBy("project_id").agg(F.count(F.lit(1)).alias("versions"), F.count_if("is_initial").alias("baselines"), F.sum("changes_count").alias("changes"))


@query("k7_change_records", sql("""SELECT project_id, snapshot_id, lag(snapshot_id) OVER (PARTITION BY project_id ORDER BY snapshot_datetime, snapshot_id) AS previous_snapshot_id,
  CASE WHEN first THEN 'initial_baseline' ELSE array_to_string(ch, '|') END AS modified_fields, CASE WHEN first THEN 1 ELSE len(ch) END AS changes_count FROM changed""", "changed"))
def _(t):
    d = K.change_log(t["snapshots"], SNAP)
    return d.select("project_id", "snapshot_id", "previous_snapshot_id", F.array_join("modified_fields", "|").alias("modified_fields"), "changes_count")


@query("k8_history_series", sql("SELECT project_id, snapshot_id, version_no FROM (SELECT project_id, snapshot_id, row_number() OVER (PARTITION BY project_id ORDER BY snapshot_datetime DESC, snapshot_id DESC) AS version_no FROM snapshots) WHERE version_no <= 5", "snapshots"))
def _(t):
    return K.history_series(t["snapshots"], newest_first=True, k=5).select("project_id", "snapshot_id", "version_no")


@query("k8_full_history", sql("SELECT project_id, snapshot_id, row_number() OVER (PARTITION BY project_id ORDER BY snapshot_datetime, snapshot_id) AS version_no FROM snapshots", "snapshots"))
def _(t):
    return K.history_series(t["snapshots"]).select("project_id", "snapshot_id", "version_no")


@query("k9_timeline", sql("SELECT project_id, history_id, event_type, new_status, performed_by FROM history", "history"))
def _(t):
    return K.timeline(t["project_history"]).select("project_id", "history_id", "event_type", "new_status", "performed_by")


@query("k10_risk_history", sql("SELECT snapshot_id, s.project_id, r.overall_risk_score AS evaluated_score, r.risk_level AS evaluated_level FROM snapshots s JOIN risk_scores r ON r.project_id = s.project_id", "snapshots", "risk_scores"))
def _(t):
    twice = t["snapshots"].unionByName(t["snapshots"])
    return K.risk_history(twice, t["risk_scores"]).drop("calculated_at")


@query("k11_status_events", sql("SELECT project_id, p_status AS previous_status, project_status AS new_status, count(*) AS events FROM pairs WHERE project_status <> p_status GROUP BY 1, 2, 3", "pairs"))
def _(t):
    return K.status_events(t["snapshots"]).groupBy("project_id", "previous_status", "new_status").agg(F.count(F.lit(1)).alias("events"))


def reports(t):
    return t["events"].select(F.col("user_id").alias("project_id"), F.to_date("ts").alias("reported_date"), F.least(F.col("value"), F.lit(100.0)).alias("physical_progress_pct"),
                              F.when(F.col("event_type") == "error", "is delayed").when(F.col("event_type") == "signup", "CRITICAL!").otherwise(F.col("event_type")).alias("milestone_status"),
                              F.col("ts").alias("event_ts"), F.col("event_id").alias("update_id"))


CTES["upd"] = ((), """SELECT user_id AS project_id, CAST(ts AS DATE) AS reported_date, arg_max(least(value, 100.0)::DOUBLE, (ts, event_id)) AS pct, arg_max(event_type, (ts, event_id)) AS et FROM events GROUP BY 1, 2""")
MERGED = """SELECT project_id, strftime(reported_date, '%Y-%m-%d') AS reported_date, pct AS physical_progress_pct, CASE WHEN pct >= 100 THEN 'Completed' WHEN pct >= 80 THEN 'Finishing' WHEN pct >= 30 THEN 'Structure' WHEN pct > 0 THEN 'Foundation' ELSE 'Feasibility' END AS current_stage,
  CASE et WHEN 'error' THEN 'Delayed' WHEN 'signup' THEN 'Critical' ELSE 'On Track' END AS milestone_status FROM upd"""
PROGRESS_COLS = ["project_id", "reported_date", "physical_progress_pct", "current_stage", "milestone_status"]


@query("k12_merge_progress", sql(f"""{MERGED} UNION ALL SELECT project_id, strftime(reported_date, '%Y-%m-%d'), physical_progress_pct, current_stage, milestone_status FROM latest_progress p WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.project_id = p.project_id AND u.reported_date = p.reported_date)""", "upd", "latest_progress"))
def _(t):
    from civicledger.operators.views import latest_progress
    return K.merge_progress(latest_progress(t["progress"]).select(*PROGRESS_COLS), reports(t))


def transactions(t):
    kind = F.when(F.col("event_type") == "purchase", "release").when(F.col("event_type") == "click", "expenditure").otherwise("sanction")
    return t["events"].filter("event_type in ('purchase', 'click', 'signup')").select(
        F.col("user_id").alias("project_id"), kind.alias("kind"), F.round(F.col("value") * 100, 2).cast("decimal(14,2)").alias("amount"), F.col("ts").alias("event_ts"), F.col("event_id").alias("tx_id"),
        F.concat(F.lit("Agency "), F.col("event_id") % 13).alias("agency"))


CTES["tx"] = ((), "SELECT user_id AS project_id, event_type AS et, CAST(round(value * 100, 2) AS DECIMAL(14,2)) AS amount, ts, event_id, 'Agency ' || (event_id % 13) AS agency FROM events WHERE event_type IN ('purchase','click','signup')")
CTES["txg"] = (("tx",), """SELECT project_id, sum(amount) FILTER (et = 'purchase') AS more, arg_max(amount, (ts, event_id)) FILTER (et = 'click') AS spent, arg_max(amount, (ts, event_id)) FILTER (et = 'signup') AS granted,
  arg_max(agency, (ts, event_id)) FILTER (et = 'signup') AS ag FROM tx GROUP BY 1""")
TX_SQL = """SELECT project_id, CASE WHEN granted IS NOT NULL THEN 'Sanctioned' ELSE current_status END AS current_status, coalesce(ag, implementing_agency) AS implementing_agency, coalesce(granted, sanctioned_amount)::DOUBLE AS sanctioned_amount,
  (released_amount + coalesce(more, 0))::DOUBLE AS released_amount, coalesce(spent, expenditure_amount)::DOUBLE AS expenditure_amount FROM projects JOIN financials USING (project_id) LEFT JOIN txg USING (project_id)"""
TX_COLS = ["project_id", "current_status", "implementing_agency", "sanctioned_amount", "released_amount", "expenditure_amount"]


@query("k13_transactions", sql(TX_SQL, "projects", "financials", "txg"))
def _(t):
    return K.apply_transactions(t["financials"], t["projects"].select("project_id", "current_status", "sanction_date", "implementing_agency"), transactions(t)).select(*TX_COLS)


def new_projects(t):
    """Proposals cut from the customer table: some with bad keys, some known already."""
    c = F.col("c_custkey")
    return t["customer"].select(
        F.when(c % 11 == 0, c).otherwise(c + 10_000_000).alias("project_id"), F.when(c % 13 == 0, F.concat(F.lit("W-"), c)).otherwise(F.concat(F.lit("N-"), c)).alias("project_code"),
        F.when(c % 17 == 0, 999).otherwise(F.col("c_nationkey")).alias("state_id"), F.when(c % 19 == 0, -1).otherwise(F.col("c_nationkey") * 100 + c % 7).alias("constituency_id"),
        F.when(c % 2 == 0, "Recommended").otherwise("Sanctioned").alias("current_status"), F.abs("c_acctbal").cast("decimal(14,2)").alias("recommended_amount"))


NEW = """SELECT c_custkey AS c, CASE WHEN c_custkey % 17 = 0 THEN 'Invalid state_id' WHEN c_custkey % 19 = 0 THEN 'Invalid constituency_id' WHEN c_custkey % 13 = 0 THEN 'Project code already exists' WHEN c_custkey % 11 = 0 THEN 'Project ID already exists' ELSE 'accepted' END AS outcome,
  c_custkey % 2 AS odd, CAST(abs(c_acctbal) AS DECIMAL(14,2)) AS amt FROM customer"""


@query("k14_new_projects", sql(f"SELECT outcome, count(*) AS projects, round(sum(CASE WHEN outcome = 'accepted' AND odd = 1 THEN amt ELSE 0 END), 2)::DOUBLE AS sanctioned FROM ({NEW}) GROUP BY 1"))
def _(t):
    r = K.ingest_new_projects(t, new_projects(t))
    zero = F.lit(0).cast("decimal(14,2)")
    a = r["financials"].select(F.lit("accepted").alias("outcome"), F.coalesce("sanctioned_amount", zero).alias("amt"))
    b = r["rejects"].select(F.col("reject_reason").alias("outcome"), zero.alias("amt"))
    return a.unionByName(b).groupBy("outcome").agg(F.count(F.lit(1)).alias("projects"), F.sum("amt").alias("sanctioned"))


@query("k15_citizen_reports", sql("""SELECT 'CIT-REP-' || (conv_id * 100 + turn + 1001) AS report_id, conv_id AS project_id, 'Under Review by District Nodal Officer' AS triage_status, md5(text) AS digest FROM conversations WHERE role = 'user' ORDER BY conv_id * 100 + turn DESC LIMIT 25"""))
def _(t):
    d = t["conversations"].filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("report_no"), F.col("conv_id").alias("project_id"), F.md5("text").alias("digest"),
                                                          (F.col("conv_id") * 100 + F.col("turn")).alias("reported_at"))
    return K.citizen_reports(d, 25).select("report_id", "project_id", "triage_status", "digest")


# ---- L: streams --------------------------------------------------------------------------------------
def event_stream(t):
    return L.file_stream(t.spark, t.sf_dir, t["events"].schema, "events.parquet")


def _stream_versions(t, name: str, late: bool = False, watermark: str | None = None):
    """Versions of the feed as it arrives: the older half, then the newer half and, with ``late``, every tenth
    row of the older half only after that. Each arrival may be many files; the stream takes it in before the
    next one is there, so one micro-batch holds one arrival."""
    from civicledger.plans.bindings import Tables
    events = t["events"]
    mid = events.agg(F.expr("min(unix_micros(cast(ts as timestamp)))").alias("a"), F.expr("max(unix_micros(cast(ts as timestamp)))").alias("b")).first()
    old = F.expr("unix_micros(cast(ts as timestamp))") <= F.lit((mid["a"] + mid["b"]) // 2)
    behind = old & (F.col("event_id") % 10 == 0) & F.lit(late)
    root, _ = L.fresh(t.spark, "feed")
    out, cp = L.fresh(t.spark, name)
    s = Tables(t.spark, t.sf_dir)
    for part in [old & ~behind, ~old, *([behind] if late else [])]:
        events.filter(part).write.mode("append").parquet(root)
        s["events"] = L.file_stream(t.spark, root, events.schema)
        s.pop("readings", None)
        r = s["readings"].withColumn("event_ts", F.col("event_ts").cast("timestamp")) if watermark else s["readings"]
        L.run_available(L.stream_snapshots(r, FOLD, watermark=watermark), out, cp)
    return t.spark.read.parquet(out).select(*FOLD_COLS)


@query("l1_stream_snapshots", FOLD_SQL)
def _(t):
    return _stream_versions(t, "l1")


@query("l2_stream_upsert", sql("SELECT user_id AS project_id, max(event_id) AS last_event, count(*) AS events FROM events GROUP BY 1"))
def _(t):
    """The feed is merged twice; the second pass must not change anything."""
    out, cp = L.fresh(t.spark, "l2")
    keyed = lambda b: b.groupBy(F.col("user_id").alias("project_id")).agg(F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("events"))
    table = L.BucketTable(t.spark, out, keyed(t["events"]).limit(0), ["project_id"], buckets=8)
    L.stream_upsert(event_stream(t), table, ["project_id"], cp, keyed)
    L.stream_upsert(event_stream(t), table, ["project_id"], cp + "-again", keyed)
    return table.read()


CTES["timely"] = (("readings",), """SELECT * FROM readings WHERE NOT (update_id % 10 = 0 AND epoch_us(event_ts::TIMESTAMP) <= (SELECT (min(epoch_us(event_ts::TIMESTAMP)) + max(epoch_us(event_ts::TIMESTAMP))) // 2 FROM readings))""")
CTES["rdt"] = (("timely",), "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY event_ts, update_id) AS rn FROM timely")


@query("l3_watermarked_snapshots", sql(FOLD_BODY.replace("rd ", "rdt "), "rdt", recursive=True))
def _(t):
    """The last file is hours behind the watermark: none of its rows may become a version or change the state."""
    return _stream_versions(t, "l3", late=True, watermark="1 hour")


@query("l4_stream_progress", sql(MERGED, "upd"))
def _(t):
    out, cp = L.fresh(t.spark, "l4p")
    seed = t["progress"].select(*PROGRESS_COLS).limit(0)
    table = L.BucketTable(t.spark, out, seed, ["project_id", "reported_date"], buckets=8)
    L.stream_progress(reports({"events": event_stream(t)}), table, cp)
    return table.read()


@query("l4_stream_transactions", sql(TX_SQL, "projects", "financials", "txg"))
def _(t):
    out, cp = L.fresh(t.spark, "l4t")
    own = t["projects"].select("project_id", "current_status", "sanction_date", "implementing_agency")
    seed = own.join(t["financials"].select("project_id", "sanctioned_amount", "released_amount", "expenditure_amount", "last_disbursement_date"), "project_id")
    table = L.BucketTable(t.spark, out, seed, ["project_id"], buckets=8)
    L.stream_transactions(transactions({"events": event_stream(t)}), table, cp)
    return table.read().select(*TX_COLS)
