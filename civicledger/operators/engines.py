"""The risk engines as column logic over whole tables: cost, delay, progress mismatch, agency, funds."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from civicledger import fixed_texts as tx, fixed_values as fv
from civicledger.functions import columns as X
from civicledger.operators import robust
from civicledger.operators.ranks import group_quantiles
from civicledger.operators.views import latest_progress
from civicledger.sources.sinks import staged

fmt = F.format_string


def ev(metric: str, label: str, formatted: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), F.lit(label).alias("label"), formatted.alias("formatted"))


def engine_result(df: DataFrame, engine: str, score: Column, reason: Column, confidence: Column, details: list[Column], *,
                  threshold: Column | None = None, actual: Column | None = None, expected: Column | None = None,
                  reference: Column | None = None, evidence: Column | None = None, bounds=None) -> DataFrame:
    """Common result row: integer score 0-100 (half-even), tier, reason, confidence, trigger and texts."""
    none = F.lit(None).cast("string")
    d = df.withColumn("__s", F.least(F.greatest(F.bround(F.coalesce(score.cast("double"), F.lit(0.0)), 0), F.lit(0.0)), F.lit(100.0)).cast("int"))
    s = F.col("__s")
    empty = F.array().cast("array<struct<metric:string,label:string,formatted:string>>")
    return d.select(
        "project_id", F.lit(engine).alias("engine"), s.alias("score"), X.risk_level(s, bounds).alias("risk_level"),
        F.lower(X.risk_level(s, bounds)).alias("severity"), (s >= 30).alias("triggered"), reason.alias("reason"),
        F.round(F.coalesce(confidence.cast("double"), F.lit(0.5)), 3).alias("confidence"), (threshold if threshold is not None else none).alias("threshold"),
        (actual if actual is not None else none).alias("actual_value"), (expected if expected is not None else none).alias("expected_value"),
        (reference if reference is not None else none).alias("reference_value"), (evidence if evidence is not None else empty).alias("evidence"),
        F.to_json(F.struct(*details)).alias("details"))


# ---- cost anomaly ------------------------------------------------------------------------------

def cost_signals(projects: DataFrame, financials: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Evaluated cost (spent, else sanctioned, else released), its source, duration and cost per day."""
    p = projects.select("project_id", "sector", "sub_sector", "state_id", "district_name", "current_status", "recommendation_date",
                        "sanction_date", "work_order_date", "expected_completion_date", "actual_completion_date")
    f = financials.select("project_id", *[F.col(f"{c}_amount").cast("double").alias(f"__{c}") for c in ("expenditure", "sanctioned", "released")],
                          F.coalesce(F.col("cost_overrun_pct").cast("double"), F.lit(0.0)).alias("cost_overrun_pct"))
    df = p.join(f, "project_id", "left")
    e, s, r = (F.greatest(F.coalesce(F.col(f"__{c}"), F.lit(0.0)), F.lit(0.0)) for c in ("expenditure", "sanctioned", "released"))
    days = F.datediff(F.coalesce("actual_completion_date", "expected_completion_date"),
                      F.coalesce("work_order_date", "sanction_date", "recommendation_date"))
    days = F.when(days > 0, days)
    stored = F.lit(None).cast("int")
    if features is not None:
        df = df.join(features.select("project_id", F.col("project_duration_days").alias("__dur")), "project_id", "left")
        stored = F.when(F.col("__dur") > 0, F.col("__dur"))
    df = df.withColumns({
        "e": e, "s": s, "r": r, "cost_overrun_pct": F.coalesce("cost_overrun_pct", F.lit(0.0)),
        "has_sanctioned": F.coalesce(F.col("__sanctioned") != 0, F.lit(False)), "has_spent": F.coalesce(F.col("__expenditure") != 0, F.lit(False)),
        "stored_duration": stored, "project_duration_days": F.coalesce(stored, days)})
    e, s, r = F.col("e"), F.col("s"), F.col("r")
    df = df.withColumns({
        "x": F.when(e > 0, e).when(s > 0, s).when(r > 0, r).otherwise(0.0),
        "cost_metric_used": F.when(e > 0, "expenditure").when(s > 0, "sanctioned").when(r > 0, "released").otherwise("none"),
        "w": F.when((e > 0) | (s > 0), 1).otherwise(0)})
    keep = ["project_id", "sector", "sub_sector", "state_id", "district_name", "current_status", "e", "s", "r", "cost_overrun_pct", "has_sanctioned",
            "has_spent", "stored_duration", "project_duration_days", "x", "cost_metric_used", "w"]
    return df.select(*keep, F.when((F.col("project_duration_days") > 0) & (F.col("x") > 0), F.round(F.col("x") / F.col("project_duration_days"), 2)).alias("cost_per_day"),
                     F.round(e - s, 2).alias("cost_deviation"), F.when(r > 0, F.round(e / r, 4)).alias("utilization_ratio"))


def cost_peers(signals: DataFrame, min_peers: int = fv.MIN_PEERS, levels=robust.LEVELS) -> DataFrame:
    """Signals with the chosen peer level and leave-one-out statistics (NULL for rows without a cost)."""
    base = staged(signals, "cost")
    priced = base.filter("x > 0")
    chosen = staged(robust.choose_level(priced, levels, min_peers), "level")
    stats = robust.loo_robust_stats(chosen, priced, levels)
    return stats.unionByName(base.filter("x <= 0"), allowMissingColumns=True)


def cost_score(df: DataFrame, min_peers: int = fv.MIN_PEERS) -> DataFrame:
    """Adds ratio, score, anomaly_type and reason to rows of cost_peers."""
    x, s, o, med = F.col("x"), F.col("s"), F.col("cost_overrun_pct"), F.col("peer_median")
    z, dev, peers = F.col("robust_z"), F.col("deviation_pct"), F.col("peers")
    df = df.withColumn("ratio", F.when(med > 0, x / med).otherwise(1.0))
    q, st, pct = F.col("ratio"), F.lower("current_status"), F.floor("percentile").cast("int")
    early, active = st.isin(fv.EARLY_STATUSES), st.isin("completed", "ongoing", "in progress", "closed")
    over = (o > 15.0) | ((s > 0) & (x > s * 1.15))
    over_pct = F.when(o > 0, o).otherwise((x - s) / s * 100.0)
    raw = (F.when((q <= 1.8) & (z <= 2.5), 30.0 + (q - 1.35) / 0.45 * 25.0)
           .when((q <= 2.5) & (z <= 3.5), 55.0 + (q - 1.80) / 0.70 * 20.0)
           .otherwise(75.0 + F.least(F.lit(25.0), (q - 2.5) * 8.0)))
    raw = F.when((peers < 3) & (raw > 70.0), F.least(F.lit(70.0), raw * 0.85)).otherwise(raw)
    legit = (s > 0) & (x <= s * 1.02) & (o <= 0)
    cases = [
        ("MISSING_COST", F.coalesce(x, F.lit(0.0)) <= 0, F.lit(0.0), F.lit(tx.COST["missing"])),
        ("INSUFFICIENT_PEERS", peers < min_peers, F.lit(0.0), fmt(tx.COST["few"], F.coalesce("sector", F.lit("Unknown")), peers.cast("int"), F.lit(min_peers))),
        ("EARLY_STAGE_EXPENDITURE", (q < 0.15) & early, F.lit(10.0), fmt(tx.COST["early"], x, q * 100, med, F.col("current_status"))),
        ("LOW_COST_ANOMALY", q < 0.15, F.when(active, 45.0).otherwise(30.0), fmt(tx.COST["low"], x, q * 100, med, dev)),
        ("COST_OVERRUN_ANOMALY", over & (q > 1.35),
         F.least(F.lit(100.0), 60.0 + F.least(F.lit(40.0), (over_pct - 15.0) * 0.60 + F.greatest(F.lit(0.0), q - 1.35) * 10.0)),
         fmt(tx.COST["over_peer"], over_pct, x, s, q, pct)),
        ("COST_OVERRUN_ANOMALY", over, F.least(F.lit(100.0), 50.0 + F.least(F.lit(50.0), (over_pct - 15.0) * 0.50)), fmt(tx.COST["over"], over_pct, x, s, x - s)),
        ("NORMAL", (q <= 1.35) & (z <= 1.5), F.least(F.lit(25.0), F.greatest(dev, F.lit(0.0)) * 0.70),
         fmt(tx.COST["normal"], x, F.translate("peer_scope", "_", " "), med, pct)),
        ("LEGITIMATE_HIGH_BUDGET", legit, F.when(q <= 3.0, F.least(F.lit(50.0), raw * 0.65)).otherwise(F.least(F.lit(75.0), raw * 0.70)),
         fmt(tx.COST["legitimate"], x, q, s)),
    ]
    label, score, reason = F.when(cases[0][1], cases[0][0]), F.when(cases[0][1], cases[0][2]), F.when(cases[0][1], cases[0][3])
    for name, cond, val, text in cases[1:]:
        label, score, reason = label.when(cond, name), score.when(cond, val), reason.when(cond, text)
    return df.withColumns({"anomaly_type": label.otherwise("HIGH_COST_OUTLIER"), "raw_score": score.otherwise(raw),
                           "reason": reason.otherwise(fmt(tx.COST["outlier"], x, q, med, pct, F.col("sector"), z))})


def cost_confidence(min_peers: int = fv.MIN_PEERS) -> Column:
    n, scope = F.col("peers"), F.col("peer_scope")
    depth = F.when(n >= 10, 0.20).when(n >= 5, 0.15).when(n >= 3, 0.05).when(n == 2, -0.05).otherwise(-0.15)
    near = F.when(scope == "sector_and_district", 0.20).when(scope == "sector_and_state", 0.15).when(scope == "sector_nationwide", 0.08).otherwise(0.0)
    both = F.when(F.col("has_sanctioned") & F.col("has_spent"), 0.10).when(F.col("has_sanctioned") | F.col("has_spent"), 0.05).otherwise(0.0)
    known = F.when(F.col("stored_duration") > 0, 0.05).otherwise(0.0)
    c = F.round(F.least(F.greatest(0.50 + depth + near + both + known, F.lit(0.20)), F.lit(1.0)), 3)
    return F.when(F.col("x") <= 0, 0.0).when(n < min_peers, 0.30).otherwise(c)


def cost_anomaly(t, min_peers: int = fv.MIN_PEERS, features: DataFrame | None = None) -> DataFrame:
    d = cost_score(cost_peers(cost_signals(t["projects"], t["financials"], features), min_peers), min_peers)
    r2 = lambda c: F.round(c, 2)
    money = lambda c: fmt("₹%,.2f", F.col(c))
    details = [r2("e").alias("project_expenditure"), r2("peer_median").alias("peer_median"), r2("deviation_pct").alias("deviation_percentage"),
               F.round("percentile", 1).alias("percentile"), F.col("peers").alias("peer_group_size"), r2("s").alias("sanctioned_amount"),
               r2("r").alias("released_amount"), r2("x").alias("evaluated_cost"), F.col("cost_metric_used"), F.col("peer_scope"), r2("q1").alias("peer_q1"),
               r2("q3").alias("peer_q3"), r2("iqr").alias("peer_iqr"), r2("robust_z").alias("robust_z_score"), r2("cost_overrun_pct").alias("cost_overrun_pct"),
               F.col("project_duration_days"), F.col("cost_per_day"), F.col("utilization_ratio"), F.col("cost_deviation"), F.col("anomaly_type"), F.col("sector")]
    rated = (F.col("x") > 0) & (F.col("peers") >= min_peers)
    evidence = F.when(rated, F.array(
        ev("project_cost", "Project Cost", money("x")), ev("peer_median", "Peer Median Cost", money("peer_median")),
        ev("deviation_multiplier", "Deviation Multiplier", fmt("%.2fx", F.col("ratio"))), ev("percentile", "Peer Percentile", fmt("%.1fth percentile", F.col("percentile"))),
        ev("robust_z_score", "Robust Z-Score", fmt("%.2f", F.col("robust_z"))), ev("peer_iqr", "Peer IQR", money("iqr")),
        ev("cost_overrun_pct", "Budget Overrun", fmt("%+.1f%%", F.col("cost_overrun_pct")))))
    return engine_result(
        d, "cost_anomaly", F.col("raw_score"), F.col("reason"), cost_confidence(min_peers), details,
        threshold=F.when(rated, "Robust Z >= 2.0 or expenditure > 1.35x peer median with > 15% budget overrun"),
        actual=F.when(rated, fmt("₹%,.2f (%+.1f%% vs peer median, %.1fth percentile)", F.col("x"), F.col("deviation_pct"), F.col("percentile"))),
        expected=F.when(rated, fmt("Peer Median: ₹%,.2f (Sanctioned: ₹%,.2f)", F.col("peer_median"), F.col("s"))),
        reference=F.when(rated, fmt("Category benchmark IQR: ₹%,.2f (Q1: ₹%,.2f, Q3: ₹%,.2f)", F.col("iqr"), F.col("q1"), F.col("q3"))), evidence=evidence)


# ---- delay ----------------------------------------------------------------------------------------

def ordered_thresholds(low, med, high, crit, step=1):
    """Strictly rising positive thresholds."""
    low = max(step, low)
    med = max(low + step, med)
    high = max(med + step, high)
    return low, med, high, max(high + step, crit)


def delay_score(days: Column, planned: Column, thresholds=fv.DELAY_DAYS) -> Column:
    """0-100 from overdue days in four linear bands, raised when the overrun is large for the plan."""
    low, med, high, crit = ordered_thresholds(*thresholds)
    d = days.cast("double")
    s = (F.when(d <= low, F.greatest(F.lit(1.0), d / low * 29.0)).when(d <= med, 30.0 + (d - low) / float(med - low) * 29.0)
         .when(d <= high, 60.0 + (d - med) / float(high - med) * 19.0).otherwise(F.least(F.lit(100.0), 80.0 + (d - high) / float(crit - high) * 20.0)))
    share = F.when(planned > 0, d / planned)
    s = F.when(share >= 1.0, F.least(F.lit(100.0), s + 8.0)).when(share >= 0.5, F.least(F.lit(100.0), s + 4.0)).otherwise(s)
    return F.when(d > 0, F.bround(F.least(F.greatest(s, F.lit(0.0)), F.lit(100.0)), 0)).otherwise(0.0).cast("int")


def delay_eval(projects: DataFrame, as_of: dt.date, thresholds=fv.DELAY_DAYS) -> DataFrame:
    """Delay facts per project: completion status, overdue days, durations, score, reason, confidence."""
    start = F.coalesce("work_order_date", "sanction_date", "recommendation_date")
    exp, act, ref = F.col("expected_completion_date"), F.col("actual_completion_date"), F.lit(as_of)
    st = F.lower(F.trim(F.coalesce("current_status", F.lit("Unknown"))))
    done = act.isNotNull() | st.isin(fv.CLOSED_STATUSES)
    plan, real = F.datediff(exp, start), F.datediff(act, start)
    df = projects.withColumns({
        "status_clean": st, "start_date": start, "is_completed": done,
        "planned_duration": F.when(plan < 0, 30).when(plan == 0, 1).otherwise(plan),
        "actual_duration": F.when(done & act.isNotNull() & start.isNotNull(), F.greatest(real, F.lit(1)))
        .when(start.isNotNull(), F.greatest(F.lit(0), F.datediff(ref, start))),
        "invalid_timeline": F.coalesce(plan < 0, F.lit(False)) | F.coalesce(done & (real < 0), F.lit(False))})
    late, left = F.datediff(act, exp), F.datediff(exp, ref)
    state = (F.when(st.isin(fv.CANCELLED_STATUSES), "NOT_APPLICABLE").when((st == "closed") & act.isNull(), "NOT_APPLICABLE")
             .when(exp.isNull(), "MISSING_DATES").when(act.isNotNull(), F.when(late > 0, "COMPLETED_LATE").otherwise("COMPLETED_ON_TIME"))
             .when(done, "COMPLETED_UNRECORDED_DATE").when(left < 0, "ONGOING_OVERDUE").otherwise("ONGOING_ON_SCHEDULE"))
    df = df.withColumn("completion_status", state)
    cs, planned = F.col("completion_status"), F.col("planned_duration")
    df = df.withColumn("overdue_days", F.when(cs == "COMPLETED_LATE", late).when(cs == "ONGOING_OVERDUE", -left).otherwise(0))
    od = F.col("overdue_days")
    df = df.withColumns({
        "early_days": F.when(cs == "COMPLETED_ON_TIME", -late), "days_remaining": F.when(cs == "ONGOING_ON_SCHEDULE", left),
        "delay_percentage": F.when((od > 0) & (planned > 0), F.round(od / planned * 100, 1)).otherwise(0.0),
        "score": delay_score(od, planned, thresholds)})
    pct, iso = F.col("delay_percentage"), lambda c: F.date_format(c, "yyyy-MM-dd")
    raw_status = F.coalesce("current_status", F.lit("Unknown"))
    ref_text = str(as_of)
    reason = (F.when((cs == "NOT_APPLICABLE") & (st == "closed"), fmt(tx.DELAY["closed"], raw_status)).when(cs == "NOT_APPLICABLE", fmt(tx.DELAY["not_applicable"], raw_status))
              .when(cs == "MISSING_DATES", tx.DELAY["no_plan"])
              .when(cs == "COMPLETED_LATE", F.concat(fmt(tx.DELAY["late"], od, iso(exp), iso(act)), F.when(pct > 10, fmt(tx.DELAY["late_pct"], pct)).otherwise("")))
              .when((cs == "COMPLETED_ON_TIME") & (late < 0), fmt(tx.DELAY["early"], -late)).when(cs == "COMPLETED_ON_TIME", tx.DELAY["exact"])
              .when(cs == "COMPLETED_UNRECORDED_DATE", tx.DELAY["undated"])
              .when(cs == "ONGOING_OVERDUE", F.concat(fmt(tx.DELAY["overdue"], od, iso(exp), F.lit(ref_text)), F.when(pct > 15, fmt(tx.DELAY["overdue_pct"], pct)).otherwise("")))
              .when(left == 0, fmt(tx.DELAY["today"], iso(exp))).otherwise(fmt(tx.DELAY["on_time"], left, iso(exp))))
    conf = (F.when(cs == "NOT_APPLICABLE", 1.0).when(cs == "MISSING_DATES", 0.0).when(cs == "COMPLETED_UNRECORDED_DATE", 0.50)
            .when(act.isNotNull(), F.when(start.isNotNull(), 0.95).otherwise(0.85)).otherwise(F.when(start.isNotNull(), 0.90).otherwise(0.70)))
    return df.withColumns({"reason": reason, "confidence": conf})


def delay_detection(t, as_of: dt.date, thresholds=fv.DELAY_DAYS) -> DataFrame:
    d = delay_eval(t["projects"], as_of, thresholds)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    dated = ~F.col("completion_status").isin("NOT_APPLICABLE", "MISSING_DATES")
    measured = dated & (F.col("completion_status") != "COMPLETED_UNRECORDED_DATE")
    done = F.col("actual_completion_date").isNotNull()
    details = [F.col("overdue_days"), F.col("delay_percentage"), F.when(dated & F.col("is_completed"), "completed").otherwise(F.col("status_clean")).alias("status"),
               F.col("completion_status"), F.when(dated, F.col("planned_duration")).alias("planned_duration"), F.when(measured, F.col("actual_duration")).alias("actual_duration"),
               iso("expected_completion_date").alias("expected_completion_date"), iso("actual_completion_date").alias("actual_completion_date"),
               iso("start_date").alias("start_date"), iso("sanction_date").alias("sanction_date"), iso("work_order_date").alias("work_order_date"),
               F.col("early_days"), F.col("days_remaining"), F.col("invalid_timeline")]
    now = F.when(done, iso("actual_completion_date")).otherwise(str(as_of))
    evidence = F.when(measured, F.array(
        ev("planned_completion_date", "Planned Completion Date", iso("expected_completion_date")),
        F.struct(F.lit("actual_current_date").alias("metric"), F.when(done, "Actual Completion Date").otherwise("Evaluation Reference Date").alias("label"), now.alias("formatted")),
        ev("delay_days", "Delay Days", fmt("%d days", F.col("overdue_days"))), ev("delay_percentage", "Schedule Slippage", fmt("%.1f%%", F.col("delay_percentage")))))
    return engine_result(d, "delay_detection", F.col("score"), F.col("reason"), F.col("confidence"), details,
                         threshold=F.when(dated, f"> {thresholds[0]} days overdue beyond planned completion date"),
                         actual=F.when(measured, fmt("%d days overdue (+%.1f%% slippage)", F.col("overdue_days"), F.col("delay_percentage"))),
                         expected=F.when(dated, F.concat(F.lit("Planned completion: "), iso("expected_completion_date"))),
                         reference=F.when(measured, F.concat(F.when(done, "Completed on: ").otherwise("As of "), now)), evidence=evidence)


# ---- progress mismatch -----------------------------------------------------------------------------

def progress_values(projects: DataFrame, financials: DataFrame, progress: DataFrame) -> DataFrame:
    """Financial and physical percentages with status and accounting fallbacks."""
    p = projects.select("project_id", "current_status")
    f = financials.select("project_id", *[F.col(f"{c}_amount").cast("double").alias(c) for c in ("sanctioned", "released", "expenditure")],
                          F.col("utilization_rate_pct").cast("double").alias("utilization_rate_pct"), F.lit(True).alias("has_fin"))
    g = latest_progress(progress).select("project_id", F.col("physical_progress_pct").cast("double").alias("pp"),
                                         F.col("financial_progress_pct").cast("double").alias("fp"), "current_stage", F.lit(True).alias("has_prog"))
    df = p.join(f, "project_id", "left").join(g, "project_id", "left")
    st = F.lower(F.trim(F.coalesce("current_status", F.lit(""))))
    box = lambda c: X.clip(c, 0.0, 100.0)
    ratio = lambda den: F.when(F.col(den) > 0, F.col("expenditure") / F.col(den) * 100.0)
    phys = F.coalesce(box(F.col("pp")), F.when(st.isin("completed", "physically complete"), 100.0).when(st.isin(fv.PREWORK_STATUSES), 0.0))
    fin = F.coalesce(box(F.col("fp")), box(ratio("sanctioned")), box(ratio("released")), box(F.col("utilization_rate_pct")))
    return df.withColumns({"status_clean": st, "financial_raw": fin, "physical_raw": phys})


def mismatch_score(gap: Column, thresholds=fv.MISMATCH_GAPS) -> Column:
    """0-100 from the signed gap (financial minus physical)."""
    tol, mod, high, crit = (float(v) for v in ordered_thresholds(*thresholds, step=1.0))
    a, b1, b2 = F.abs(gap), mod + 5.0, high + 10.0
    even = F.least(F.bround(a / tol * 29.0, 0), F.lit(29.0))
    lead = (F.when(gap <= mod, 30.0 + (gap - tol) / max(1.0, mod - tol) * 29.0).when(gap <= high, 60.0 + (gap - mod) / max(1.0, high - mod) * 19.0)
            .otherwise(80.0 + (gap - high) / max(1.0, crit - high) * 20.0))
    lag = (F.when(a <= b1, 30.0 + (a - tol) / max(1.0, b1 - tol) * 19.0).when(a <= b2, 50.0 + (a - b1) / max(1.0, b2 - b1) * 19.0)
           .otherwise(70.0 + (a - b2) / max(1.0, crit - b2) * 15.0))
    box = lambda c, hi: F.bround(F.least(F.greatest(c, F.lit(30.0)), F.lit(hi)), 0)
    return F.when(a <= tol, even).when(gap > tol, box(lead, 100.0)).otherwise(box(lag, 85.0)).cast("int")


def mismatch_eval(values: DataFrame, thresholds=fv.MISMATCH_GAPS) -> DataFrame:
    tol = float(ordered_thresholds(*thresholds, step=1.0)[0])
    fin, phy = F.round("financial_raw", 1), F.round("physical_raw", 1)
    off = F.col("status_clean").isin(fv.CANCELLED_STATUSES)
    df = values.withColumns({"financial_progress": fin, "physical_progress": phy})
    df = df.withColumn("progress_gap", F.round(F.col("financial_progress") - F.col("physical_progress"), 1))
    gap, fin, phy = F.col("progress_gap"), F.col("financial_progress"), F.col("physical_progress")
    direction = (F.when(off, "not_applicable").when(fin.isNull() & phy.isNull(), "missing_data").when(fin.isNull(), "missing_financial")
                 .when(phy.isNull(), "missing_physical").when(F.abs(gap) <= tol, "balanced").when(gap > 0, "financial_leading").otherwise("physical_leading"))
    df = df.withColumn("direction", direction)
    d = F.col("direction")
    usable = d.isin("balanced", "financial_leading", "physical_leading")
    show = lambda c: F.when(c == F.floor(c), fmt("%.0f%%", c)).otherwise(fmt("%.1f%%", c))
    reason = (F.when(d == "not_applicable", fmt(tx.MISMATCH["not_applicable"], F.coalesce("current_status", F.lit("Unknown")))).when(d == "missing_data", tx.MISMATCH["both"])
              .when(d == "missing_financial", tx.MISMATCH["financial"]).when(d == "missing_physical", tx.MISMATCH["physical"])
              .when((d == "balanced") & (gap == 0), fmt(tx.MISMATCH["aligned"], show(phy), show(fin))).when(d == "balanced", fmt(tx.MISMATCH["balanced"], show(phy), show(fin), gap))
              .when(d == "financial_leading", fmt(tx.MISMATCH["ahead"], show(fin), show(phy), gap)).otherwise(fmt(tx.MISMATCH["behind"], show(phy), F.abs(gap), show(fin))))
    return df.withColumns({"score": F.when(usable, mismatch_score(gap, thresholds)).otherwise(0), "reason": reason, "confidence": mismatch_confidence()})


def mismatch_confidence() -> Column:
    d, full = F.col("direction"), F.col("has_fin") & F.col("has_prog")
    spent, sanc, phy, fin = (F.col(c).isNotNull() for c in ("expenditure", "sanctioned", "pp", "fp"))
    base = (F.when(full & spent & sanc & phy & fin, 0.95).when(full & (spent | fin) & phy, 0.90).when(full, 0.80)
            .when(F.col("status_clean").isin("completed", "physically complete") & F.col("has_fin"), 0.85)
            .when(F.col("has_prog") & phy, 0.60).when(F.col("has_fin") & spent, 0.60).when(F.col("has_fin") | F.col("has_prog"), 0.40).otherwise(0.0))
    return (F.when(d == "not_applicable", 1.0).when(d == "missing_data", 0.0).when(d.isin("missing_financial", "missing_physical"), 0.30).otherwise(base))


def progress_mismatch(t, thresholds=fv.MISMATCH_GAPS) -> DataFrame:
    d = mismatch_eval(progress_values(t["projects"], t["financials"], t["progress"]), thresholds)
    tol, mod = (float(v) for v in ordered_thresholds(*thresholds, step=1.0)[:2])
    usable = d.direction.isin("balanced", "financial_leading", "physical_leading")
    pct = lambda c: fmt("%.1f%%", F.col(c))
    ratio = lambda den: F.when(F.col(den) > 0, F.round(F.col("expenditure") / F.col(den) * 100.0, 1))
    details = [F.coalesce("financial_progress", F.lit(0.0)).alias("financial_progress"), F.coalesce("physical_progress", F.lit(0.0)).alias("physical_progress"),
               F.coalesce("progress_gap", F.lit(0.0)).alias("progress_gap"), F.col("direction"), F.col("sanctioned").alias("sanctioned_amount"), F.col("released").alias("released_amount"),
               F.col("expenditure").alias("expenditure_amount"), ratio("sanctioned").alias("expenditure_ratio_sanctioned"), ratio("released").alias("expenditure_ratio_released"),
               F.col("utilization_rate_pct"), F.col("current_status"), F.col("current_stage"), F.lit(tol).alias("tolerance")]
    evidence = F.when(usable, F.array(
        ev("financial_progress", "Financial Disbursement", pct("financial_progress")), ev("physical_progress", "Physical Completion", pct("physical_progress")),
        ev("progress_gap", "Progress Gap (Financial - Physical)", fmt("%+.1f%%", F.col("progress_gap"))), ev("tolerance_threshold", "Tolerance Threshold", F.lit(f"±{tol:.1f}%"))))
    return engine_result(d, "progress_mismatch", F.col("score"), F.col("reason"), F.col("confidence"), details,
                         threshold=F.when(usable, F.lit(f"Disbursement leads physical completion by >= {mod:.1f}% (Tolerance: ±{tol:.1f}%)")),
                         actual=F.when(usable, fmt("Financial %.1f%% vs Physical %.1f%% (Gap: %+.1f%%)", F.col("financial_progress"), F.col("physical_progress"), F.col("progress_gap"))),
                         expected=F.when(usable, F.lit(f"Physical progress commensurate with disbursement (balanced ±{tol:.1f}%)")),
                         reference=F.when(usable, fmt("Current stage: '%s' (Status: '%s')", F.coalesce("current_stage", F.lit("Unrecorded")), F.col("current_status"))), evidence=evidence)


# ---- agency pattern ----------------------------------------------------------------------------------

AGENCY_FIELDS = ["implementing_agency", "executing_agency", "department", "contractor", "authority"]


def resolve_agency(df: DataFrame) -> DataFrame:
    """agency_name (first non-blank field), the field it came from, and the matching key."""
    have = [c for c in AGENCY_FIELDS if c in df.columns]
    val = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    field = F.coalesce(*[F.when(val(c).isNotNull(), F.lit(c)) for c in have])
    name = F.coalesce(*[val(c) for c in have])
    return df.withColumns({"agency_name": name, "agency_field_used": field, "agency_key": F.lower(name)})


def agency_flags(projects: DataFrame, financials: DataFrame, progress: DataFrame, as_of: dt.date) -> DataFrame:
    """Per-project portfolio flags that the agency statistics count."""
    p = resolve_agency(projects).filter("agency_key is not null").select(
        "project_id", "agency_key", "agency_name", "current_status", "expected_completion_date", "actual_completion_date")
    f = financials.select("project_id", *[F.col(f"{c}_amount").cast("double").alias(c) for c in ("sanctioned", "released", "expenditure")],
                          F.col("cost_overrun_pct").cast("double").alias("over_pct"))
    g = latest_progress(progress).select("project_id", F.col("physical_progress_pct").cast("double").alias("pp"), F.col("financial_progress_pct").cast("double").alias("fp"))
    df = p.join(f, "project_id", "left").join(g, "project_id", "left")
    st, exp, act = F.lower(F.trim(F.coalesce("current_status", F.lit("")))), F.col("expected_completion_date"), F.col("actual_completion_date")
    comp, stall, off = st.isin(fv.CLOSED_STATUSES) | act.isNotNull(), st.isin(fv.STALLED_STATUSES), st.isin(fv.CANCELLED_STATUSES)
    sanc, rel, spent = F.when(F.col("sanctioned") > 0, F.col("sanctioned")), F.when(F.col("released") > 0, F.col("released")), F.col("expenditure")
    yes = lambda c: F.coalesce(c, F.lit(False))
    late_days = F.when(comp, F.datediff(act, exp)).otherwise(F.datediff(F.lit(as_of), exp))
    scheduled, priced = ~off & exp.isNotNull(), sanc.isNotNull() & spent.isNotNull()
    phy = F.coalesce(F.col("pp"), F.when(comp, 100.0))
    fin = F.coalesce(F.col("fp"), X.clip(spent / sanc * 100.0, 0.0, 100.0), X.clip(spent / rel * 100.0, 0.0, 100.0))
    df = df.withColumns({
        "completed": comp, "stalled": ~comp & stall, "active": ~comp & ~stall & ~off, "scheduled": scheduled, "delayed": yes(scheduled & (late_days > 30)),
        "priced": priced, "cost_odd": yes(priced & (yes(F.col("over_pct") > 10) | yes(spent > sanc * 1.10) | yes(spent > rel * 1.05))),
        "measured": phy.isNotNull() & fin.isNotNull(), "mismatched": yes(F.abs(fin - phy) > 15.0), "cost": sanc, "util": X.clip(spent / rel * 100.0, 0.0, 150.0)})
    signals = F.col("delayed").cast("int") + F.col("cost_odd").cast("int") + F.col("mismatched").cast("int")
    return df.withColumn("multi", signals >= 2)


def agency_stats(flags: DataFrame) -> DataFrame:
    """Portfolio rates per agency. Plain counts combine map-side; the exact median uses rank arithmetic."""
    n = lambda c: F.count_if(F.col(c))
    g = flags.groupBy("agency_key").agg(
        F.min("agency_name").alias("agency_name"), F.count(F.lit(1)).alias("projects_analyzed"), n("delayed").alias("delayed_count"), n("scheduled").alias("scheduled_count"),
        n("cost_odd").alias("cost_anomaly_count"), n("priced").alias("financial_count"), n("mismatched").alias("mismatch_count"), n("measured").alias("progress_count"),
        n("completed").alias("completed_count"), n("stalled").alias("stalled_count"), n("active").alias("active_count"), n("multi").alias("multi_count"),
        F.coalesce(F.round(F.avg("cost"), 2), F.lit(0.0)).alias("average_cost"), F.coalesce(F.round(F.avg("util"), 1), F.lit(0.0)).alias("average_utilization"))
    med = group_quantiles(flags.select("agency_key", "cost"), ["agency_key"], "cost", {"median_cost": 0.5}).select("agency_key", F.round("median_cost", 2).alias("median_cost"))
    rate = lambda a, b, k=3, f=1.0: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * f, k)).otherwise(0.0)
    return g.join(med, "agency_key", "left").withColumns({
        "median_cost": F.coalesce("median_cost", F.lit(0.0)), "delay_rate": rate("delayed_count", "scheduled_count"), "cost_anomaly_rate": rate("cost_anomaly_count", "financial_count"),
        "mismatch_rate": rate("mismatch_count", "progress_count"), "completion_rate": rate("completed_count", "projects_analyzed", 1, 100.0),
        "high_risk_frequency": rate("multi_count", "projects_analyzed"),
        "data_completeness_pct": F.round((F.col("scheduled_count") + F.col("financial_count") + F.col("progress_count")) / (3.0 * F.col("projects_analyzed")) * 100.0, 1)})


def agency_score(min_projects=fv.AGENCY_MIN_PROJECTS, delay=fv.AGENCY_DELAY_RATE, cost=fv.AGENCY_COST_RATE, mismatch=fv.AGENCY_MISMATCH_RATE) -> Column:
    d, c, m, done, hi, n = (F.col(k) for k in ("delay_rate", "cost_anomaly_rate", "mismatch_rate", "completion_rate", "high_risk_frequency", "projects_analyzed"))
    part = lambda rate, th, pts, cap: F.least(F.lit(cap), rate / max(0.01, th) * pts)
    s = part(d, delay, 20.0, 40.0) + part(c, cost, 15.0, 30.0) + part(m, mismatch, 12.5, 25.0) + F.greatest(F.lit(0.0), (100.0 - done) / 100.0) * 5.0
    s = s + F.when(hi >= 0.35, 10.0).when(hi >= 0.20, 5.0).otherwise(0.0)
    s = F.when(d >= 0.70, F.greatest(F.lit(65.0), s + 10.0)).otherwise(s)
    s = F.when((done >= 80.0) & (d <= 0.15), F.least(s, F.lit(18.0))).otherwise(s)
    s = F.when(n < 5, F.least(F.lit(55.0), s)).when(n < 10, F.least(F.lit(75.0), s)).otherwise(s)
    few = F.least(F.lit(15.0), F.bround(d * 40.0 + c * 30.0 + m * 30.0, 0))
    return F.when(n < min_projects, few).otherwise(F.bround(F.least(F.greatest(s, F.lit(0.0)), F.lit(100.0)), 0)).cast("int")


def agency_confidence(min_projects=fv.AGENCY_MIN_PROJECTS) -> Column:
    n = F.col("projects_analyzed")
    base = F.when(n >= 15, 0.95).when(n >= 10, 0.90).when(n >= 5, 0.85).otherwise(0.60)
    full = (F.col("scheduled_count") + F.col("financial_count") + F.col("progress_count")) / F.greatest(F.lit(1.0), n * 3.0)
    base = F.when(full < 0.75, base * F.greatest(F.lit(0.5), full)).otherwise(base)
    few = F.round(F.least(F.greatest(0.35 * (n / float(max(1, min_projects))), F.lit(0.10)), F.lit(0.35)), 2)
    return F.when(n < min_projects, few).otherwise(F.round(F.least(F.greatest(base, F.lit(0.10)), F.lit(0.95)), 2))


def agency_reason(score: Column, min_projects=fv.AGENCY_MIN_PROJECTS) -> Column:
    n, name = F.col("projects_analyzed"), F.col("agency_name")
    pct = lambda c: F.col(c) * 100.0
    dl, co, mm = [(F.col(f"{c}_count"), pct(r)) for c, r in (("delayed", "delay_rate"), ("cost_anomaly", "cost_anomaly_rate"), ("mismatch", "mismatch_rate"))]
    return (F.when(n < min_projects, fmt(tx.AGENCY["few"], name, n, F.lit(min_projects))).when(n < 5, fmt(tx.AGENCY["limited"], name, n, *dl, *mm))
            .when(score >= 80, fmt(tx.AGENCY["critical"], name, n, *dl, *mm, *co)).when(score >= 60, fmt(tx.AGENCY["high"], name, n, *dl, *mm, *co))
            .when(score >= 30, fmt(tx.AGENCY["medium"], name, n, *dl, *co, *mm))
            .otherwise(fmt(tx.AGENCY["low"], name, n, F.col("completed_count"), F.col("completion_rate"), *dl, F.col("cost_anomaly_count"))))


def agency_table(t, as_of: dt.date) -> DataFrame:
    """One scored row per agency."""
    s = agency_stats(staged(agency_flags(t["projects"], t["financials"], t["progress"], as_of), "agency"))
    s = s.withColumn("agency_risk_score", agency_score())
    n = F.col("projects_analyzed")
    return s.withColumns({"agency_confidence": agency_confidence(), "agency_reason": agency_reason(F.col("agency_risk_score")),
                          "sample_size_status": F.when(n < fv.AGENCY_MIN_PROJECTS, "INSUFFICIENT").when(n < 5, "LIMITED").when(n < 10, "SUFFICIENT").otherwise("ROBUST")})


def agency_pattern(t, as_of: dt.date) -> DataFrame:
    """Agency result of every project; agency rows are computed once and joined back by agency."""
    side = agency_table(t, as_of)
    p = resolve_agency(t["projects"]).select("project_id", "agency_key", "agency_field_used")
    d = p.join(side, "agency_key", "left")
    known = F.col("projects_analyzed").isNotNull()
    pct = lambda c: F.col(c) * 100
    rates = ["delay_rate", "cost_anomaly_rate", "mismatch_rate", "average_cost", "median_cost", "average_utilization", "completion_rate", "high_risk_frequency"]
    details = [F.coalesce("projects_analyzed", F.lit(0)).alias("projects_analyzed"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in rates], F.col("agency_name"), F.col("agency_field_used"),
               F.coalesce(F.col("projects_analyzed") < fv.AGENCY_MIN_PROJECTS, F.lit(True)).alias("insufficient_history"), F.col("sample_size_status"), F.col("data_completeness_pct")]
    enough = known & (F.col("projects_analyzed") >= fv.AGENCY_MIN_PROJECTS)
    evidence = F.when(enough, F.array(
        ev("agency_projects_analyzed", "Projects Evaluated", fmt("%d projects", F.col("projects_analyzed"))), ev("agency_delay_rate", "Agency Delay Rate", fmt("%.1f%%", pct("delay_rate"))),
        ev("agency_mismatch_rate", "Agency Progress Mismatch Rate", fmt("%.1f%%", pct("mismatch_rate"))),
        ev("agency_cost_anomaly_rate", "Agency Cost Anomaly Rate", fmt("%.1f%%", pct("cost_anomaly_rate"))), ev("peer_comparison", "Institutional Benchmark", F.lit("< 25.0% expected"))))
    return engine_result(
        d, "agency_pattern", F.when(known, F.col("agency_risk_score")).otherwise(0), F.when(known, F.col("agency_reason")).otherwise(tx.AGENCY["none"]),
        F.when(known, F.col("agency_confidence")).otherwise(0.0), details,
        threshold=F.when(enough, "Historical delay or mismatch rate > 25.0% (minimum 3 projects)"),
        actual=F.when(enough, fmt("%s: %d projects evaluated (Delay rate: %.1f%%, Mismatch rate: %.1f%%)", F.col("agency_name"), F.col("projects_analyzed"), pct("delay_rate"), pct("mismatch_rate"))),
        expected=F.when(enough, "Healthy institutional benchmark: < 25.0% historical delay frequency"),
        reference=F.when(enough, fmt("Agency portfolio: %d projects (Sample status: %s)", F.col("projects_analyzed"), F.col("sample_size_status"))), evidence=evidence)


# ---- fund utilization --------------------------------------------------------------------------------

def fund_utilization(t) -> DataFrame:
    """Six-case fund use score with a three-level severity."""
    f = t["financials"].select("project_id", *[F.coalesce(F.col(f"{c}_amount").cast("double"), F.lit(0.0)).alias(k) for c, k in (("sanctioned", "s"), ("released", "r"), ("expenditure", "e"))],
                               F.lit(True).alias("has_fin"))
    d = t["projects"].select("project_id", "current_status").join(f, "project_id", "left")
    s, r, e, st = F.col("s"), F.col("r"), F.col("e"), F.lower(F.trim("current_status"))
    util = F.when(s > 0, F.round(e / s, 4))
    d = d.withColumns({"utilization_ratio": util, "overrun_pct": F.when(s > 0, F.round((F.round(e / s, 4) - 1.0) * 100.0, 1)),
                       "deficit_pct": F.when(r > 0, F.round((e / r - 1.0) * 100.0, 1))})
    u, op, dp = F.col("utilization_ratio"), F.col("overrun_pct"), F.col("deficit_pct")
    pct, trunc = F.round(u * 100.0, 1), lambda c: F.floor(c).cast("int")
    cases = [
        (F.col("has_fin").isNull(), F.lit(0), F.lit(tx.FUNDS["missing"])), (s <= 0, F.lit(0), F.lit(tx.FUNDS["no_sanction"])),
        (e > s, 75 + F.least(F.lit(25), trunc(op * 1.5)), fmt(tx.FUNDS["over"], op, F.round(e - s, 2))),
        ((r > 0) & (e > r * 1.02), 65 + F.least(F.lit(25), trunc(dp * 1.2)), fmt(tx.FUNDS["deficit"], F.round(e - r, 2), dp)),
        ((st == "completed") & (u < 0.85), 40 + trunc((0.85 - u) * 40), fmt(tx.FUNDS["closed_low"], pct, F.round(s - e, 2))),
        (st.isin("in progress", "ongoing", "work commenced") & (u < 0.25), 45 + trunc((0.25 - u) * 100), fmt(tx.FUNDS["active_low"], pct)),
        (st.isin(fv.PREWORK_STATUSES) & (e == 0), F.lit(0), F.lit(tx.FUNDS["prework"])), (u >= 0.70, F.lit(0), fmt(tx.FUNDS["healthy"], pct)),
    ]
    score, reason = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for cond, val, text in cases[1:]:
        score, reason = score.when(cond, val), reason.when(cond, text)
    d = d.withColumns({"score": score.otherwise(trunc((0.70 - u) * 40)), "reason": reason.otherwise(fmt(tx.FUNDS["moderate"], pct))})
    return d.select("project_id", "score", X.severity_v1("score").alias("severity"), "reason", F.col("s").alias("sanctioned"), F.col("r").alias("released"),
                    F.col("e").alias("expenditure"), "utilization_ratio")
