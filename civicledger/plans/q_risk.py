"""Risk engine queries."""
from pyspark.sql import functions as F

from civicledger.functions import columns as X
from civicledger.operators import engines as R, robust
from civicledger.plans.bindings import AS_OF
from civicledger.plans.oracle_tables import CTES, sql
from civicledger.plans.registry import query

REF = "DATE '2000-01-01'"

# ---- cost: signals and brute-force peer statistics in SQL ------------------------------------------
CTES["cost0"] = (("projects", "financials"), """
  SELECT project_id, sector, state_id, district_name, current_status, expenditure_amount::DOUBLE AS e, coalesce(sanctioned_amount, 0)::DOUBLE AS s, released_amount::DOUBLE AS r, cost_overrun_pct AS o,
    coalesce(actual_completion_date, expected_completion_date) - coalesce(work_order_date, sanction_date, recommendation_date) AS days FROM projects JOIN financials USING (project_id)""")
CTES["cost1"] = (("cost0",), """
  SELECT *, CASE WHEN e > 0 THEN e WHEN s > 0 THEN s WHEN r > 0 THEN r ELSE 0 END AS x, CASE WHEN e > 0 THEN 'expenditure' WHEN s > 0 THEN 'sanctioned' WHEN r > 0 THEN 'released' ELSE 'none' END AS metric,
    CASE WHEN e > 0 OR s > 0 THEN 1 ELSE 0 END AS w, CASE WHEN days > 0 THEN days END AS dur FROM cost0""")
CTES["peers"] = (("cost1",), """
  SELECT a.project_id, a.x, b.x AS y FROM cost1 a JOIN cost1 b ON a.sector = b.sector AND a.district_name = b.district_name AND a.project_id <> b.project_id WHERE a.x > 0 AND b.w = 1""")
CTES["pstat"] = (("peers",), """
  SELECT project_id, any_value(x) AS x, count(*) AS peers, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, count(*) FILTER (y <= x) / count(*) * 100.0 AS percentile FROM peers GROUP BY 1""")
CTES["pmad"] = (("peers", "pstat"), "SELECT p.project_id, quantile_cont(abs(p.y - s.med), 0.5) AS mad FROM peers p JOIN pstat s USING (project_id) GROUP BY 1")
CTES["metrics"] = (("pstat", "pmad"), """
  SELECT *, greatest(0, q3 - q1) AS iqr, CASE WHEN med > 0 THEN (x - med) / med * 100.0 ELSE 0 END AS dev,
    (x - med) / CASE WHEN mad > 0 THEN greatest(mad / 0.6745, med * 0.05, 10000) WHEN q3 > q1 THEN greatest((q3 - q1) / 1.349, med * 0.05, 10000) ELSE greatest(med * 0.05, 10000) END AS z
  FROM pstat JOIN pmad USING (project_id)""")
CTES["scored0"] = (("cost1", "metrics"), """
  SELECT c.*, m.peers, med, q1, q3, iqr, dev, z, percentile, mad, CASE WHEN med > 0 THEN c.x / med ELSE 1.0 END AS q, CASE WHEN o > 0 THEN o ELSE (c.x - s) / nullif(s, 0) * 100 END AS op,
    (o > 15 OR (s > 0 AND c.x > s * 1.15)) AS over FROM cost1 c LEFT JOIN metrics m USING (project_id)""")
CTES["scored1"] = (("scored0",), """
  SELECT *, CASE WHEN q <= 1.8 AND z <= 2.5 THEN 30 + (q - 1.35) / 0.45 * 25 WHEN q <= 2.5 AND z <= 3.5 THEN 55 + (q - 1.80) / 0.70 * 20 ELSE 75 + least(25, (q - 2.5) * 8) END AS raw FROM scored0""")
CTES["cost_scored"] = (("scored1",), """
  SELECT *, CASE WHEN x <= 0 THEN 'MISSING_COST' WHEN coalesce(peers, 0) < 2 THEN 'INSUFFICIENT_PEERS' WHEN q < 0.15 AND lower(current_status) IN ('work order issued','sanctioned','recommended') THEN 'EARLY_STAGE_EXPENDITURE'
      WHEN q < 0.15 THEN 'LOW_COST_ANOMALY' WHEN over THEN 'COST_OVERRUN_ANOMALY' WHEN q <= 1.35 AND z <= 1.5 THEN 'NORMAL' WHEN s > 0 AND x <= s * 1.02 AND o <= 0 THEN 'LEGITIMATE_HIGH_BUDGET' ELSE 'HIGH_COST_OUTLIER' END AS anomaly_type,
    round_even(least(greatest(CASE WHEN x <= 0 OR coalesce(peers, 0) < 2 THEN 0 WHEN q < 0.15 AND lower(current_status) IN ('work order issued','sanctioned','recommended') THEN 10
      WHEN q < 0.15 THEN CASE WHEN lower(current_status) IN ('completed','in progress') THEN 45 ELSE 30 END
      WHEN over AND q > 1.35 THEN least(100, 60 + least(40, (op - 15) * 0.60 + greatest(0, q - 1.35) * 10)) WHEN over THEN least(100, 50 + least(50, (op - 15) * 0.50))
      WHEN q <= 1.35 AND z <= 1.5 THEN least(25, greatest(dev, 0) * 0.70)
      WHEN s > 0 AND x <= s * 1.02 AND o <= 0 THEN CASE WHEN q <= 3 THEN least(50, raw * 0.65) ELSE least(75, raw * 0.70) END ELSE raw END, 0), 100), 0)::BIGINT AS score,
    CASE WHEN x <= 0 THEN 0.0 WHEN coalesce(peers, 0) < 2 THEN 0.30 ELSE round(least(greatest(0.5 + CASE WHEN peers >= 10 THEN 0.20 WHEN peers >= 5 THEN 0.15 WHEN peers >= 3 THEN 0.05 ELSE -0.05 END + 0.20
      + CASE WHEN s <> 0 AND e <> 0 THEN 0.10 WHEN s <> 0 OR e <> 0 THEN 0.05 ELSE 0 END, 0.20), 1.0), 3) END::DOUBLE AS confidence
  FROM scored1""")


def signals(t):
    return R.cost_signals(t["projects"], t["financials"])


@query("i1_risk_tiers", sql("""SELECT project_id, CASE WHEN overall_risk_score < 30 THEN 'LOW' WHEN overall_risk_score < 60 THEN 'MEDIUM' WHEN overall_risk_score < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS tier,
  CASE WHEN overall_risk_score >= 90 THEN 'CRITICAL' WHEN overall_risk_score >= 70 THEN 'HIGH' WHEN overall_risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS custom_tier FROM risk_scores""", "risk_scores"))
def _(t):
    s = "overall_risk_score"
    return t["risk_scores"].select("project_id", X.risk_level(s).alias("tier"), X.risk_level(s, [(0.0, "LOW"), (40.0, "MEDIUM"), (70.0, "HIGH"), (90.0, "CRITICAL")]).alias("custom_tier"))


@query("i2_engine_results", sql("""SELECT project_id, score, CASE WHEN score < 30 THEN 'LOW' WHEN score < 60 THEN 'MEDIUM' WHEN score < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level, score >= 30 AS triggered, confidence FROM cost_scored""", "cost_scored"))
def _(t):
    return R.cost_anomaly(t).select("project_id", "score", "risk_level", "triggered", "confidence")


@query("i3_cost_signals", sql("SELECT project_id, x AS evaluated_cost, metric AS cost_metric_used, dur AS project_duration_days, CASE WHEN dur > 0 AND x > 0 THEN x / dur END AS cost_per_day FROM cost1", "cost1"))
def _(t):
    return signals(t).select("project_id", F.col("x").alias("evaluated_cost"), "cost_metric_used", "project_duration_days",
                             F.when(F.col("cost_per_day").isNotNull(), F.col("x") / F.col("project_duration_days")).alias("cost_per_day"))


@query("i4_peer_levels", sql("""WITH d AS (SELECT sector, district_name, sum(w) AS n FROM cost1 WHERE x > 0 GROUP BY ALL), s AS (SELECT sector, state_id, sum(w) AS n FROM cost1 WHERE x > 0 GROUP BY ALL), c AS (SELECT sector, sum(w) AS n FROM cost1 WHERE x > 0 GROUP BY ALL),
  j AS (SELECT project_id, d.n - w AS nd, s.n - w AS ns, c.n - w AS nc FROM cost1 JOIN d USING (sector, district_name) JOIN s USING (sector, state_id) JOIN c USING (sector) WHERE x > 0)
  SELECT project_id, CASE WHEN nd >= 600 THEN 'sector_and_district' WHEN ns >= 600 THEN 'sector_and_state' WHEN nc >= 600 THEN 'sector_nationwide' ELSE 'insufficient_peers' END AS peer_scope,
    (CASE WHEN nd >= 600 THEN nd WHEN ns >= 600 THEN ns ELSE nc END)::BIGINT AS peers FROM j""", "cost1"))
def _(t):
    return robust.choose_level(signals(t).filter("x > 0"), robust.LEVELS, 600).select("project_id", "peer_scope", "peers")


@query("i5_leave_one_out_stats", sql("""SELECT project_id, peers, round(med, 4) AS peer_median, round(q1, 4) AS q1, round(q3, 4) AS q3, round(dev, 4) AS deviation_pct, round(percentile, 4) AS percentile, round(mad, 4) AS mad, round(z, 3) AS robust_z FROM metrics""", "metrics"))
def _(t):
    d = R.cost_peers(signals(t)).filter("x > 0")
    r = lambda c, k=4: F.round(c, k).alias(c)
    return d.select("project_id", "peers", r("peer_median"), r("q1"), r("q3"), r("deviation_pct"), r("percentile"), r("mad"), r("robust_z", 3))


@query("i6_cost_scores", sql("SELECT project_id, anomaly_type, score FROM cost_scored", "cost_scored"))
def _(t):
    return R.cost_anomaly(t).select("project_id", F.get_json_object("details", "$.anomaly_type").alias("anomaly_type"), "score")


@query("i7_neutral_outcomes", sql("SELECT anomaly_type, count(*) AS projects, max(score) AS max_score FROM (SELECT CASE WHEN x <= 0 THEN 'MISSING_COST' ELSE 'INSUFFICIENT_PEERS' END AS anomaly_type, 0 AS score FROM cost1) GROUP BY 1", "cost1"))
def _(t):
    d = R.cost_score(R.cost_peers(signals(t), min_peers=10**9), min_peers=10**9)
    return d.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("projects"), F.max("raw_score").cast("bigint").alias("max_score"))


@query("i8_cost_confidence", sql("SELECT project_id, confidence FROM cost_scored", "cost_scored"))
def _(t):
    return R.cost_anomaly(t).select("project_id", "confidence")


# ---- delay --------------------------------------------------------------------------------------------
CTES["delay0"] = (("projects",), f"""
  SELECT *, lower(current_status) AS st, coalesce(work_order_date, sanction_date, recommendation_date) AS start_date, expected_completion_date AS exp, actual_completion_date AS act FROM projects""")
CTES["delay1"] = (("delay0",), f"""
  SELECT *, CASE WHEN exp - start_date < 0 THEN 30 WHEN exp = start_date THEN 1 ELSE exp - start_date END AS planned,
    CASE WHEN st IN ('cancelled','dropped','rejected') THEN 'NOT_APPLICABLE' WHEN exp IS NULL THEN 'MISSING_DATES' WHEN act IS NOT NULL THEN CASE WHEN act > exp THEN 'COMPLETED_LATE' ELSE 'COMPLETED_ON_TIME' END
         WHEN st = 'completed' THEN 'COMPLETED_UNRECORDED_DATE' WHEN exp < {REF} THEN 'ONGOING_OVERDUE' ELSE 'ONGOING_ON_SCHEDULE' END AS cs FROM delay0""")
CTES["delay2"] = (("delay1",), f"SELECT *, CASE cs WHEN 'COMPLETED_LATE' THEN act - exp WHEN 'ONGOING_OVERDUE' THEN {REF} - exp ELSE 0 END AS od FROM delay1")
CTES["delay3"] = (("delay2",), """
  SELECT *, CASE WHEN od <= 30 THEN greatest(1, od / 30 * 29) WHEN od <= 90 THEN 30 + (od - 30) / 60 * 29 WHEN od <= 180 THEN 60 + (od - 90) / 90 * 19 ELSE least(100, 80 + (od - 180) / 185 * 20) END AS base FROM delay2""")
CTES["delay4"] = (("delay3",), """
  SELECT *, CASE WHEN od <= 0 THEN 0 ELSE round_even(least(100, base + CASE WHEN planned > 0 AND od / planned >= 1 THEN 8 WHEN planned > 0 AND od / planned >= 0.5 THEN 4 ELSE 0 END), 0) END::BIGINT AS score,
    CASE WHEN od > 0 AND planned > 0 THEN round(od / planned * 100, 1) ELSE 0 END::DOUBLE AS delay_percentage FROM delay3""")


@query("i14_delay_evaluation", sql("""SELECT project_id, cs AS completion_status, od AS overdue_days, planned AS planned_duration, delay_percentage,
    CASE cs WHEN 'NOT_APPLICABLE' THEN 'Project status is ''' || current_status || '''; schedule delay risk is not applicable.' WHEN 'MISSING_DATES' THEN 'Planned completion date is not recorded in official records; delay cannot be determined.'
      WHEN 'COMPLETED_LATE' THEN 'Completed project finished ' || od || ' days behind scheduled completion date (' || exp || '). Actual completion: ' || act || '.' || CASE WHEN delay_percentage > 10 THEN printf(' (+%.0f%% schedule overrun)', delay_percentage) ELSE '' END
      WHEN 'COMPLETED_ON_TIME' THEN CASE WHEN act < exp THEN 'Completed on schedule (' || (exp - act) || ' days ahead of expected completion date).' ELSE 'Completed exactly on schedule on the expected completion date.' END
      WHEN 'COMPLETED_UNRECORDED_DATE' THEN 'Project is recorded as completed; actual completion date is not documented to verify slippage.'
      WHEN 'ONGOING_OVERDUE' THEN 'Ongoing project is ' || od || ' days overdue beyond planned completion date (' || exp || ' as of 2000-01-01).' || CASE WHEN delay_percentage > 15 THEN printf(' Schedule overrun: +%.0f%%.', delay_percentage) ELSE '' END
      ELSE CASE WHEN exp = DATE '2000-01-01' THEN 'Project is on schedule within contractual timeline (due today on target completion date ' || exp || ').'
        ELSE 'Project is on schedule within contractual timeline (' || (exp - DATE '2000-01-01') || ' days remaining until target completion ' || exp || ').' END END AS reason FROM delay4""".replace("printf(' (+%.0f%% schedule overrun)', delay_percentage)", "' (+' || PCT || '% schedule overrun)'").replace("printf(' Schedule overrun: +%.0f%%.', delay_percentage)", "' Schedule overrun: +' || PCT || '%.'").replace("PCT", "round(delay_percentage, 0)::BIGINT"), "delay4"))
def _(t):
    return R.delay_eval(t["projects"], AS_OF).select("project_id", "completion_status", "overdue_days", "planned_duration", "delay_percentage", "reason")


@query("i15_delay_scores", sql("SELECT project_id, score FROM delay4", "delay4"))
def _(t):
    return R.delay_detection(t, AS_OF).select("project_id", "score")


@query("i16_delay_confidence", sql("SELECT project_id, CASE cs WHEN 'NOT_APPLICABLE' THEN 1.0 WHEN 'MISSING_DATES' THEN 0.0 WHEN 'COMPLETED_UNRECORDED_DATE' THEN 0.5 ELSE CASE WHEN act IS NOT NULL THEN 0.95 ELSE 0.90 END END::DOUBLE AS confidence FROM delay4", "delay4"))
def _(t):
    return R.delay_eval(t["projects"], AS_OF).select("project_id", "confidence")


# ---- mismatch --------------------------------------------------------------------------------------------
CTES["mm0"] = (("projects", "financials", "latest_progress"), """
  SELECT p.project_id, lower(p.current_status) AS st, coalesce(physical_progress_pct, CASE WHEN lower(p.current_status) = 'completed' THEN 100 WHEN lower(p.current_status) IN ('recommended','sanctioned') THEN 0 END)::DOUBLE AS phy,
    coalesce(financial_progress_pct, CASE WHEN sanctioned_amount > 0 THEN least(100, greatest(0, expenditure_amount::DOUBLE / sanctioned_amount::DOUBLE * 100)) END,
      CASE WHEN released_amount > 0 THEN least(100, greatest(0, expenditure_amount::DOUBLE / released_amount::DOUBLE * 100)) END, utilization_rate_pct)::DOUBLE AS fin,
    g.project_id IS NOT NULL AS has_prog, sanctioned_amount IS NOT NULL AS has_sanc
  FROM projects p LEFT JOIN financials f ON p.project_id = f.project_id LEFT JOIN latest_progress g ON p.project_id = g.project_id""")
CTES["mm1"] = (("mm0",), "SELECT *, round(fin, 1) AS fp, round(phy, 1) AS pp, round(round(fin, 1) - round(phy, 1), 1) AS gap FROM mm0")
CTES["mm2"] = (("mm1",), """
  SELECT *, CASE WHEN st = 'cancelled' THEN 'not_applicable' WHEN fp IS NULL AND pp IS NULL THEN 'missing_data' WHEN fp IS NULL THEN 'missing_financial' WHEN pp IS NULL THEN 'missing_physical'
      WHEN abs(gap) <= 10 THEN 'balanced' WHEN gap > 0 THEN 'financial_leading' ELSE 'physical_leading' END AS direction FROM mm1""")
CTES["mm3"] = (("mm2",), """
  SELECT *, round_even(CASE direction WHEN 'balanced' THEN least(29, round_even(abs(gap) / 10 * 29, 0))
      WHEN 'financial_leading' THEN least(100, greatest(30, CASE WHEN gap <= 20 THEN 30 + (gap - 10) / 10 * 29 WHEN gap <= 35 THEN 60 + (gap - 20) / 15 * 19 ELSE 80 + (gap - 35) / 15 * 20 END))
      WHEN 'physical_leading' THEN least(85, greatest(30, CASE WHEN -gap <= 25 THEN 30 + (-gap - 10) / 15 * 19 WHEN -gap <= 45 THEN 50 + (-gap - 25) / 20 * 19 ELSE 70 + (-gap - 45) / 5 * 15 END)) ELSE 0 END, 0)::BIGINT AS score,
    CASE direction WHEN 'not_applicable' THEN 1.0 WHEN 'missing_data' THEN 0.0 WHEN 'missing_financial' THEN 0.30 WHEN 'missing_physical' THEN 0.30
      ELSE CASE WHEN has_prog AND has_sanc THEN 0.95 WHEN has_prog THEN 0.90 WHEN st = 'completed' THEN 0.85 ELSE 0.60 END END::DOUBLE AS confidence FROM mm2""")


@query("i17_progress_values", sql("SELECT project_id, fin AS financial_raw, phy AS physical_raw FROM mm0", "mm0"))
def _(t):
    return R.progress_values(t["projects"], t["financials"], t["progress"]).select("project_id", "financial_raw", "physical_raw")


@query("i18_mismatch_scores", sql("SELECT project_id, direction, gap AS progress_gap, score FROM mm3", "mm3"))
def _(t):
    return R.mismatch_eval(R.progress_values(t["projects"], t["financials"], t["progress"])).select("project_id", "direction", "progress_gap", "score")


@query("i19_mismatch_confidence", sql("SELECT project_id, confidence FROM mm3", "mm3"))
def _(t):
    return R.progress_mismatch(t).select("project_id", "confidence")


# ---- agency -----------------------------------------------------------------------------------------------
CTES["ag0"] = (("projects", "financials", "latest_progress"), f"""
  SELECT p.project_id, lower(trim(implementing_agency)) AS agency_key, trim(implementing_agency) AS agency_name, lower(current_status) AS st, (lower(current_status) = 'completed' OR actual_completion_date IS NOT NULL) AS comp,
    expected_completion_date AS exp, actual_completion_date AS act, CASE WHEN sanctioned_amount > 0 THEN sanctioned_amount::DOUBLE END AS sanc, CASE WHEN released_amount > 0 THEN released_amount::DOUBLE END AS rel,
    expenditure_amount::DOUBLE AS spent, cost_overrun_pct AS o, physical_progress_pct AS pp0, financial_progress_pct AS fp0
  FROM projects p LEFT JOIN financials f ON p.project_id = f.project_id LEFT JOIN latest_progress g ON p.project_id = g.project_id WHERE implementing_agency IS NOT NULL""")
CTES["ag1"] = (("ag0",), f"""
  SELECT *, st <> 'cancelled' AND exp IS NOT NULL AS scheduled, sanc IS NOT NULL AND spent IS NOT NULL AS priced, coalesce(pp0, CASE WHEN comp THEN 100 END) AS phy,
    coalesce(fp0, least(100, greatest(0, spent / sanc * 100)), least(100, greatest(0, spent / rel * 100))) AS fin,
    CASE WHEN rel IS NOT NULL THEN least(150, greatest(0, spent / rel * 100)) END AS util FROM ag0""")
CTES["ag2"] = (("ag1",), f"""
  SELECT *, coalesce(scheduled AND CASE WHEN comp THEN act - exp ELSE {REF} - exp END > 30, false) AS delayed,
    priced AND (coalesce(o > 10, false) OR coalesce(spent > sanc * 1.10, false) OR coalesce(spent > rel * 1.05, false)) AS odd, coalesce(abs(fin - phy) > 15, false) AS mism, phy IS NOT NULL AND fin IS NOT NULL AS measured FROM ag1""")
CTES["ag3"] = (("ag2",), """
  SELECT agency_key, min(agency_name) AS agency_name, count(*) AS n, count(*) FILTER (delayed) AS dl, count(*) FILTER (scheduled) AS sc, count(*) FILTER (odd) AS od, count(*) FILTER (priced) AS pr, count(*) FILTER (mism) AS mi,
    count(*) FILTER (measured) AS me, count(*) FILTER (comp) AS co, count(*) FILTER (delayed::INT + odd::INT + mism::INT >= 2) AS mu, coalesce(round(avg(sanc), 2), 0)::DOUBLE AS average_cost, coalesce(round(quantile_cont(sanc, 0.5)::VARCHAR::DECIMAL(24,8), 2), 0)::DOUBLE AS median_cost,
    coalesce(round(avg(util), 1), 0)::DOUBLE AS average_utilization FROM ag2 GROUP BY 1""")
CTES["ag4"] = (("ag3",), """
  SELECT *, CASE WHEN sc > 0 THEN round(dl / sc, 3) ELSE 0 END::DOUBLE AS delay_rate, CASE WHEN pr > 0 THEN round(od / pr, 3) ELSE 0 END::DOUBLE AS cost_anomaly_rate, CASE WHEN me > 0 THEN round(mi / me, 3) ELSE 0 END::DOUBLE AS mismatch_rate,
    round(co / n * 100, 1) AS completion_rate, round(mu / n, 3) AS high_risk_frequency FROM ag3""")
CTES["ag5"] = (("ag4",), """
  SELECT *, least(40, delay_rate / 0.5 * 20) + least(30, cost_anomaly_rate / 0.3 * 15) + least(25, mismatch_rate / 0.3 * 12.5) + greatest(0, (100 - completion_rate) / 100) * 5
      + CASE WHEN high_risk_frequency >= 0.35 THEN 10 WHEN high_risk_frequency >= 0.20 THEN 5 ELSE 0 END AS s1 FROM ag4""")
CTES["ag6"] = (("ag5",), "SELECT *, CASE WHEN delay_rate >= 0.7 THEN greatest(65, s1 + 10) ELSE s1 END AS s2 FROM ag5")
CTES["ag7"] = (("ag6",), """
  SELECT *, CASE WHEN n < 3 THEN least(15, round_even(delay_rate * 40 + cost_anomaly_rate * 30 + mismatch_rate * 30, 0)) ELSE
      round_even(least(100, CASE WHEN n < 5 THEN least(55, s3) WHEN n < 10 THEN least(75, s3) ELSE s3 END), 0) END::BIGINT AS score,
    CASE WHEN n < 3 THEN round(least(greatest(0.35 * (n / 3), 0.10), 0.35), 2) ELSE round(least(greatest(CASE WHEN (sc + pr + me) / (n * 3) < 0.75 THEN b * greatest(0.5, (sc + pr + me) / (n * 3)) ELSE b END, 0.10), 0.95), 2) END::DOUBLE AS confidence
  FROM (SELECT *, CASE WHEN completion_rate >= 80 AND delay_rate <= 0.15 THEN least(s2, 18) ELSE s2 END AS s3, CASE WHEN n >= 15 THEN 0.95 WHEN n >= 10 THEN 0.90 WHEN n >= 5 THEN 0.85 ELSE 0.60 END::DOUBLE AS b FROM ag6)""")


@query("i20_agency_resolution", sql("SELECT project_id, trim(implementing_agency) AS agency_name, CASE WHEN implementing_agency IS NOT NULL THEN 'implementing_agency' END AS agency_field_used, lower(trim(implementing_agency)) AS agency_key FROM projects", "projects"))
def _(t):
    return R.resolve_agency(t["projects"]).select("project_id", "agency_name", "agency_field_used", "agency_key")


@query("i21_agency_stats", sql("""SELECT agency_key, n AS projects_analyzed, dl AS delayed_count, sc AS scheduled_count, od AS cost_anomaly_count, pr AS financial_count, mi AS mismatch_count, me AS progress_count, co AS completed_count,
  round(average_cost / 1000, 1) AS average_cost_k, round(median_cost / 1000, 1) AS median_cost_k, average_utilization, delay_rate, cost_anomaly_rate, mismatch_rate, completion_rate, high_risk_frequency FROM ag4""", "ag4"))
def _(t):
    return R.agency_table(t, AS_OF).select("agency_key", "projects_analyzed", "delayed_count", "scheduled_count", "cost_anomaly_count", "financial_count", "mismatch_count", "progress_count",
                                           "completed_count", F.round(F.col("average_cost") / 1000, 1).alias("average_cost_k"), F.round(F.col("median_cost") / 1000, 1).alias("median_cost_k"), "average_utilization", "delay_rate", "cost_anomaly_rate", "mismatch_rate", "completion_rate",
                                           "high_risk_frequency")


@query("i22_agency_scores", sql("SELECT project_id, coalesce(score, 0) AS score FROM projects LEFT JOIN ag7 ON lower(trim(implementing_agency)) = agency_key", "projects", "ag7"))
def _(t):
    return R.agency_pattern(t, AS_OF).select("project_id", "score")


@query("i23_agency_confidence_reason", sql("""SELECT agency_key, confidence, n AS projects_analyzed, CASE WHEN n < 3 THEN 'Insufficient' WHEN n < 5 THEN 'Preliminary' WHEN score >= 30 THEN 'Historical' ELSE 'Agency' END AS lead_word FROM ag7""", "ag7"))
def _(t):
    return R.agency_table(t, AS_OF).select("agency_key", F.col("agency_confidence").alias("confidence"), "projects_analyzed", F.split("agency_reason", " ")[0].alias("lead_word"))


@query("f24_agency_portfolio", sql("""SELECT a.project_id, agency_key, current_status, district_name, delayed, odd AS cost_odd, mism AS mismatched, score AS agency_risk_score, n AS projects_analyzed, delay_rate
  FROM ag2 a JOIN ag7 USING (agency_key) JOIN projects p ON p.project_id = a.project_id WHERE agency_key LIKE '%supplier#00000001%'""", "ag2", "ag7", "projects"))
def _(t):
    from civicledger.operators.analytics import agency_projects
    mine = agency_projects(t, "Supplier#00000001")
    flags = R.agency_flags(mine, t["financials"], t["progress"], AS_OF)
    side = R.agency_stats(flags).withColumn("agency_risk_score", R.agency_score())
    return (flags.select("project_id", "agency_key", "delayed", "cost_odd", "mismatched").join(mine.select("project_id", "current_status", "district_name"), "project_id")
            .join(side.select("agency_key", "agency_risk_score", "projects_analyzed", "delay_rate"), "agency_key"))


@query("i24_fund_utilization", sql("""WITH f AS (SELECT project_id, lower(current_status) AS st, coalesce(sanctioned_amount, 0)::DOUBLE AS s, released_amount::DOUBLE AS r, expenditure_amount::DOUBLE AS e FROM projects JOIN financials USING (project_id)),
  g AS (SELECT *, CASE WHEN s > 0 THEN round(e / s, 4) END AS u FROM f),
  h AS (SELECT *, round((u - 1.0) * 100.0, 1) AS op, CASE WHEN r > 0 THEN round((e / r - 1.0) * 100.0, 1) END AS dp FROM g)
  SELECT project_id, u AS utilization_ratio, (CASE WHEN s <= 0 THEN 0 WHEN e > s THEN 75 + least(25, floor(op * 1.5)) WHEN r > 0 AND e > r * 1.02 THEN 65 + least(25, floor(dp * 1.2)) WHEN st = 'completed' AND u < 0.85 THEN 40 + floor((0.85 - u) * 40)
    WHEN st = 'in progress' AND u < 0.25 THEN 45 + floor((0.25 - u) * 100) WHEN st IN ('recommended','sanctioned') AND e = 0 THEN 0 WHEN u >= 0.70 THEN 0 ELSE floor((0.70 - u) * 40) END)::BIGINT AS score FROM h""", "projects", "financials"))
def _(t):
    return R.fund_utilization(t).select("project_id", "utilization_ratio", "score")
