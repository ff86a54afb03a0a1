"""Explanations: evidence, cautious reasons, rankings, decompositions, statements and language checks.

Input rows are one per project and engine: project_id, engine, score, effective_weight, contribution
and details (a JSON text). A project never has more than one row per engine, so per-project arrays
hold at most as many entries as there are engines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from civicledger import fixed_texts as tx, fixed_values as fv
from civicledger.functions import columns as X

fmt = F.format_string
LABEL = {"cost_anomaly": "Cost Anomaly", "duplicate_detection": "Duplicate Detection", "delay_detection": "Delay Detection",
         "progress_mismatch": "Progress Mismatch", "agency_pattern": "Agency Pattern"}
FLAG_LABEL = {"cost_anomaly": "Cost anomaly", "delay_detection": "Delay", "progress_mismatch": "Progress mismatch",
              "duplicate_detection": "Duplicate detection", "agency_pattern": "Agency pattern"}
FLAG_ORDER = list(FLAG_LABEL)


def lookup(d: dict[str, str], key: str = "engine") -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col(key))


def detail(key: str) -> Column:
    return F.try_element_at(F.col("d"), F.lit(key))


def number(key: str) -> Column:
    return detail(key).try_cast("double")


def apart(c: Column) -> Column:
    """The same value, passed through a lambda. A projection that holds one is compiled to many small methods; as part of a whole
    stage the long chains of texts would be one method, which is too large for the JVM to optimize (about ten times slower)."""
    return F.element_at(F.transform(F.array(c), lambda x: x), 1)


def with_details(rows: DataFrame) -> DataFrame:
    return rows.withColumn("d", F.from_json("details", "map<string,string>"))


def extract_evidence(rows: DataFrame) -> DataFrame:
    """Keeps the listed keys of each engine's details; keys an engine does not emit stay absent."""
    allowed = F.create_map(*[x for e, keys in fv.EVIDENCE_KEYS.items() for x in (F.lit(e), F.array(*[F.lit(k) for k in [*keys, "error"]]))])
    rows = with_details(rows)
    return rows.withColumn("evidence", F.map_filter("d", lambda k, v: v.isNotNull() & F.array_contains(F.try_element_at(allowed, F.col("engine")), k)))


def cautious_reason(rows: DataFrame) -> DataFrame:
    """Adds a non-accusatory reason in three bands per engine, grounded in the evidence."""
    rows = extract_evidence(rows)
    e, s = F.col("engine"), F.col("score")
    ev = lambda k: F.try_element_at(F.col("evidence"), F.lit(k))
    opt = lambda c, text: F.when(c.isNotNull(), text).otherwise("")
    t = tx.CAUTIOUS
    dev = F.coalesce(ev("deviation_pct"), ev("cost_ratio"))
    sim = ev("similarity").try_cast("double")
    sim_text = F.concat(F.lit(" ("), F.round(sim * 100, 1).cast("string"), F.lit("% similarity)"))
    days, pct = ev("overdue_days"), ev("delay_percentage")
    day_text = F.when(days.isNotNull() & pct.isNotNull(), fmt(" by %s days (%s%% delay against planned schedule)", days, pct)).when(days.isNotNull(), fmt(" by %s days", days)).otherwise("")
    fin, phy, gap = ev("financial_progress"), ev("physical_progress"), ev("progress_gap")
    gap3 = opt(fin, F.when(phy.isNotNull(), fmt(" (financial: %s%%, physical: %s%%, gap: %s%%)", fin, phy, gap)).otherwise(""))
    rate = ev("delay_rate")
    count = F.coalesce(ev("projects_analyzed"), F.lit("0"))
    high = {"cost_anomaly": fmt(t["cost_anomaly", "high"], opt(dev, fmt(" (%s%% deviation)", dev))),
            "duplicate_detection": fmt(t["duplicate_detection", "high"], opt(sim, sim_text), F.coalesce(ev("matched_project_id"), F.lit("unspecified project"))),
            "delay_detection": fmt(t["delay_detection", "high"], day_text), "progress_mismatch": fmt(t["progress_mismatch", "high"], gap3),
            "agency_pattern": fmt(t["agency_pattern", "high"], F.coalesce(ev("agency_name"), F.lit("Implementing agency")), count, opt(rate, fmt(" (%s%% delay rate)", rate)))}
    mid = {"cost_anomaly": F.lit(t["cost_anomaly", "mid"]), "duplicate_detection": fmt(t["duplicate_detection", "mid"], F.coalesce(ev("matched_project_id"), F.lit("unspecified project"))),
           "delay_detection": fmt(t["delay_detection", "mid"], F.coalesce(days, F.lit("several"))), "progress_mismatch": fmt(t["progress_mismatch", "mid"], opt(gap, fmt(" (%s%% gap)", gap))),
           "agency_pattern": fmt(t["agency_pattern", "mid"], count)}
    out = F.when(apart(ev("error")).isNotNull(), fmt("Engine output unavailable (%s); requires verification.", ev("error")))
    for k in fv.ENGINES:
        out = out.when((e == k) & (s >= 60), high[k]).when((e == k) & (s >= 30), mid[k]).when(e == k, fv.LOW_BAND_REASON[k])
    return rows.withColumn("cautious_reason", out.otherwise("Indicator evaluated within normal operating tolerances.")).drop("d")


def rank_factors(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.col("contribution").desc(), F.col("score").desc(), "engine")
    return rows.withColumn("factor_rank", F.row_number().over(w))


def _factors(rows: DataFrame, fields: list[str]) -> Column:
    return F.array_sort(F.collect_list(F.struct("factor_rank", *fields)))


def risk_summary(rows: DataFrame, overall: DataFrame) -> DataFrame:
    """Narrative summary with the top two elevated drivers. overall: project_id, overall_risk_score, risk_level."""
    r = rank_factors(rows).withColumn("driver", F.concat(lookup(LABEL), fmt(" (%.1f pts)", F.col("contribution"))))
    up = (F.col("score") >= 30) & (F.col("contribution") > 0)
    g = r.groupBy("project_id").agg(F.array_sort(F.collect_list(F.when(up, F.struct("factor_rank", "driver")))).alias("f"))
    d = overall.select("project_id", "overall_risk_score", "risk_level").join(g, "project_id", "left")
    drivers = F.concat_ws(" and ", F.transform(F.slice("f", 1, 2), lambda x: x["driver"]))
    s, tier = F.col("overall_risk_score").cast("double"), F.col("risk_level")
    low = (F.coalesce(F.size("f"), F.lit(0)) <= 0) | (s < 30)
    text = (F.when(low, fmt(tx.SUMMARY["LOW"], s, tier)).when(tier == "CRITICAL", fmt(tx.SUMMARY["CRITICAL"], s, tier, drivers))
            .when(tier == "HIGH", fmt(tx.SUMMARY["HIGH"], s, tier, drivers)).otherwise(fmt(tx.SUMMARY["MEDIUM"], s, tier, drivers)))
    return d.select("project_id", "overall_risk_score", "risk_level", text.alias("summary"))


def recommendations(rows: DataFrame) -> DataFrame:
    """Review actions of elevated factors in rank order, without repeats."""
    r = rank_factors(extract_evidence(rows))
    ev = lambda k: F.try_element_at(F.col("evidence"), F.lit(k))
    e, days = F.col("engine"), ev("overdue_days")
    late = F.when(days.isNotNull() & (days != "0"), fmt(" (%s days overdue)", days)).otherwise("")
    text = (F.when(apart(e) == "cost_anomaly", tx.REVIEW["cost_anomaly"]).when(e == "duplicate_detection", fmt(tx.REVIEW["duplicate_detection"], F.coalesce(ev("matched_project_id"), F.lit("matched project"))))
            .when(e == "delay_detection", fmt(tx.REVIEW["delay_detection"], late)).when(e == "progress_mismatch", tx.REVIEW["progress_mismatch"])
            .otherwise(fmt(tx.REVIEW["agency_pattern"], F.coalesce(ev("agency_name"), F.lit("executing agency")))))
    up = (F.col("score") >= 30) & (F.col("contribution") > 0)
    g = r.withColumn("text", text).groupBy("project_id").agg(F.array_sort(F.collect_list(F.when(up, F.struct("factor_rank", "text")))).alias("f"))
    acts = F.array_distinct(F.transform("f", lambda x: x["text"]))
    return g.select("project_id", F.when(F.size("f") == 0, F.array(F.lit(fv.ROUTINE_MONITORING))).otherwise(acts).alias("recommendations"))


def justification(overall: DataFrame, remarks: str = "remarks") -> DataFrame:
    note = F.trim(F.coalesce(F.col(remarks), F.lit("")))
    has = F.length(note) > 5
    return overall.select("project_id", F.when(has, "DOCUMENTED").otherwise("MISSING").alias("justification_status"),
                          ((F.col("overall_risk_score") >= 30) & ~has).alias("missing_or_insufficient"),
                          F.when((F.col("overall_risk_score") >= 30) & ~has, "Elevated risk signals without documented administrative justification in official records")
                          .when(has, fmt("Documented justification recorded: '%s'", F.substring(note, 1, 60))).otherwise("Low composite risk; standard quarterly progress tracking").alias("actual_value"))


# ---- statements -----------------------------------------------------------------------------------

def evidence_statements(rows: DataFrame) -> DataFrame:
    """Factual sentences, one row per statement (a cost factor may yield two)."""
    rows = with_details(rows)
    e = F.col("engine")
    cost = F.coalesce(number("evaluated_cost"), number("project_expenditure"), F.lit(0.0))
    med, sanc, over = number("peer_median"), number("sanctioned_amount"), number("cost_overrun_pct")
    priced = (cost != 0) & (med != 0)
    s1 = F.when(priced, F.concat(F.lit("Cost is "), X.fmt_mult(cost / med), F.lit(" peer median.")))
    pct = F.coalesce(over, F.greatest(F.lit(0.0), (cost - sanc) / sanc * 100.0))
    show = (sanc != 0) & ((F.coalesce(over, F.lit(0.0)) != 0) | (cost > sanc))
    s2 = F.when(show, F.when(pct > 0, F.concat(F.lit("Expenditure exceeds sanctioned amount by "), X.fmt_pct(pct, 1, False), F.lit("."))).otherwise("Expenditure is within approved sanction."))
    days = F.coalesce(number("overdue_days"), number("delay_days"), F.lit(0.0))
    s3 = (F.when(days > 0, F.concat(F.lit("Project is delayed by "), X.fmt_days(days), F.lit("."))).when(days == 0, "Project is on schedule.")
          .otherwise(F.concat(F.lit("Project is ahead of schedule by "), X.fmt_days(F.abs(days)), F.lit("."))))
    fp, pp = F.coalesce(number("financial_progress"), F.lit(0.0)), F.coalesce(number("physical_progress"), F.lit(0.0))
    ratio = (fp > 0) & (fp <= 1) & (pp <= 1)
    f2 = F.when(ratio, fp * 100).otherwise(fp)
    p2 = F.when((pp > 0) & (pp <= 1) & (f2 > 1), pp * 100).otherwise(pp)
    gap = X.fmt_points(F.round(F.abs(f2 - p2), 2))
    s4 = (F.when(f2 > p2, F.concat(F.lit("Financial progress exceeds physical progress by "), gap, F.lit("."))).when(p2 > f2, F.concat(F.lit("Physical progress exceeds financial progress by "), gap, F.lit(".")))
          .otherwise("Financial progress matches physical progress."))
    sim = F.coalesce(number("similarity"), number("raw_similarity"), F.lit(0.0))
    thr = F.when(sim >= 0.85, 0.85).otherwise(0.60)
    s5 = F.concat(F.lit("Project description has "), X.fmt_pct(sim, 0, True), F.lit(" similarity with project "), F.coalesce(detail("matched_project_id"), F.lit("XYZ")), F.lit(", "),
                  F.when(sim >= thr, "exceeding").otherwise("within"), F.lit(" the "), X.fmt_pct(thr, 0, True), F.lit(" duplicate threshold."))
    name, n, rate = F.coalesce(detail("agency_name"), F.lit("Implementing Agency")), F.coalesce(number("projects_analyzed"), F.lit(0.0)).cast("int"), F.coalesce(number("delay_rate"), F.lit(0.0))
    few = F.coalesce(detail("insufficient_history") == "true", n < 3) | (n < 3)
    s6 = F.when(few, fmt("Implementing agency %s has only %d historical projects recorded (minimum 3 required for statistical pattern analysis).", name, n)).otherwise(
        F.concat(fmt("Implementing agency %s has a ", name), X.fmt_pct(rate, 0, True), fmt(" historical delay rate across %d ", n), F.lit("projects, "),
                 F.when(rate > 0.25, "exceeding").otherwise("within"), F.lit(" the 25% benchmark.")))
    st = lambda key, text: F.when(text.isNotNull(), F.struct(F.lit(key).alias("metric_key"), text.alias("statement")))
    arr = (F.when(e == "cost_anomaly", F.array(st("cost_multiplier", s1), st("cost_overrun_pct", s2))).when(e == "delay_detection", F.array(st("delay_days", s3)))
           .when(e == "progress_mismatch", F.array(st("progress_gap", s4))).when(e == "duplicate_detection", F.array(st("similarity_score", s5))).otherwise(F.array(st("agency_delay_rate", s6))))
    return rows.select("project_id", "engine", "score", F.explode(F.array_compact(arr)).alias("s")).select("project_id", "engine", "score", "s.*")


def evidence_rows(rows: DataFrame, *carry: str) -> DataFrame:
    """Evidence with actual value, reference value and unit, one row per project and engine, next to the
    ``carry`` columns of the same row."""
    rows = with_details(rows)
    e = F.col("engine")
    g = lambda c: F.regexp_replace(F.round(c, 1).cast("string"), r"\.0$", "")
    c, m = F.coalesce(number("evaluated_cost"), number("project_expenditure"), number("sanctioned_amount")), number("peer_median")
    unit = F.when((c >= 1e7) | (m >= 1e7), "crore").when((c >= 1e5) | (m >= 1e5), "lakh").otherwise("INR")
    scale = F.when(unit == "crore", F.when(c >= 1e7, 1e7).otherwise(1.0)).when(unit == "lakh", F.when(c >= 1e5, 1e5).otherwise(1.0)).otherwise(1.0)
    rated = c.isNotNull() & (m > 0)
    cost_text = (F.when(rated & (c / m >= 1), fmt("Cost is %.2f× peer median.", c / m)).when(rated, F.concat(F.lit("Cost is "), F.round(c / m * 100, 1).cast("string"), F.lit("% of peer median.")))
                 .when(c.isNotNull(), "Project cost known, peer median baseline unavailable.").otherwise("Project cost is within expected category benchmarks."))
    days = F.coalesce(number("overdue_days"), number("delay_days")).cast("int")
    delay_text = (F.when(days > 0, fmt("Project is delayed by %d days.", days)).when(days == 0, "Project is on schedule.").when(days < 0, fmt("Project is ahead of schedule by %d days.", F.abs(days)))
                  .otherwise("Project execution timeline is within planned milestones."))
    fp, pp = number("financial_progress"), number("physical_progress")
    diff = g(F.abs(fp - pp))
    gap_text = (F.when(fp > pp, F.concat(F.lit("Financial progress exceeds physical progress by "), diff, F.lit(" percentage points.")))
                .when(pp > fp, F.concat(F.lit("Physical progress exceeds financial progress by "), diff, F.lit(" percentage points.")))
                .when(fp == pp, "Financial progress matches physical progress.").otherwise("Financial expenditure and physical milestone progress are aligned."))
    sim = F.coalesce(number("similarity"), number("adjusted_similarity"), number("raw_similarity"))
    sim_pct = F.round(F.when(sim <= 1, sim * 100).otherwise(sim), 1)
    dup_text = F.when(sim.isNotNull(), F.concat(F.lit("Project description has "), g(sim_pct), F.lit("% similarity with project "), F.coalesce(detail("matched_project_id"), F.lit("XYZ")), F.lit(", "),
                                                F.when(sim_pct >= 85, "exceeding").otherwise("within"), F.lit(" the 85% duplicate threshold."))).otherwise("No duplicate project descriptions or overlapping work items identified.")
    name, n, rate = F.coalesce(detail("agency_name"), F.lit("implementing agency")), F.coalesce(number("projects_analyzed"), F.lit(0.0)), number("delay_rate")
    few = F.coalesce(detail("insufficient_history") == "true", F.lit(False))
    rate_pct = F.round(F.when(rate <= 1, rate * 100).otherwise(rate), 1)
    ag_text = (F.when(few, fmt("Agency '%s' has insufficient historical project records (%d projects).", name, n.cast("int")))
               .when(rate.isNotNull(), F.concat(fmt("Agency '%s' historical delay rate is ", name), g(rate_pct), fmt("%% across %d projects.", n.cast("int"))))
               .otherwise("Implementing agency historical track record is within normal parameters."))
    pick = lambda cost, delay, gap_, dup, ag: F.when(apart(e) == "cost_anomaly", cost).when(e == "delay_detection", delay).when(e == "progress_mismatch", gap_).when(e == "duplicate_detection", dup).otherwise(ag)
    return rows.select(
        "project_id", "engine", *carry, pick(cost_text, delay_text, gap_text, dup_text, ag_text).alias("text"),
        pick(F.round(c / scale, 2), F.coalesce(days.cast("double"), F.lit(0.0)), F.round(fp, 1), F.coalesce(sim_pct, F.lit(0.0)), F.when(few, n).otherwise(F.coalesce(rate_pct, F.lit(0.0)))).alias("actual_value"),
        pick(F.round(m / scale, 2), F.lit(0.0), F.round(pp, 1), F.lit(85.0), F.when(few, 3.0).otherwise(50.0)).alias("reference_value"),
        pick(F.when(c.isNotNull(), unit), F.lit("days"), F.lit("percentage points"), F.lit("%"), F.when(few, "projects").otherwise("%")).alias("unit"))


def why_flagged(rows: DataFrame, overall: DataFrame) -> DataFrame:
    """Triggered factors with evidence lines and contribution points, as lists and as text. A stored
    ``triggered`` flag decides where there is one, else a score of 30; factors below 20 never show."""
    pos = F.create_map(*[x for i, k in enumerate(FLAG_ORDER) for x in (F.lit(k), F.lit(i))])
    flag = F.coalesce("triggered", F.col("score") >= 30) if "triggered" in rows.columns else F.col("score") >= 30
    trig = rows.filter(flag & (F.col("score") >= 20))
    st = evidence_statements(trig).withColumn("line", F.regexp_replace(F.regexp_replace("statement", r"\.$", ""), "^Project is delayed by ", "Delayed by "))
    st = st.withColumn("k", pos[F.col("engine")]).groupBy("project_id").agg(F.array_sort(F.collect_set(F.struct("k", "metric_key", "line"))).alias("ev"))
    pts = trig.withColumns({"k": pos[F.col("engine")], "label": lookup(FLAG_LABEL), "pts": fmt("%.1f points", F.round(F.col("score") * F.col("effective_weight"), 1))})
    f = pts.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("k", "label", "pts"))).alias("f"))
    d = overall.select("project_id", "overall_risk_score", X.normalize_tier("risk_level").alias("overall_risk")).join(f, "project_id", "left").join(st, "project_id", "left")
    flagged = F.coalesce(F.size("f") > 0, F.lit(False))
    nl = lambda arr: F.array_join(arr, "\n")
    text = F.when(flagged, F.concat(F.lit("WHY WAS THIS FLAGGED?\n\nTriggered factors:\n"), nl(F.transform("f", lambda x: F.concat(F.lit("✓ "), x["label"]))), F.lit("\n\nEvidence:\n"),
                                    nl(F.transform("ev", lambda x: F.concat(F.lit("• "), x["line"]))), F.lit("\n\nRisk contribution:\n"),
                                    nl(F.transform("f", lambda x: F.concat(F.lit("• "), x["label"], F.lit(": "), x["pts"]))), F.lit("\n\nOverall risk:\n"), F.col("overall_risk"))).otherwise(
        F.concat(F.lit("WHY WAS THIS FLAGGED?\n\n" + fv.NOTHING_FLAGGED + "\n\nOverall risk:\n"), F.col("overall_risk")))
    return d.select("project_id", "overall_risk", flagged.alias("is_flagged"), F.transform("f", lambda x: x["label"]).alias("triggered_factors"),
                    F.transform("ev", lambda x: x["line"]).alias("evidence"), F.transform("f", lambda x: F.concat(x["label"], F.lit(": "), x["pts"])).alias("risk_contributions"),
                    F.when(~flagged, fv.NOTHING_FLAGGED).alias("message"), text.alias("formatted_text"))


# ---- decomposition and structured explanation -----------------------------------------------------

def decompose(rows: DataFrame, overall: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Contribution and share of each engine, with the total checked against the overall score."""
    d = rows.join(overall.select("project_id", F.round(F.col("overall_risk_score").cast("double"), 1).alias("final_score")), "project_id").withColumn(
        "weighted_contribution", F.round(F.col("score") * F.col("effective_weight"), 1))
    c, fs = F.col("weighted_contribution"), F.col("final_score")
    total = F.round(F.sum(c).over(Window.partitionBy("project_id")), 1)
    return d.select("project_id", "engine", lookup(fv.ENGINE_SHORT).alias("detector_name"), F.round("score", 1).alias("detector_score"), F.round("effective_weight", 4).alias("effective_weight"),
                    "weighted_contribution", X.safe_pct(c, fs, 1).alias("percentage_of_total"), "final_score", total.alias("total_contributions"),
                    (F.round(F.abs(total - fs), 2) <= tolerance).alias("reconciled"))


def decompose_stored(scores: DataFrame, factors: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """The same from stored score and factor rows; the factor weight is the effective weight."""
    f = factors.filter("engine_name is not null").select("project_id", F.when(F.col("engine_name") == "delay", "delay_detection").otherwise(F.col("engine_name")).alias("engine"),
                                                         F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
                                                         F.coalesce(F.col("factor_weight").cast("double"), F.lit(0.0)).alias("effective_weight"))
    return decompose(f, scores, tolerance)


def explain(rows: DataFrame, overall: DataFrame, only_triggered: bool = False) -> DataFrame:
    """Project explanation: summary sentence and the factors (triggered first) with their evidence."""
    d = evidence_rows(rows, "score", "effective_weight").withColumn("evidence", F.struct("text", "actual_value", "reference_value", "unit")).withColumns({
        "triggered": F.col("score") >= 30, "contribution": F.round(F.col("score") * F.col("effective_weight"), 1), "severity": F.lower(X.risk_level("score")),
        "k": F.create_map(*[x for i, e in enumerate(FLAG_ORDER) for x in (F.lit(e), F.lit(i))])[F.col("engine")], "word": lookup(fv.SUMMARY_WORDS)})
    entry = F.struct((~F.col("triggered")).alias("calm"), (-F.col("contribution")).alias("neg"), "k", "engine", "severity", "contribution", "score", "evidence")
    g = d.groupBy("project_id").agg(F.array_sort(F.collect_list(F.when(F.col("triggered") | F.lit(not only_triggered), entry))).alias("f"),
                                    F.array_sort(F.collect_list(F.when(F.col("triggered"), F.struct("k", "word")))).alias("w"))
    words = F.transform("w", lambda x: x["word"])
    text = F.when(F.size("w") == 0, fv.NOTHING_FLAGGED).otherwise(F.concat(F.lit("Project flagged due to "), X.oxford_join(words), F.lit(".")))
    return (overall.select("project_id", F.round(F.col("overall_risk_score").cast("double"), 1).alias("risk_score"), X.normalize_tier("risk_level").alias("risk_level"))
            .join(g, "project_id").select("project_id", "risk_score", "risk_level", text.alias("summary"),
                                          F.transform("f", lambda x: F.struct(x["engine"], x["severity"], x["contribution"], x["score"], x["evidence"])).alias("factors")))


def structured_explanation(rows: DataFrame, overall: DataFrame) -> DataFrame:
    """Factors by contribution with shares, triggered count, recommendations and summary."""
    s = F.col("overall_risk_score").cast("double")
    d = rank_factors(rows.join(overall.select("project_id", "overall_risk_score"), "project_id").withColumn("percentage_of_total", X.safe_pct("contribution", s, 1)))
    g = d.groupBy("project_id").agg(_factors(d, ["engine", "score", "contribution", "percentage_of_total"]).alias("factors"), F.count_if(F.col("score") >= 30).alias("triggered_detectors_count"))
    return g.join(recommendations(rows), "project_id").join(risk_summary(rows, overall), "project_id")


def factor_details(factors: DataFrame) -> DataFrame:
    """Stored factor rows with the score falling back to weight x 100 and the contribution."""
    s = F.coalesce(F.col("score").cast("double"), F.col("factor_weight").cast("double") * 100)
    return factors.select("project_id", "factor_name", "engine_name", s.alias("score"), F.round(s * F.col("factor_weight").cast("double"), 2).alias("contribution"), "factor_impact")


def check_language(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.lower(col).rlike("|".join(fv.FORBIDDEN_WORDS))).alias("violations"))
