"""Filtered portfolio analytics: summaries, rankings, histograms, trends and engine statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from civicledger import fixed_values as fv
from civicledger.functions import columns as X
from civicledger.operators import views as V

ONGOING = ["In Progress", "Work Order Issued", "Sanctioned"]


def project_filters(state=None, district=None, risk_level=None, status=None, sector=None, financial_year=None) -> Column:
    """One predicate from optional filters; blank and 'all' are ignored."""
    out = F.lit(True)
    for col, val in (("state_name", state), ("district_name", district), ("current_status", status), ("sector", sector)):
        if val and val.strip() and val.lower() != "all":
            out = out & (F.lower(col) == val.strip().lower())
    if financial_year and financial_year.strip() and financial_year.lower() != "all":
        out = out & (F.col("financial_year") == financial_year.strip())
    tier = (risk_level or "").strip().upper().replace("MODERATE", "MEDIUM")
    if tier in fv.ENGINE_TIERS:
        out = out & X.tier_match(tier, "risk_level", "overall_risk_score")
    return out


def portfolio(t, *, money=False, risk=True, features=False, engine: str | None = None, progress=False,
              extra: tuple[str, ...] = ()) -> DataFrame:
    """Projects with state names and only the side tables a query asks for."""
    p = t["projects"].select("project_id", "state_id", "district_name", "sector", "current_status", "financial_year", *extra)
    df = p.join(t["states"].select("state_id", "state_name"), "state_id")
    if money:
        df = df.join(t["financials"].select("project_id", "recommended_amount", "sanctioned_amount", "released_amount",
                                            "expenditure_amount", "unspent_balance"), "project_id", "left")
    if risk:
        df = df.join(t["risk_scores"].select("project_id", "overall_risk_score", "risk_level"), "project_id", "left")
    if features:
        df = df.join(t["project_features"].select("project_id", "delay_days", "is_delayed", "cost_deviation"), "project_id", "left")
    if progress:
        df = df.join(V.latest_progress(t["progress"]).select("project_id", "physical_progress_pct", "days_delayed",
                                                             "milestone_status"), "project_id", "left")
    if engine:
        rf = t["risk_factors"].filter(F.col("engine_name") == engine).select(
            "project_id", F.col("score").alias("engine_score"), F.col("reason").alias("engine_reason"), "details")
        df = df.join(rf, "project_id", "left")
    return df


def _sum0(c):
    return F.coalesce(F.sum(c), F.lit(0))


def _avg0(c, digits=2):
    return F.coalesce(F.round(F.avg(c), digits), F.lit(0.0))


def _utilization():
    """Spent over released, else over sanctioned, else 0."""
    e, r, s = (F.col(c).cast("double") for c in ("total_expenditure", "__rel", "total_sanctioned"))
    return F.when(r > 0, F.round(e / r * 100, 2)).when(s > 0, F.round(e / s * 100, 2)).otherwise(0.0)


def analytics_summary(t) -> DataFrame:
    st = F.col("current_status")
    df = portfolio(t, money=True, risk=False, progress=True)
    out = df.agg(
        F.count(F.lit(1)).alias("total_projects"), F.count_if(st == "Completed").alias("completed_projects"),
        F.count_if(st == "In Progress").alias("in_progress_projects"), F.count_if(st.isin(ONGOING)).alias("ongoing_projects"),
        F.count_if(st == "Stalled").alias("stalled_projects"), _sum0("recommended_amount").alias("total_allocated_amount"),
        _sum0("sanctioned_amount").alias("total_sanctioned_amount"), _sum0("released_amount").alias("total_released_amount"),
        _sum0("expenditure_amount").alias("total_expenditure_amount"), _sum0("unspent_balance").alias("total_unspent_balance"),
        _avg0("physical_progress_pct").alias("average_progress"),
        F.count_if((F.col("days_delayed") > 0) | F.col("milestone_status").isin("Delayed", "Critical") | (st == "Stalled"))
        .alias("delayed_projects"))
    return out.withColumn("overall_utilization_pct", X.safe_pct("total_expenditure_amount", "total_released_amount"))


def risk_distribution(t) -> DataFrame:
    """Stored tier counts, zero-filled for the four tiers; one fixed-size row is exploded."""
    r = t["risk_scores"].agg(*[F.count_if(F.col("risk_level") == lv).alias(lv) for lv in fv.STORED_TIERS])
    return r.select(F.explode(F.array(*[F.struct(F.lit(lv).alias("risk_level"), F.col(lv).alias("projects"))
                                        for lv in fv.STORED_TIERS])).alias("x")).select("x.*")


def status_distribution(t) -> DataFrame:
    return t["projects"].groupBy("current_status").agg(F.count(F.lit(1)).alias("projects"))


def _rollup(t, keys: list[str]) -> DataFrame:
    st = F.col("current_status")
    return portfolio(t, money=True, risk=False, progress=True).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_projects"), F.count_if(st == "Completed").alias("completed_projects"),
        F.count_if(st.isin(ONGOING)).alias("ongoing_projects"), _sum0("sanctioned_amount").alias("total_sanctioned"),
        _sum0("released_amount").alias("total_released"), _sum0("expenditure_amount").alias("total_expenditure"),
        _avg0("physical_progress_pct").alias("avg_progress_pct"))


def state_aggregations(t) -> DataFrame:
    return _rollup(t, ["state_id", "state_name"])


def district_aggregations(t) -> DataFrame:
    return _rollup(t, ["district_name", "state_name"]).drop("total_released")


def kpis(t) -> DataFrame:
    """Portfolio KPI row. The two view counts come from the same pass over the overview."""
    st = F.col("current_status")
    v = V.project_overview(t)
    late = (F.col("days_delayed") > 0) | F.col("milestone_status").isin("Delayed", "Critical") | (st == "Stalled")
    risky = (F.col("overall_risk_score") >= 40) | F.col("risk_level").isin("High", "Critical")
    out = v.agg(F.count(F.lit(1)).alias("total_projects"), *[_sum0(f"{c}_amount").alias(f"__{c}")
                for c in ("sanctioned", "released", "expenditure")],
                F.count_if(st == "Completed").alias("completed_projects_count"),
                F.count_if(st == "In Progress").alias("in_progress_projects_count"),
                F.count_if(st == "Stalled").alias("stalled_projects_count"),
                F.count_if(late).alias("delayed_projects_count"), F.count_if(risky).alias("high_risk_projects_count"))
    for c in ("sanctioned", "released", "expenditure"):
        out = out.withColumn(f"total_{c}_cr", X.to_crore(f"__{c}"))
    return out.withColumn("overall_utilization_pct", X.safe_pct("__expenditure", "__released")).drop(
        "__sanctioned", "__released", "__expenditure")


def sector_summary(t) -> DataFrame:
    v = V.sector_financial_summary(t)
    num = [c for c in v.columns if c != "sector"]
    return v.select("sector", *[F.coalesce(c, F.lit(0)).alias(c) for c in num]).orderBy(
        F.col("total_sanctioned_amount").desc(), "sector")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def delayed_list(t, limit=50, offset=0) -> DataFrame:
    return page(V.delayed_projects(t), V.delayed_order(), limit, offset)


def high_risk_list(t, min_score: float | None = None, limit=50, offset=0) -> DataFrame:
    """Top rows are picked before factor lists are attached, so only those lists are built."""
    v = V.project_overview(t).filter((F.col("overall_risk_score") >= 40) | F.col("risk_level").isin("High", "Critical"))
    if min_score is not None:
        v = v.filter(F.col("overall_risk_score") >= min_score)
    top = page(v, [F.col("overall_risk_score").desc_nulls_first(), F.col("project_id")], limit, offset)
    top = top.select("project_id", "project_code", "project_title", "state_name", "district_name", "sector",
                     "current_status", "overall_risk_score", "risk_level", "confidence_score", "days_delayed")
    factors = V.factor_list(t["risk_factors"].join(top.select("project_id"), "project_id", "left_semi"))
    return top.join(factors, "project_id", "left")


def missing_info_list(t, limit=50, offset=0) -> DataFrame:
    return page(V.missing_information(t), [F.col("missing_fields_count").desc(), F.col("project_id")], limit, offset)


def _band_counts() -> list[Column]:
    return [F.count_if(X.tier_match(tier, "risk_level", "overall_risk_score")).alias(name)
            for tier, name in (("CRITICAL", "critical_count"), ("HIGH", "high_count"), ("MEDIUM", "moderate_count"), ("LOW", "low_count"))]


def overview(t, **filters) -> DataFrame:
    """Executive figures of the filtered portfolio; a project may count in two tiers."""
    st, dd = F.col("current_status"), F.col("delay_days")
    df = portfolio(t, money=True, features=True).filter(project_filters(**filters))
    out = df.agg(
        F.count(F.lit(1)).alias("total_projects"), *_band_counts(), _avg0("overall_risk_score").alias("avg_risk_score"),
        F.count_if((F.col("overall_risk_score") >= 40) | F.col("is_delayed") | (F.col("cost_deviation") > 0)).alias("flagged_count"),
        _sum0("sanctioned_amount").alias("total_sanctioned"), _sum0("expenditure_amount").alias("total_expenditure"),
        F.sum("released_amount").alias("__rel"),
        F.count_if((dd > 0) | F.col("is_delayed") | (st == "Stalled")).alias("delayed_count"),
        _avg0(F.when(dd > 0, dd), 1).alias("avg_delay_days"))
    return (out.withColumn("overall_utilization_pct", _utilization())
            .withColumn("flagged_pct", X.safe_pct("flagged_count", "total_projects", 1)).drop("__rel"))


def risk_distribution_filtered(t, **filters) -> DataFrame:
    """Tier counts with shares, one row per tier."""
    df = portfolio(t).filter(project_filters(**filters))
    a = df.agg(F.count(F.lit(1)).alias("total_projects"), *_band_counts(), _avg0("overall_risk_score").alias("average_overall_score"))
    tiers = F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), F.col(c).alias("projects")) for n, c in (
        ("LOW", "low_count"), ("MEDIUM", "moderate_count"), ("HIGH", "high_count"), ("CRITICAL", "critical_count"))])).alias("x")
    return (a.select("total_projects", "average_overall_score", tiers).select("x.*", "total_projects", "average_overall_score")
            .withColumn("percentage", X.safe_pct("projects", "total_projects")))


def engine_averages(t, **filters) -> DataFrame:
    df = portfolio(t).filter(project_filters(**filters)).select("project_id")
    return (t["risk_factors"].filter("engine_name is not null").join(df, "project_id")
            .groupBy("engine_name").agg(F.round(F.avg("score"), 2).alias("avg_score")))


def _metric(name: str, table: dict[str, tuple[str, ...]], default: str) -> str:
    return next((col for col, names in table.items() if (name or "").lower() in names), default)


def state_rollup(t, **filters) -> DataFrame:
    df = portfolio(t, money=True, features=True, engine="cost_anomaly").filter(project_filters(**filters))
    dd = F.col("delay_days")
    return df.groupBy("state_id", "state_name").agg(
        F.count(F.lit(1)).alias("total_projects"),
        F.count_if(X.tier_match("HIGH", "risk_level", "overall_risk_score")).alias("high_risk_projects"),
        F.count_if(X.tier_match("CRITICAL", "risk_level", "overall_risk_score")).alias("critical_risk_projects"),
        _avg0("overall_risk_score").alias("average_risk_score"),
        _avg0(F.when(dd > 0, dd).otherwise(0), 1).alias("average_delay_days"),
        F.count_if((F.col("engine_score") >= 40) | (F.col("cost_deviation") > 0)).alias("cost_anomaly_count"),
        _sum0("sanctioned_amount").alias("total_sanctioned"), _sum0("expenditure_amount").alias("total_expenditure"),
        F.sum("released_amount").alias("__rel")).withColumn("utilization_pct", _utilization()).drop("__rel")


def states_analytics(t, metric="projects", limit=36, **filters) -> DataFrame:
    g = state_rollup(t, **filters)
    key = _metric(metric, {"average_risk_score": ("risk_score", "risk"),
                           "average_delay_days": ("delay", "delays", "average_delay_days"),
                           "cost_anomaly_count": ("cost_anomaly", "cost_anomalies"),
                           "total_sanctioned": ("sanctioned", "funds", "total_sanctioned"),
                           "critical_risk_projects": ("critical", "critical_risk_projects"),
                           "high_risk_projects": ("high_risk", "high_risk_projects")}, "total_projects")
    second = "total_sanctioned" if key == "total_projects" else "total_projects"
    return page(g, [F.col(key).desc(), F.col(second).desc(), F.col("state_id")], limit)


def districts_analytics(t, sort_by="projects", limit=15, **filters) -> DataFrame:
    df = portfolio(t, money=True, features=True).filter(project_filters(**filters) & F.col("district_name").isNotNull())
    dd = F.col("delay_days")
    g = df.groupBy("district_name", "state_name").agg(
        F.count(F.lit(1)).alias("total_projects"),
        F.count_if(X.tier_match("HIGH", "risk_level", "overall_risk_score")).alias("high_risk_projects"),
        F.count_if(X.tier_match("CRITICAL", "risk_level", "overall_risk_score")).alias("critical_risk_projects"),
        _avg0("overall_risk_score").alias("average_risk_score"),
        _avg0(F.when(dd > 0, dd).otherwise(0), 1).alias("average_delay_days"),
        _sum0("sanctioned_amount").alias("total_sanctioned"), _sum0("expenditure_amount").alias("total_expenditure"))
    s = (sort_by or "").lower()
    lead = {"risk_score": "average_risk_score", "risk": "average_risk_score", "delay": "average_delay_days",
            "delays": "average_delay_days", "sanctioned": "total_sanctioned", "funds": "total_sanctioned"}.get(s)
    if s in ("critical", "high_risk"):
        order = [(F.col("critical_risk_projects") + F.col("high_risk_projects")).desc(), F.col("total_projects").desc()]
    elif lead:
        order = [F.col(lead).desc(), F.col("total_projects").desc()]
    else:
        order = [F.col("total_projects").desc(), F.col("total_sanctioned").desc()]
    return page(g, [*order, F.col("district_name"), F.col("state_name")], limit)


def _project_delays(t, **filters) -> DataFrame:
    df = portfolio(t, features=True, engine="delay_detection", extra=("project_title", "expected_completion_date")).filter(project_filters(**filters))
    own = F.greatest(F.lit(0), F.coalesce("delay_days", F.lit(0)))
    overdue = F.get_json_object("details", "$.overdue_days").try_cast("int")
    days = F.when(F.lower("current_status") == "completed", own).otherwise(F.coalesce(overdue, own))
    return df.withColumn("days_delayed", days).withColumn("risk_score", F.coalesce("overall_risk_score", F.lit(0.0)))


DELAY_BUCKETS = ["0 days", "1-30 days", "31-90 days", "91-180 days", "181-365 days", "365+ days"]


def _zero_filled(df: DataFrame, bucket: Column, labels: list[str], extra: list[Column]) -> DataFrame:
    a = df.agg(*[F.count_if(bucket == lab).alias(f"__b{i}") for i, lab in enumerate(labels)], *extra)
    rest = [c for c in a.columns if not c.startswith("__b")]
    rows = F.explode(F.array(*[F.struct(F.lit(lab).alias("bucket"), F.col(f"__b{i}").alias("projects"))
                               for i, lab in enumerate(labels)])).alias("x")
    return a.select(rows, *rest).select("x.*", *rest)


def delay_histogram(t, **filters) -> DataFrame:
    d = F.col("days_delayed")
    bucket = (F.when(d <= 0, "0 days").when(d <= 30, "1-30 days").when(d <= 90, "31-90 days").when(d <= 180, "91-180 days")
              .when(d <= 365, "181-365 days").otherwise("365+ days"))
    return _zero_filled(_project_delays(t, **filters), bucket, DELAY_BUCKETS, [
        F.count(F.lit(1)).alias("total_projects_assessed"), F.count_if(d <= 0).alias("on_time_count"),
        F.count_if(d > 0).alias("delayed_count"), F.count_if(d > 90).alias("severely_delayed_count"),
        F.coalesce(F.round(F.avg(F.when(d > 0, d)), 1), F.lit(0.0)).alias("average_delay_days"),
        F.coalesce(F.max(F.when(d > 0, d)), F.lit(0)).alias("max_delay_days")])


def top_delayed(t, k=10, **filters) -> DataFrame:
    return page(_project_delays(t, **filters).select("project_id", "project_title", "state_name", "district_name", "sector",
                                                     "days_delayed", "expected_completion_date", "current_status", "risk_score"),
                [F.col("days_delayed").desc(), F.col("risk_score").desc(), F.col("project_id")], k)


def _project_deviations(t, **filters) -> DataFrame:
    df = portfolio(t, money=True, engine="cost_anomaly", extra=("project_title",)).filter(project_filters(**filters))
    num = lambda key: F.get_json_object("details", f"$.{key}").try_cast("double")
    return df.select(
        "project_id", "project_title", "state_name", "district_name", "sector", F.coalesce("engine_score", F.lit(0.0)).alias("score"),
        F.coalesce(num("deviation_percentage"), F.lit(0.0)).alias("dev"),
        F.coalesce(num("evaluated_cost"), F.col("expenditure_amount").cast("double"), F.lit(0.0)).alias("evaluated_cost"),
        F.coalesce(num("peer_median"), F.col("sanctioned_amount").cast("double"), F.lit(0.0)).alias("peer_median"),
        F.round(F.coalesce(num("robust_z_score"), F.lit(0.0)), 2).alias("robust_z_score"),
        F.coalesce(F.get_json_object("details", "$.anomaly_type"), F.lit("STANDARD_COST")).alias("anomaly_type"),
        F.coalesce("overall_risk_score", F.lit(0.0)).alias("risk_score"))


DEVIATION_BUCKETS = ["<= 0%", "1-25%", "26-50%", "51-100%", "> 100%"]


def cost_deviation_histogram(t, compat_gaps: bool = True, **filters) -> DataFrame:
    """Deviation histogram. ``compat_gaps`` keeps the integer gaps (0-1, 25-26, 50-51) in the last bucket."""
    d = F.col("dev")
    if compat_gaps:
        bucket = (F.when(d <= 0, "<= 0%").when(d.between(1, 25), "1-25%").when(d.between(26, 50), "26-50%")
                  .when(d.between(51, 100), "51-100%").otherwise("> 100%"))
    else:
        bucket = (F.when(d <= 0, "<= 0%").when(d <= 25, "1-25%").when(d <= 50, "26-50%").when(d <= 100, "51-100%").otherwise("> 100%"))
    odd = (F.col("score") >= 30) | (d > 25)
    out = _zero_filled(_project_deviations(t, **filters), bucket, DEVIATION_BUCKETS, [
        F.count(F.lit(1)).alias("total_projects_assessed"), F.count_if(~odd).alias("normal_cost_count"),
        F.count_if(odd).alias("cost_anomalous_count"), F.coalesce(F.round(F.avg("dev"), 1), F.lit(0.0)).alias("average_deviation_pct")])
    return out.withColumn("cost_anomaly_rate_pct", X.safe_pct("cost_anomalous_count", "total_projects_assessed", 1))


def top_deviations(t, k=10, **filters) -> DataFrame:
    d = _project_deviations(t, **filters).withColumn("deviation_percentage", F.round("dev", 1)).drop("dev", "score")
    return page(d, [F.col("deviation_percentage").desc(), F.col("risk_score").desc(), F.col("project_id")], k)


def monthly_trend(t, **filters) -> DataFrame:
    """Sanction-month series; the running count is over the few aggregated months."""
    df = portfolio(t, money=True, features=True, engine="cost_anomaly", extra=("sanction_date",)).filter(
        project_filters(**filters) & F.col("sanction_date").isNotNull())
    g = df.groupBy(F.date_format("sanction_date", "yyyy-MM").alias("period")).agg(
        F.count(F.lit(1)).alias("project_count"), _avg0("overall_risk_score").alias("average_risk_score"),
        F.count_if(F.upper("risk_level").isin("HIGH", "CRITICAL") | (F.col("overall_risk_score") >= 60)).alias("high_risk_count"),
        F.count_if((F.col("delay_days") > 0) | (F.col("current_status") == "Stalled")).alias("delayed_count"),
        F.count_if((F.col("engine_score") >= 30) | (F.col("cost_deviation") > 0)).alias("cost_anomalies_count"),
        *[X.to_crore(_sum0(f"{c}_amount")).alias(f"{c}_amount_cr") for c in ("sanctioned", "expenditure", "released")])
    e, r, s = F.col("expenditure_amount_cr"), F.col("released_amount_cr"), F.col("sanctioned_amount_cr")
    util = F.when(r > 0, F.round(e / r * 100, 1)).when(s > 0, F.round(e / s * 100, 1)).otherwise(0.0)
    run = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("cumulative_projects", F.sum("project_count").over(run)).withColumn(
        "utilization_rate_pct", util).drop("released_amount_cr")


def state_density(t, metric="projects", **filters) -> DataFrame:
    """Choropleth rows with a 10-100 density; the maximum is taken over the aggregated states."""
    g = state_rollup(t, **filters).select(
        "state_name", "total_projects", "high_risk_projects", "critical_risk_projects", "average_risk_score",
        "average_delay_days", X.to_crore("total_sanctioned").alias("sanctioned_amount_cr"),
        X.to_crore("total_expenditure").alias("expenditure_amount_cr"))
    val = {"risk_score": "average_risk_score", "delay": "average_delay_days", "sanctioned": "sanctioned_amount_cr",
           "funds": "sanctioned_amount_cr"}.get((metric or "").lower(), "total_projects")
    code = F.create_map(*[F.lit(x) for kv in fv.STATE_CODES.items() for x in kv])
    g = g.withColumn("__v", F.col(val).cast("double"))
    top = F.greatest(F.max("__v").over(Window.partitionBy()), F.lit(1.0))
    return (g.withColumn("state_code", F.coalesce(F.try_element_at(code, F.col("state_name")), F.concat(F.lit("IN-"), F.upper(F.substring("state_name", 1, 2)))))
            .withColumn("density_score", F.round(F.col("__v") / top * 90.0 + 10.0, 1)).drop("__v"))


def engine_stats(t, engine: str) -> DataFrame:
    s = F.col("score")
    return t["risk_factors"].filter(F.col("engine_name") == engine).agg(
        F.count(F.lit(1)).alias("total_evaluated"), F.round(F.avg(s), 2).alias("average_score"), F.min(s).alias("min_score"),
        F.max(s).alias("max_score"), F.round(F.avg("confidence"), 3).alias("average_confidence"),
        F.count_if(s < 30).alias("low"), F.count_if((s >= 30) & (s < 60)).alias("medium"),
        F.count_if((s >= 60) & (s < 80)).alias("high"), F.count_if(s >= 80).alias("critical"))


def engine_top(t, engine: str, k=10) -> DataFrame:
    """The k highest rows are chosen on the factor table alone, then joined to their projects."""
    top = page(t["risk_factors"].filter(F.col("engine_name") == engine).select("project_id", "score", "factor_impact", "reason"),
               [F.col("score").desc(), F.col("project_id")], k)
    return top.join(t["projects"].select("project_id", "project_title", "sector", "current_status"), "project_id")


def agency_projects(t, query: str) -> DataFrame:
    q = query.strip().lower()
    a = F.lower("implementing_agency")
    return t["projects"].filter((F.trim(a) == q) | a.contains(q)).dropDuplicates(["project_id"])
