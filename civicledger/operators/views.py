"""The analytic views: overview, monitoring lists, sector summary and state comparisons."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from civicledger.functions import columns as X


def latest_per_key(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """Whole latest row per key. The rank filter is pushed below the shuffle, so a hot key sends
    one row per map task."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def latest_progress(progress: DataFrame) -> DataFrame:
    return latest_per_key(progress, "project_id",
                          [F.col("reported_date").desc_nulls_first(), F.col("progress_id").desc()])


def last_non_null_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest non-null value of each column on its own (rows without a date count as newest)."""
    o = F.struct(F.col(order[0]).isNull(), *[F.col(c) for c in order])
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in df.columns if c != key]
    return df.groupBy(key).agg(*aggs)


def with_unspent(fin: DataFrame) -> DataFrame:
    return fin.withColumn("unspent_balance", F.col("released_amount") - F.col("expenditure_amount"))


def project_overview(t) -> DataFrame:
    pr = latest_progress(t["progress"]).select(
        "project_id", F.col("reported_date").alias("progress_reported_date"), "physical_progress_pct",
        "financial_progress_pct", "current_stage", "days_delayed", "milestone_status", "inspected_by",
        "inspection_date", "geo_latitude", "geo_longitude", "photo_evidence_url")
    rs = t["risk_scores"].select(
        "project_id", "overall_risk_score", "delay_risk_score", "cost_overrun_risk_score", "non_completion_risk_score",
        "leakage_risk_score", "risk_level", "confidence_score", F.col("assessment_date").alias("risk_assessment_date"))
    p = t["projects"].select(
        "project_id", "project_code", "project_title", "project_description", "sector", "sub_sector", "state_id",
        "constituency_id", "district_name", "block_name", "implementing_agency", "mp_name", "house_of_parliament",
        "financial_year", "current_status", "recommendation_date", "sanction_date", "work_order_date",
        "expected_completion_date", "actual_completion_date")
    late = (F.col("days_delayed") > 0) | F.col("milestone_status").isin("Delayed", "Critical")
    return (p.join(t["states"].select("state_id", "state_name", "canonical_state_key"), "state_id")
            .join(t["constituencies"].select("constituency_id", "constituency_name", "reservation_category"), "constituency_id")
            .join(t["financials"], "project_id", "left").join(pr, "project_id", "left").join(rs, "project_id", "left")
            .withColumns({
                "is_delayed": F.coalesce(late, F.lit(False)),
                "has_cost_overrun": F.coalesce(F.col("cost_overrun_amount") > 0, F.lit(False)),
                "audit_status": F.when(F.col("inspection_date").isNotNull(), "Audited").otherwise("Pending Inspection")}))


_WHO = ["project_id", "project_code", "project_title", "state_name", "constituency_name", "district_name",
        "mp_name", "sector", "implementing_agency", "current_status"]


def delayed_projects(t, overview: DataFrame | None = None) -> DataFrame:
    v = overview if overview is not None else project_overview(t)
    return v.filter((F.col("days_delayed") > 0) | F.col("milestone_status").isin("Delayed", "Critical")
                    | (F.col("current_status") == "Stalled")).select(
        *_WHO, "recommendation_date", "expected_completion_date", "days_delayed", "milestone_status",
        "physical_progress_pct", "financial_progress_pct", "sanctioned_amount", "expenditure_amount",
        "delay_risk_score", "risk_level")




def delayed_order():
    return [F.col("days_delayed").desc_nulls_first(), F.col("delay_risk_score").desc_nulls_first(), F.col("project_id")]


def factor_list(risk_factors: DataFrame) -> DataFrame:
    """Risk factors as one JSON list per project; a factor name occurs once per project, so a list
    is never longer than the set of factor names."""
    rows = (risk_factors.groupBy("project_id", "factor_name").agg(
        F.max_by(F.struct("factor_category", "factor_weight", "factor_impact", "mitigation_recommendation"),
                 "risk_score_id").alias("f")))
    item = F.struct(F.col("f.factor_category").alias("category"), F.col("factor_name").alias("factor"),
                    F.col("f.factor_weight").alias("weight"), F.col("f.factor_impact").alias("impact"),
                    F.col("f.mitigation_recommendation").alias("recommendation"))
    return rows.groupBy("project_id").agg(
        F.to_json(F.array_sort(F.collect_list(item)), {"ignoreNullFields": "false"}).alias("primary_risk_factors"))


def high_risk_projects(t, overview: DataFrame | None = None) -> DataFrame:
    v = overview if overview is not None else project_overview(t)
    v = v.filter((F.col("overall_risk_score") >= 40) | F.col("risk_level").isin("High", "Critical")).select(
        *_WHO, "overall_risk_score", "delay_risk_score", "cost_overrun_risk_score", "non_completion_risk_score",
        "leakage_risk_score", "risk_level", "confidence_score", "sanctioned_amount", "expenditure_amount",
        "days_delayed", "milestone_status")
    return v.join(factor_list(t["risk_factors"]), "project_id", "left")


def missing_labels() -> Column:
    """Array of missing-field labels of an overview row."""
    miss = lambda cond, label: F.when(cond, F.lit(label))
    null = lambda c: F.col(c).isNull()
    return F.array_compact(F.array(
        miss(null("actual_completion_date"), "Pending Actual Completion Date"),
        miss(null("sanction_date"), "Missing Sanction Date"),
        miss(null("work_order_date") & F.col("current_status").isin("Work Order Issued", "In Progress", "Completed"),
             "Missing Work Order Date"),
        miss(null("inspection_date"), "Pending Inspection Audit"),
        miss(null("geo_latitude") | null("geo_longitude"), "Missing Geo-Coordinates"),
        miss(null("photo_evidence_url"), "Missing Photo Evidence"),
        miss(null("block_name"), "Unspecified Administrative Block")))


def missing_information(t, overview: DataFrame | None = None) -> DataFrame:
    v = overview if overview is not None else project_overview(t)
    flag = X.any_of([F.col(c).isNull() for c in ("actual_completion_date", "inspection_date", "geo_latitude",
                                                 "photo_evidence_url", "sanction_date")])
    return (v.filter(flag).select("project_id", "project_code", "project_title", "state_name", "constituency_name",
                                  "current_status", missing_labels().alias("missing_fields"))
            .withColumn("missing_fields_count", F.size("missing_fields")))


def sector_financial_summary(t) -> DataFrame:
    """Counts, average progress, money sums and average risk per sector."""
    st = F.col("current_status")
    pr = latest_progress(t["progress"]).select("project_id", "physical_progress_pct", "days_delayed")
    fin = t["financials"].select("project_id", "sanctioned_amount", "released_amount", "expenditure_amount", "unspent_balance")
    base = (t["projects"].select("project_id", "sector", "current_status").join(fin, "project_id", "left")
            .join(pr, "project_id", "left").join(t["risk_scores"].select("project_id", "overall_risk_score"), "project_id", "left"))
    g = base.groupBy("sector").agg(
        F.count(F.lit(1)).alias("total_projects"), F.count_if(st == "Completed").alias("completed_projects"),
        F.count_if(st == "In Progress").alias("in_progress_projects"), F.count_if(st == "Stalled").alias("stalled_projects"),
        F.round(F.avg("physical_progress_pct"), 2).alias("avg_physical_progress_pct"),
        F.sum("sanctioned_amount").alias("total_sanctioned_amount"), F.sum("released_amount").alias("total_released_amount"),
        F.sum("expenditure_amount").alias("total_expenditure_amount"), F.sum("unspent_balance").alias("total_unspent_balance"),
        F.round(F.avg("overall_risk_score"), 2).alias("avg_sector_risk_score"),
        F.count_if(F.col("days_delayed") > 0).alias("delayed_projects_count"))
    return g.withColumn("overall_utilization_pct", X.safe_pct("total_expenditure_amount", "total_released_amount"))


def state_equity(master: DataFrame) -> DataFrame:
    target = lambda pct: F.round(F.col("cumulative_released_cr").cast("double") * (F.col(pct) / 100.0), 2)
    delta = lambda a, b: F.round(F.col(a) - F.col(b), 2)
    return master.select(
        "state_id", "state_name", "category", "total_lok_sabha_seats", "sc_reserved_seats", "sc_seat_share_pct",
        "statutory_sc_allocation_pct",
        delta("sc_seat_share_pct", "statutory_sc_allocation_pct").alias("sc_share_vs_statutory_delta_pct"),
        "st_reserved_seats", "st_seat_share_pct", "statutory_st_allocation_pct",
        delta("st_seat_share_pct", "statutory_st_allocation_pct").alias("st_share_vs_statutory_delta_pct"),
        "cumulative_released_cr", target("statutory_sc_allocation_pct").alias("mandated_sc_outlay_target_cr"),
        target("statutory_st_allocation_pct").alias("mandated_st_outlay_target_cr"))


def state_efficiency(qa: DataFrame, states: DataFrame) -> DataFrame:
    """Three competition ranks. The input has one row per state, so a global window is bounded by
    the number of states."""
    df = qa.join(states.select("canonical_state_key", "category"), "canonical_state_key")
    rank = lambda c: F.rank().over(Window.orderBy(F.col(c).desc()))
    return df.select("state_id", "state_name", "category", "released_cr", "expenditure_cr", "unspent_balance_cr",
                     "utilization_rate_pct", rank("utilization_rate_pct").alias("rank_utilization"),
                     "sanction_rate_pct", rank("sanction_rate_pct").alias("rank_sanction_rate"),
                     "completion_rate_pct", rank("completion_rate_pct").alias("rank_completion_rate"),
                     "works_recommended", "works_sanctioned", "works_completed")


def budget_history(budget: DataFrame) -> DataFrame:
    be, ac = F.col("budget_estimate_cr").cast("double"), F.col("actual_expenditure_cr").cast("double")
    return budget.select(
        "financial_year", "start_year", "scheme_entitlement_per_mp_cr", "budget_estimate_cr", "revised_estimate_cr",
        "actual_expenditure_cr", "be_vs_actual_variance_cr",
        F.when((be > 0) & ac.isNotNull(), F.round(ac / be * 100.0, 2)).alias("budget_utilization_pct"), "status_notes")


def split_valid(df: DataFrame, constraints: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows meeting all constraints, and rejects with the names of the broken ones. As in SQL, a
    constraint that evaluates to NULL passes."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in constraints.items()]))
    tagged = df.withColumn("broken_rules", broken)
    return (tagged.filter(F.size("broken_rules") == 0).drop("broken_rules"), tagged.filter(F.size("broken_rules") > 0))
