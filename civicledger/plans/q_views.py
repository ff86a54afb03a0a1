"""Queries over the analytic views (latest rows, overview, monitoring lists, state comparisons)."""
from pyspark.sql import functions as F

from civicledger.operators import views as V
from civicledger.plans.oracle_tables import sql
from civicledger.plans.registry import query

OVERVIEW_COLS = """project_id, project_code, project_title, sector, sub_sector, state_id, state_name, constituency_id, constituency_name, reservation_category, district_name,
  block_name, implementing_agency, mp_name, house_of_parliament, financial_year, current_status, strftime(recommendation_date, '%Y-%m-%d') AS recommendation_date,
  strftime(expected_completion_date, '%Y-%m-%d') AS expected_completion_date, recommended_amount, sanctioned_amount, released_amount, expenditure_amount, unspent_balance, utilization_rate_pct,
  cost_overrun_amount, cost_overrun_pct, strftime(progress_reported_date, '%Y-%m-%d') AS progress_reported_date, physical_progress_pct, financial_progress_pct, current_stage,
  days_delayed, milestone_status, overall_risk_score, risk_level, confidence_score, is_delayed, has_cost_overrun, audit_status"""


@query("e1_latest_progress", sql("""SELECT project_id, progress_id, strftime(reported_date, '%Y-%m-%d') AS reported_date, physical_progress_pct, days_delayed, milestone_status
  FROM latest_progress""", "latest_progress"))
def _(t):
    return V.latest_progress(t["progress"]).select("project_id", "progress_id", "reported_date", "physical_progress_pct",
                                                   "days_delayed", "milestone_status")


@query("e2_last_non_null_progress", sql("""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY reported_date, progress_id) AS rn FROM progress)
  SELECT project_id, arg_max(physical_progress_pct, rn) AS physical_progress_pct,
    arg_max(geo_latitude, rn) FILTER (geo_latitude IS NOT NULL) AS geo_latitude,
    arg_max(inspected_by, rn) FILTER (inspected_by IS NOT NULL) AS inspected_by,
    arg_max(photo_evidence_url, rn) FILTER (photo_evidence_url IS NOT NULL) AS photo_evidence_url
  FROM r GROUP BY 1""", "progress"))
def _(t):
    df = t["progress"].select("project_id", "reported_date", "progress_id", "physical_progress_pct", "geo_latitude",
                              "inspected_by", "photo_evidence_url")
    return V.last_non_null_per_key(df, "project_id", ["reported_date", "progress_id"]).drop("reported_date", "progress_id")


@query("e3_project_overview", sql(f"SELECT {OVERVIEW_COLS} FROM overview", "overview"))
def _(t):
    return V.project_overview(t).select(
        *"""project_id project_code project_title sector sub_sector state_id state_name constituency_id constituency_name
        reservation_category district_name block_name implementing_agency mp_name house_of_parliament financial_year current_status
        recommendation_date expected_completion_date recommended_amount sanctioned_amount released_amount expenditure_amount unspent_balance
        utilization_rate_pct cost_overrun_amount cost_overrun_pct progress_reported_date physical_progress_pct financial_progress_pct
        current_stage days_delayed milestone_status overall_risk_score risk_level confidence_score is_delayed has_cost_overrun audit_status""".split())


@query("e4_delayed_projects", sql("""SELECT project_id, project_code, project_title, state_name, constituency_name, district_name, mp_name, sector, implementing_agency, current_status,
  strftime(recommendation_date, '%Y-%m-%d') AS recommendation_date, strftime(expected_completion_date, '%Y-%m-%d') AS expected_completion_date, days_delayed, milestone_status,
  physical_progress_pct, financial_progress_pct, sanctioned_amount, expenditure_amount, delay_risk_score, risk_level
  FROM overview WHERE days_delayed > 0 OR milestone_status IN ('Delayed','Critical') OR current_status = 'Stalled'""", "overview"))
def _(t):
    return V.delayed_projects(t).orderBy(*V.delayed_order())


@query("e5_high_risk_projects", sql("""WITH f AS (SELECT project_id, '[' || string_agg('{"category":"' || factor_category || '","factor":"' || factor_name || '","weight":0.2,"impact":"' || factor_impact ||
      '","recommendation":"' || mitigation_recommendation || '"}', ',' ORDER BY factor_category, factor_name) || ']' AS primary_risk_factors FROM risk_factors GROUP BY 1)
  SELECT project_id, project_code, project_title, state_name, constituency_name, district_name, mp_name, sector, implementing_agency, current_status, overall_risk_score, delay_risk_score,
  cost_overrun_risk_score, non_completion_risk_score, leakage_risk_score, risk_level, confidence_score, sanctioned_amount, expenditure_amount, days_delayed, milestone_status, primary_risk_factors
  FROM overview LEFT JOIN f USING (project_id) WHERE overall_risk_score >= 40 OR risk_level IN ('High','Critical')""", "overview", "risk_factors"))
def _(t):
    return V.high_risk_projects(t).orderBy(F.col("overall_risk_score").desc_nulls_first(), "project_id")


MISSING_SQL = """list_filter([CASE WHEN actual_completion_date IS NULL THEN 'Pending Actual Completion Date' END, CASE WHEN sanction_date IS NULL THEN 'Missing Sanction Date' END,
   CASE WHEN work_order_date IS NULL AND current_status IN ('Work Order Issued','In Progress','Completed') THEN 'Missing Work Order Date' END,
   CASE WHEN inspection_date IS NULL THEN 'Pending Inspection Audit' END, CASE WHEN geo_latitude IS NULL OR geo_longitude IS NULL THEN 'Missing Geo-Coordinates' END,
   CASE WHEN photo_evidence_url IS NULL THEN 'Missing Photo Evidence' END, CASE WHEN block_name IS NULL THEN 'Unspecified Administrative Block' END], lambda x: x IS NOT NULL)"""
MISSING_WHERE = """actual_completion_date IS NULL OR inspection_date IS NULL OR geo_latitude IS NULL OR photo_evidence_url IS NULL OR sanction_date IS NULL"""


@query("e6_missing_information", sql(f"""WITH m AS (SELECT *, {MISSING_SQL} AS mf FROM overview WHERE {MISSING_WHERE})
  SELECT project_id, project_code, project_title, state_name, constituency_name, current_status, array_to_string(mf, '|') AS missing_fields, len(mf) AS missing_fields_count FROM m""", "overview"))
def _(t):
    return V.missing_information(t).orderBy(F.col("missing_fields_count").desc(), "project_id")


SECTOR_SQL = """SELECT sector, count(*) AS total_projects, count(*) FILTER (current_status = 'Completed') AS completed_projects,
    count(*) FILTER (current_status = 'In Progress') AS in_progress_projects, count(*) FILTER (current_status = 'Stalled') AS stalled_projects,
    round(avg(physical_progress_pct), 2) AS avg_physical_progress_pct, sum(sanctioned_amount)::DOUBLE AS total_sanctioned_amount, sum(released_amount)::DOUBLE AS total_released_amount,
    sum(expenditure_amount)::DOUBLE AS total_expenditure_amount, sum(unspent_balance)::DOUBLE AS total_unspent_balance, round(avg(overall_risk_score), 2) AS avg_sector_risk_score,
    count(*) FILTER (days_delayed > 0) AS delayed_projects_count,
    CASE WHEN sum(released_amount) > 0 THEN round(sum(expenditure_amount)::DOUBLE / sum(released_amount)::DOUBLE * 100, 2) ELSE 0.0 END::DOUBLE AS overall_utilization_pct
  FROM projects LEFT JOIN financials USING (project_id) LEFT JOIN latest_progress USING (project_id) LEFT JOIN risk_scores USING (project_id) GROUP BY sector"""
SECTOR_TABLES = ("projects", "financials", "latest_progress", "risk_scores")


@query("e7_sector_financial_summary", sql(SECTOR_SQL, *SECTOR_TABLES))
def _(t):
    return V.sector_financial_summary(t).orderBy(F.col("total_sanctioned_amount").desc())


EQUITY_SQL = """SELECT state_id, state_name, category, total_lok_sabha_seats, sc_reserved_seats, sc_seat_share_pct, statutory_sc_allocation_pct,
    round(sc_seat_share_pct - statutory_sc_allocation_pct, 2) AS sc_share_vs_statutory_delta_pct, st_reserved_seats, st_seat_share_pct, statutory_st_allocation_pct,
    round(st_seat_share_pct - statutory_st_allocation_pct, 2) AS st_share_vs_statutory_delta_pct, cumulative_released_cr::DOUBLE AS cumulative_released_cr,
    round(cumulative_released_cr::DOUBLE * (statutory_sc_allocation_pct / 100.0), 2) AS mandated_sc_outlay_target_cr,
    round(cumulative_released_cr::DOUBLE * (statutory_st_allocation_pct / 100.0), 2) AS mandated_st_outlay_target_cr FROM master_dim"""


@query("e8_state_equity", sql(EQUITY_SQL, "master_dim"))
def _(t):
    return V.state_equity(t["master_dim"])


EFFICIENCY_SQL = """SELECT p.state_id, p.state_name, s.category, released_cr::DOUBLE AS released_cr, expenditure_cr::DOUBLE AS expenditure_cr, unspent_balance_cr::DOUBLE AS unspent_balance_cr,
    utilization_rate_pct, rank() OVER (ORDER BY utilization_rate_pct DESC) AS rank_utilization, sanction_rate_pct, rank() OVER (ORDER BY sanction_rate_pct DESC) AS rank_sanction_rate,
    completion_rate_pct, rank() OVER (ORDER BY completion_rate_pct DESC) AS rank_completion_rate, works_recommended, works_sanctioned, works_completed
  FROM parliament_qa p JOIN states s USING (canonical_state_key)"""


@query("e9_state_efficiency", sql(EFFICIENCY_SQL, "parliament_qa", "states"))
def _(t):
    return V.state_efficiency(t["parliament_qa"], t["states"])


BUDGET_SQL = """SELECT financial_year, start_year, scheme_entitlement_per_mp_cr, budget_estimate_cr::DOUBLE AS budget_estimate_cr, revised_estimate_cr::DOUBLE AS revised_estimate_cr,
    actual_expenditure_cr::DOUBLE AS actual_expenditure_cr, be_vs_actual_variance_cr::DOUBLE AS be_vs_actual_variance_cr,
    CASE WHEN budget_estimate_cr > 0 AND actual_expenditure_cr IS NOT NULL THEN round(actual_expenditure_cr::DOUBLE / budget_estimate_cr::DOUBLE * 100.0, 2) END AS budget_utilization_pct, status_notes FROM union_budget"""


@query("e10_budget_history", sql(BUDGET_SQL, "union_budget"))
def _(t):
    return V.budget_history(t["union_budget"]).orderBy("start_year")


@query("e11_unspent_balance", sql("""SELECT project_id, released_amount::DOUBLE AS released_amount, expenditure_amount::DOUBLE AS expenditure_amount,
  (released_amount - expenditure_amount)::DOUBLE AS unspent_balance FROM financials""", "financials"))
def _(t):
    return V.with_unspent(t["financials"].drop("unspent_balance")).select("project_id", "released_amount", "expenditure_amount", "unspent_balance")


@query("e12_constraint_rejects", sql("""WITH b AS (SELECT project_id, list_filter([
      CASE WHEN NOT (sanction_date >= recommendation_date) THEN 'chk_proj_sanction_date' END, CASE WHEN NOT (work_order_date >= sanction_date) THEN 'chk_proj_work_order_date' END,
      CASE WHEN NOT (actual_completion_date >= work_order_date) THEN 'chk_proj_completion_date' END, CASE WHEN sub_sector IS NULL THEN 'sub_sector_not_null' END,
      CASE WHEN implementing_agency IS NULL THEN 'implementing_agency_not_null' END], lambda x: x IS NOT NULL) AS l FROM projects)
  SELECT project_id, array_to_string(l, '|') AS broken_rules FROM b WHERE len(l) > 0""", "projects"))
def _(t):
    from civicledger.schemas import TABLES
    rules = {**TABLES["projects"].checks, "sub_sector_not_null": F.col("sub_sector").isNotNull(),
             "implementing_agency_not_null": F.col("implementing_agency").isNotNull()}
    _ok, rejects = V.split_valid(t["projects"], rules)
    return rejects.select("project_id", "broken_rules")
