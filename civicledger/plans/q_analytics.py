"""Portfolio analytics queries."""
from pyspark.sql import functions as F

from civicledger.operators import analytics as A
from civicledger.plans.oracle_tables import sql
from civicledger.plans.q_views import (BUDGET_SQL, EFFICIENCY_SQL, EQUITY_SQL, MISSING_SQL, MISSING_WHERE, SECTOR_SQL, SECTOR_TABLES)
from civicledger.plans.registry import query

ONGOING = "current_status IN ('In Progress','Work Order Issued','Sanctioned')"
LATE = "days_delayed > 0 OR milestone_status IN ('Delayed','Critical') OR current_status = 'Stalled'"


def band(tier: str) -> str:
    return {"CRITICAL": "(risk_level = 'Critical' OR overall_risk_score >= 80)",
            "HIGH": "(risk_level = 'High' OR (overall_risk_score >= 60 AND overall_risk_score < 80))",
            "MEDIUM": "(risk_level = 'Moderate' OR (overall_risk_score >= 30 AND overall_risk_score < 60))",
            "LOW": "(risk_level = 'Low' OR overall_risk_score < 30)"}[tier]


def sum0(c: str) -> str:
    return f"coalesce(sum({c}), 0)::DOUBLE"


UTIL = """CASE WHEN sum(released_amount) > 0 THEN round(sum(expenditure_amount)::DOUBLE / sum(released_amount)::DOUBLE * 100, 2)
     WHEN sum(sanctioned_amount) > 0 THEN round(sum(expenditure_amount)::DOUBLE / sum(sanctioned_amount)::DOUBLE * 100, 2) ELSE 0.0 END::DOUBLE"""
JOINED = """projects p JOIN states s ON p.state_id = s.state_id LEFT JOIN financials f ON p.project_id = f.project_id
  LEFT JOIN risk_scores r ON p.project_id = r.project_id LEFT JOIN project_features pf ON p.project_id = pf.project_id"""
COST = JOINED + " LEFT JOIN risk_factors rf ON p.project_id = rf.project_id AND rf.engine_name = 'cost_anomaly'"
DELAY = JOINED + " LEFT JOIN risk_factors rf ON p.project_id = rf.project_id AND rf.engine_name = 'delay_detection'"
JT = ("projects", "states", "financials", "risk_scores", "project_features")
FILTERS = dict(status="in progress", sector="Medium", risk_level="high")
FILTER_SQL = f"lower(current_status) = 'in progress' AND lower(sector) = 'medium' AND {band('HIGH')}"


@query("f1_filtered_projects", sql(f"SELECT p.project_id, s.state_name, district_name, sector, current_status, overall_risk_score, risk_level FROM {JOINED} WHERE {FILTER_SQL} AND financial_year = '1997-98'", *JT))
def _(t):
    return (A.portfolio(t).filter(A.project_filters(**FILTERS, state="all", financial_year="1997-98"))
            .select("project_id", "state_name", "district_name", "sector", "current_status", "overall_risk_score", "risk_level"))


@query("f2_portfolio_summary", sql(f"""SELECT count(*) AS total_projects, count(*) FILTER (current_status = 'Completed') AS completed_projects, count(*) FILTER (current_status = 'In Progress') AS in_progress_projects,
  count(*) FILTER ({ONGOING}) AS ongoing_projects, count(*) FILTER (current_status = 'Stalled') AS stalled_projects, {sum0('recommended_amount')} AS total_allocated_amount, {sum0('sanctioned_amount')} AS total_sanctioned_amount,
  {sum0('released_amount')} AS total_released_amount, {sum0('expenditure_amount')} AS total_expenditure_amount, {sum0('unspent_balance')} AS total_unspent_balance,
  coalesce(round(avg(physical_progress_pct), 2), 0.0)::DOUBLE AS average_progress, count(*) FILTER ({LATE}) AS delayed_projects,
  CASE WHEN sum(released_amount) > 0 THEN round(sum(expenditure_amount)::DOUBLE / sum(released_amount)::DOUBLE * 100, 2) ELSE 0.0 END::DOUBLE AS overall_utilization_pct
  FROM projects LEFT JOIN financials USING (project_id) LEFT JOIN latest_progress USING (project_id)""", "projects", "financials", "latest_progress"))
def _(t):
    return A.analytics_summary(t)


@query("f3_risk_distribution", sql("""SELECT l.risk_level, count(r.project_id) AS projects FROM (VALUES ('Low'),('Moderate'),('High'),('Critical')) AS l(risk_level)
  LEFT JOIN risk_scores r USING (risk_level) GROUP BY 1""", "risk_scores"))
def _(t):
    return A.risk_distribution(t)


@query("f4_status_distribution", sql("SELECT current_status, count(*) AS projects FROM projects GROUP BY 1", "projects"))
def _(t):
    return A.status_distribution(t).orderBy(F.col("projects").desc(), "current_status")


ROLL = f"""count(*) AS total_projects, count(*) FILTER (current_status = 'Completed') AS completed_projects, count(*) FILTER ({ONGOING}) AS ongoing_projects,
  {sum0('sanctioned_amount')} AS total_sanctioned, {sum0('expenditure_amount')} AS total_expenditure, coalesce(round(avg(physical_progress_pct), 2), 0.0)::DOUBLE AS avg_progress_pct"""
ROLL_FROM = "FROM projects p JOIN states s ON p.state_id = s.state_id LEFT JOIN financials f ON p.project_id = f.project_id LEFT JOIN latest_progress g ON p.project_id = g.project_id"
RT = ("projects", "states", "financials", "latest_progress")


@query("f5_state_rollup", sql(f"SELECT s.state_id, s.state_name, {ROLL}, {sum0('released_amount')} AS total_released {ROLL_FROM} GROUP BY 1, 2", *RT))
def _(t):
    return A.state_aggregations(t).orderBy(F.col("total_projects").desc(), F.col("total_sanctioned").desc())


@query("f6_district_rollup", sql(f"SELECT district_name, s.state_name, {ROLL} {ROLL_FROM} GROUP BY 1, 2", *RT))
def _(t):
    return A.district_aggregations(t).orderBy(F.col("total_projects").desc(), F.col("total_sanctioned").desc())


@query("f7_kpis", sql(f"""SELECT count(*) AS total_projects, round(sum(sanctioned_amount) / 1e7, 2) AS total_sanctioned_cr, round(sum(released_amount) / 1e7, 2) AS total_released_cr,
  round(sum(expenditure_amount) / 1e7, 2) AS total_expenditure_cr, round(sum(expenditure_amount) / sum(released_amount) * 100, 2) AS overall_utilization_pct,
  count(*) FILTER (current_status = 'Completed') AS completed_projects_count, count(*) FILTER (current_status = 'In Progress') AS in_progress_projects_count,
  count(*) FILTER (current_status = 'Stalled') AS stalled_projects_count, count(*) FILTER ({LATE}) AS delayed_projects_count,
  count(*) FILTER (overall_risk_score >= 40 OR risk_level IN ('High','Critical')) AS high_risk_projects_count FROM overview""", "overview"))
def _(t):
    return A.kpis(t)


@query("f8_sector_list", sql(SECTOR_SQL, *SECTOR_TABLES))
def _(t):
    return A.sector_summary(t)


@query("f9_delayed_page", sql(f"""SELECT project_id, project_title, state_name, days_delayed, milestone_status, delay_risk_score, risk_level FROM overview WHERE {LATE}
  ORDER BY days_delayed DESC NULLS FIRST, delay_risk_score DESC NULLS FIRST, project_id LIMIT 50 OFFSET 25""", "overview"))
def _(t):
    return A.delayed_list(t, 50, 25).select("project_id", "project_title", "state_name", "days_delayed", "milestone_status", "delay_risk_score", "risk_level")


@query("f10_high_risk_page", sql("""SELECT project_id, project_title, state_name, sector, overall_risk_score, risk_level, days_delayed FROM overview
  WHERE (overall_risk_score >= 40 OR risk_level IN ('High','Critical')) AND overall_risk_score >= 55 ORDER BY overall_risk_score DESC NULLS FIRST, project_id LIMIT 50""", "overview"))
def _(t):
    return A.high_risk_list(t, 55).select("project_id", "project_title", "state_name", "sector", "overall_risk_score", "risk_level", "days_delayed")


@query("f11_missing_info_page", sql(f"""WITH m AS (SELECT project_id, project_title, {MISSING_SQL} AS mf FROM overview WHERE {MISSING_WHERE})
  SELECT project_id, project_title, array_to_string(mf, '|') AS missing_fields, len(mf) AS missing_fields_count FROM m ORDER BY len(mf) DESC, project_id LIMIT 50""", "overview"))
def _(t):
    return A.missing_info_list(t).select("project_id", "project_title", "missing_fields", "missing_fields_count")


@query("f12_equity_list", sql(EQUITY_SQL, "master_dim"))
def _(t):
    from civicledger.operators import views as V
    return V.state_equity(t["master_dim"]).orderBy("state_name")


@query("f12_efficiency_top", sql(EFFICIENCY_SQL + " ORDER BY rank_utilization, state_id LIMIT 10", "parliament_qa", "states"))
def _(t):
    from civicledger.operators import views as V
    return V.state_efficiency(t["parliament_qa"], t["states"]).orderBy("rank_utilization", "state_id").limit(10)


@query("f12_budget_series", sql(BUDGET_SQL, "union_budget"))
def _(t):
    from civicledger.operators import views as V
    return V.budget_history(t["union_budget"]).orderBy("start_year")


BANDS = ", ".join(f"count(*) FILTER {band(k)} AS {n}" for k, n in (("CRITICAL", "critical_count"), ("HIGH", "high_count"), ("MEDIUM", "moderate_count"), ("LOW", "low_count")))


def _overview_sql(where: str) -> str:
    return f"""SELECT count(*) AS total_projects, {BANDS}, coalesce(round(avg(overall_risk_score), 2), 0.0)::DOUBLE AS avg_risk_score,
  count(*) FILTER (overall_risk_score >= 40 OR is_delayed OR cost_deviation > 0) AS flagged_count, {sum0('sanctioned_amount')} AS total_sanctioned, {sum0('expenditure_amount')} AS total_expenditure,
  count(*) FILTER (delay_days > 0 OR is_delayed OR current_status = 'Stalled') AS delayed_count, coalesce(round(avg(CASE WHEN delay_days > 0 THEN delay_days END), 1), 0.0)::DOUBLE AS avg_delay_days,
  {UTIL} AS overall_utilization_pct, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (overall_risk_score >= 40 OR is_delayed OR cost_deviation > 0)::DOUBLE / count(*) * 100, 1) ELSE 0.0 END::DOUBLE AS flagged_pct
  FROM {JOINED} WHERE {where}"""


@query("f13_overview", sql(_overview_sql("true"), *JT))
def _(t):
    return A.overview(t)


@query("f13_overview_filtered", sql(_overview_sql(FILTER_SQL), *JT))
def _(t):
    return A.overview(t, **FILTERS)


@query("f14_risk_distribution_filtered", sql(f"""WITH a AS (SELECT count(*) AS total_projects, {BANDS}, coalesce(round(avg(overall_risk_score), 2), 0.0)::DOUBLE AS average_overall_score FROM {JOINED} WHERE lower(sector) = 'high')
  SELECT tier, projects, total_projects, average_overall_score, round(projects::DOUBLE / total_projects * 100, 2) AS percentage FROM a, LATERAL (VALUES ('LOW', low_count), ('MEDIUM', moderate_count), ('HIGH', high_count), ('CRITICAL', critical_count)) v(tier, projects)""", *JT))
def _(t):
    return A.risk_distribution_filtered(t, sector="high")


@query("f14_engine_averages", sql(f"SELECT engine_name, round(avg(score), 2) AS avg_score FROM risk_factors JOIN projects p USING (project_id) WHERE lower(sector) = 'high' GROUP BY 1", "risk_factors", "projects"))
def _(t):
    return A.engine_averages(t, sector="high")


GEO = f"""count(*) AS total_projects, count(*) FILTER {band('HIGH')} AS high_risk_projects, count(*) FILTER {band('CRITICAL')} AS critical_risk_projects,
  coalesce(round(avg(overall_risk_score), 2), 0.0)::DOUBLE AS average_risk_score, coalesce(round(avg(CASE WHEN delay_days > 0 THEN delay_days ELSE 0 END), 1), 0.0)::DOUBLE AS average_delay_days,
  {sum0('sanctioned_amount')} AS total_sanctioned, {sum0('expenditure_amount')} AS total_expenditure"""
STATES = f"""SELECT s.state_id, s.state_name, {GEO}, count(*) FILTER (rf.score >= 40 OR cost_deviation > 0) AS cost_anomaly_count, {UTIL} AS utilization_pct FROM {COST}"""

for _metric, _order in (("projects", "total_projects DESC, total_sanctioned DESC"), ("risk", "average_risk_score DESC, total_projects DESC"), ("delay", "average_delay_days DESC, total_projects DESC"),
                        ("cost_anomaly", "cost_anomaly_count DESC, total_projects DESC"), ("funds", "total_sanctioned DESC, total_projects DESC"),
                        ("critical", "critical_risk_projects DESC, total_projects DESC"), ("high_risk", "high_risk_projects DESC, total_projects DESC")):
    @query(f"f15_states_by_{_metric}", sql(f"{STATES} GROUP BY 1, 2 ORDER BY {_order}, state_id LIMIT 10", *JT, "risk_factors"))
    def _(t, m=_metric):
        return A.states_analytics(t, m, 10)

for _metric, _order in (("projects", "total_projects DESC, total_sanctioned DESC"), ("risk", "average_risk_score DESC, total_projects DESC"),
                        ("delay", "average_delay_days DESC, total_projects DESC"), ("critical", "critical_risk_projects + high_risk_projects DESC, total_projects DESC"),
                        ("sanctioned", "total_sanctioned DESC, total_projects DESC")):
    @query(f"f16_districts_by_{_metric}", sql(f"SELECT district_name, s.state_name, {GEO} FROM {JOINED} GROUP BY 1, 2 ORDER BY {_order}, district_name, state_name LIMIT 15", *JT))
    def _(t, m=_metric):
        return A.districts_analytics(t, m)


DELAY_ROWS = f"""SELECT p.project_id, project_title, s.state_name, district_name, sector, current_status, strftime(expected_completion_date, '%Y-%m-%d') AS expected_completion_date,
  coalesce(overall_risk_score, 0.0)::DOUBLE AS risk_score, CASE WHEN current_status = 'Completed' THEN greatest(0, coalesce(delay_days, 0)) ELSE coalesce(overdue_days, greatest(0, coalesce(delay_days, 0))) END AS days_delayed FROM {DELAY}"""


@query("f17_delay_histogram", sql(f"""WITH d AS (SELECT *, CASE WHEN days_delayed <= 0 THEN '0 days' WHEN days_delayed <= 30 THEN '1-30 days' WHEN days_delayed <= 90 THEN '31-90 days'
    WHEN days_delayed <= 180 THEN '91-180 days' WHEN days_delayed <= 365 THEN '181-365 days' ELSE '365+ days' END AS bucket FROM ({DELAY_ROWS})),
  a AS (SELECT count(*) AS total_projects_assessed, count(*) FILTER (days_delayed <= 0) AS on_time_count, count(*) FILTER (days_delayed > 0) AS delayed_count, count(*) FILTER (days_delayed > 90) AS severely_delayed_count,
    round(avg(days_delayed) FILTER (days_delayed > 0), 1) AS average_delay_days, max(days_delayed) AS max_delay_days FROM d)
  SELECT b.bucket, count(d.project_id) AS projects, a.* FROM (VALUES ('0 days'),('1-30 days'),('31-90 days'),('91-180 days'),('181-365 days'),('365+ days')) b(bucket) CROSS JOIN a LEFT JOIN d ON d.bucket = b.bucket GROUP BY ALL""", *JT, "risk_factors"))
def _(t):
    return A.delay_histogram(t)


@query("f18_top_delayed", sql(f"SELECT * FROM ({DELAY_ROWS}) ORDER BY days_delayed DESC, risk_score DESC, project_id LIMIT 10", *JT, "risk_factors"))
def _(t):
    return A.top_delayed(t)


DEV_ROWS = f"""SELECT p.project_id, project_title, s.state_name, district_name, sector, coalesce(rf.score, 0) AS score, coalesce(deviation_percentage, 0.0)::DOUBLE AS dev, coalesce(expenditure_amount, 0)::DOUBLE AS evaluated_cost,
  coalesce(sanctioned_amount, 0)::DOUBLE AS peer_median, coalesce(round(robust_z_score, 2), 0.0)::DOUBLE AS robust_z_score, coalesce(anomaly_type, 'STANDARD_COST') AS anomaly_type, coalesce(overall_risk_score, 0.0)::DOUBLE AS risk_score FROM {COST}"""


def _dev_sql(case: str) -> str:
    return f"""WITH d AS (SELECT *, {case} AS bucket FROM ({DEV_ROWS})),
  a AS (SELECT count(*) AS total_projects_assessed, count(*) FILTER (NOT (score >= 30 OR dev > 25)) AS normal_cost_count, count(*) FILTER (score >= 30 OR dev > 25) AS cost_anomalous_count,
    round(avg(dev), 1) AS average_deviation_pct, round(count(*) FILTER (score >= 30 OR dev > 25)::DOUBLE / count(*) * 100, 1) AS cost_anomaly_rate_pct FROM d)
  SELECT b.bucket, count(d.project_id) AS projects, a.* FROM (VALUES ('<= 0%'),('1-25%'),('26-50%'),('51-100%'),('> 100%')) b(bucket) CROSS JOIN a LEFT JOIN d ON d.bucket = b.bucket GROUP BY ALL"""


@query("f19_cost_deviation_histogram", sql(_dev_sql("CASE WHEN dev <= 0 THEN '<= 0%' WHEN dev BETWEEN 1 AND 25 THEN '1-25%' WHEN dev BETWEEN 26 AND 50 THEN '26-50%' WHEN dev BETWEEN 51 AND 100 THEN '51-100%' ELSE '> 100%' END"), *JT, "risk_factors"))
def _(t):
    return A.cost_deviation_histogram(t)


@query("f19_cost_deviation_histogram_gap_free", sql(_dev_sql("CASE WHEN dev <= 0 THEN '<= 0%' WHEN dev <= 25 THEN '1-25%' WHEN dev <= 50 THEN '26-50%' WHEN dev <= 100 THEN '51-100%' ELSE '> 100%' END"), *JT, "risk_factors"))
def _(t):
    return A.cost_deviation_histogram(t, compat_gaps=False)


@query("f20_top_deviations", sql(f"""SELECT project_id, project_title, state_name, district_name, sector, evaluated_cost, peer_median, robust_z_score, anomaly_type, risk_score, round(dev, 1) AS deviation_percentage
  FROM ({DEV_ROWS}) ORDER BY round(dev, 1) DESC, risk_score DESC, project_id LIMIT 10""", *JT, "risk_factors"))
def _(t):
    return A.top_deviations(t)


@query("f21_monthly_trend", sql(f"""WITH g AS (SELECT strftime(sanction_date, '%Y-%m') AS period, count(*) AS project_count, coalesce(round(avg(overall_risk_score), 2), 0.0)::DOUBLE AS average_risk_score,
    count(*) FILTER (risk_level IN ('High','Critical') OR overall_risk_score >= 60) AS high_risk_count, count(*) FILTER (delay_days > 0 OR current_status = 'Stalled') AS delayed_count,
    count(*) FILTER (rf.score >= 30 OR cost_deviation > 0) AS cost_anomalies_count, round({sum0('sanctioned_amount')} / 1e7, 2) AS s, round({sum0('expenditure_amount')} / 1e7, 2) AS e, round({sum0('released_amount')} / 1e7, 2) AS r
    FROM {COST} WHERE sanction_date IS NOT NULL GROUP BY 1)
  SELECT period, project_count, average_risk_score, high_risk_count, delayed_count, cost_anomalies_count, s AS sanctioned_amount_cr, e AS expenditure_amount_cr,
    sum(project_count) OVER (ORDER BY period)::BIGINT AS cumulative_projects, CASE WHEN r > 0 THEN round(e / r * 100, 1) WHEN s > 0 THEN round(e / s * 100, 1) ELSE 0.0 END::DOUBLE AS utilization_rate_pct FROM g""", *JT, "risk_factors"))
def _(t):
    return A.monthly_trend(t).orderBy("period")


@query("f22_state_density", sql(f"""WITH g AS (SELECT s.state_name, {GEO} FROM {JOINED} GROUP BY 1)
  SELECT state_name, total_projects, high_risk_projects, critical_risk_projects, average_risk_score, average_delay_days, round(total_sanctioned / 1e7, 2) AS sanctioned_amount_cr, round(total_expenditure / 1e7, 2) AS expenditure_amount_cr,
    'IN-' || upper(substr(state_name, 1, 2)) AS state_code, round(average_delay_days / greatest(max(average_delay_days) OVER (), 1.0) * 90.0 + 10.0, 1) AS density_score FROM g""", *JT))
def _(t):
    return A.state_density(t, "delay")


@query("f23_engine_analytics", sql("""SELECT count(*) AS total_evaluated, round(avg(score), 2) AS average_score, min(score) AS min_score, max(score) AS max_score, round(avg(confidence), 3) AS average_confidence,
  count(*) FILTER (score < 30) AS low, count(*) FILTER (score >= 30 AND score < 60) AS medium, count(*) FILTER (score >= 60 AND score < 80) AS high, count(*) FILTER (score >= 80) AS critical FROM risk_factors WHERE engine_name = 'agency_pattern'""", "risk_factors"))
def _(t):
    return A.engine_stats(t, "agency_pattern")


@query("f23_engine_top", sql("""SELECT project_id, score, factor_impact, reason, project_title, sector, current_status FROM risk_factors JOIN projects USING (project_id) WHERE engine_name = 'agency_pattern'
  ORDER BY score DESC, project_id LIMIT 10""", "risk_factors", "projects"))
def _(t):
    return A.engine_top(t, "agency_pattern")
