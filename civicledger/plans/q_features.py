"""Feature engineering queries."""
from pyspark.sql import functions as F

from civicledger.operators import features as H
from civicledger.plans.bindings import AS_OF
from civicledger.plans.oracle_tables import CTES, sql
from civicledger.plans.registry import query

CFG = H.FeatureConfig(as_of=AS_OF)
REF = "DATE '2000-01-01'"

CTES["last_known"] = (("progress",), """
  SELECT project_id, max(reported_date) AS reported_date,
    arg_max(physical_progress_pct, o) AS physical_progress_pct, arg_max(financial_progress_pct, o) AS financial_progress_pct, arg_max(days_delayed, o) AS days_delayed,
    arg_max(geo_latitude, o) FILTER (geo_latitude IS NOT NULL) AS geo_latitude, arg_max(inspected_by, o) FILTER (inspected_by IS NOT NULL) AS inspected_by
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY reported_date, progress_id) AS o FROM progress) GROUP BY 1""")
CTES["joined"] = (("projects", "financials", "last_known"), """
  SELECT p.*, f.* EXCLUDE (project_id), l.* EXCLUDE (project_id) FROM projects p LEFT JOIN financials f USING (project_id) LEFT JOIN last_known l USING (project_id)""")


@query("h1_joined_table", sql("""SELECT project_id, sector, current_status, sanctioned_amount::DOUBLE AS sanctioned_amount, expenditure_amount::DOUBLE AS expenditure_amount,
  strftime(reported_date, '%Y-%m-%d') AS reported_date, physical_progress_pct, days_delayed, geo_latitude, inspected_by FROM joined""", "joined"))
def _(t):
    return H.load_joined(t).select("project_id", "sector", "current_status", "sanctioned_amount", "expenditure_amount", "reported_date",
                             "physical_progress_pct", "days_delayed", "geo_latitude", "inspected_by")


@query("h2_reference_date", sql("SELECT project_id, strftime(reported_date, '%Y-%m-%d') AS ref_date, '2000-01-01' AS as_of FROM joined WHERE reported_date IS NOT NULL", "joined"))
def _(t):
    d = H.load_joined(t).filter("reported_date is not null")
    return d.select("project_id", H.ref_date(H.FeatureConfig()).alias("ref_date"), H.ref_date(CFG).alias("as_of"))


DELAY = f"""CASE WHEN days_delayed > 0 THEN days_delayed WHEN actual_completion_date IS NOT NULL AND expected_completion_date IS NOT NULL THEN actual_completion_date - expected_completion_date
  WHEN expected_completion_date IS NOT NULL THEN greatest(0, {REF} - expected_completion_date) ELSE 0 END"""


@query("h3_delay_days", sql(f"SELECT project_id, {DELAY} AS delay_days, {DELAY} > 0 AS is_delayed FROM joined", "joined"))
def _(t):
    return H.delay_days(H.load_joined(t), CFG).select("project_id", "delay_days", "is_delayed")


@query("h4_sanction_sla_delay", sql("SELECT project_id, coalesce(greatest(sanction_date - recommendation_date - 75, 0), 0) AS sanction_sla_delay_days FROM projects", "projects"))
def _(t):
    return H.delay_days(t["projects"], CFG).select("project_id", "sanction_sla_delay_days")


@query("h5_start_date", sql("SELECT project_id, strftime(coalesce(work_order_date, sanction_date, recommendation_date), '%Y-%m-%d') AS start_date FROM projects", "projects"))
def _(t):
    return t["projects"].select("project_id", H.start_date().alias("start_date"))


def _pos(a, b):
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest(0, {a} - {b}) END"


START = "coalesce(work_order_date, sanction_date, recommendation_date)"


@query("h6_durations", sql(f"""SELECT project_id, {_pos('expected_completion_date', START)} AS planned_duration_days, {_pos('actual_completion_date', START)} AS actual_duration_days,
  coalesce({_pos(f'coalesce(actual_completion_date, {REF})', START)}, 0) AS project_duration, coalesce({_pos(REF, START)}, 0) AS elapsed_duration_days FROM projects""", "projects"))
def _(t):
    return H.durations(t["projects"], CFG).select("project_id", "planned_duration_days", "actual_duration_days", "project_duration", "elapsed_duration_days")


@query("h7_stage_durations", sql(f"""SELECT project_id, {_pos('sanction_date', 'recommendation_date')} AS admin_sanction_duration_days, {_pos('work_order_date', 'sanction_date')} AS tendering_duration_days,
  {_pos('expected_completion_date', 'recommendation_date')} AS total_planned_lifecycle_days FROM projects""", "projects"))
def _(t):
    return H.durations(t["projects"], CFG).select("project_id", "admin_sanction_duration_days", "tendering_duration_days", "total_planned_lifecycle_days")


E, S, R, C = "coalesce(expenditure_amount::DOUBLE, 0)", "coalesce(sanctioned_amount::DOUBLE, 0)", "coalesce(released_amount::DOUBLE, 0)", "coalesce(recommended_amount::DOUBLE, 0)"
US = f"CASE WHEN {S} > 0 THEN round_even({E} / {S}, 4) ELSE 0.0 END"
UR = f"CASE WHEN {R} > 0 THEN round_even({E} / {R}, 4) ELSE 0.0 END"


@query("h8_utilization", sql(f"SELECT project_id, ({US})::DOUBLE AS utilization_ratio_sanctioned, ({UR})::DOUBLE AS utilization_ratio_released, (CASE WHEN {R} > 0 THEN {UR} ELSE {US} END)::DOUBLE AS utilization_ratio FROM financials", "financials"))
def _(t):
    return H.utilization(t["financials"], CFG).select("project_id", "utilization_ratio_sanctioned", "utilization_ratio_released", "utilization_ratio")


DEV = f"""round_even({S} - {C}, 2) AS cost_deviation_sanction, (CASE WHEN {C} > 0 THEN round_even(({S} - {C}) / {C} * 100.0, 2) ELSE 0.0 END)::DOUBLE AS cost_deviation_sanction_pct,
  round_even({E} - {S}, 2) AS cost_deviation_expenditure, (CASE WHEN {S} > 0 THEN round_even(({E} - {S}) / {S} * 100.0, 2) ELSE 0.0 END)::DOUBLE AS cost_deviation_expenditure_pct,
  round_even({E} - {S}, 2) > 0 AS has_cost_overrun, round_even(greatest(0.0, {S} - {R}), 2)::DOUBLE AS unreleased_allocation"""


@query("h9_cost_deviation", sql(f"SELECT project_id, {DEV} FROM financials", "financials"))
def _(t):
    return H.cost_deviation(t["financials"], CFG).select("project_id", "cost_deviation_sanction", "cost_deviation_sanction_pct", "cost_deviation_expenditure",
                                                         "cost_deviation_expenditure_pct", "has_cost_overrun", "unreleased_allocation")


PLAN = f"""(CASE WHEN actual_completion_date IS NOT NULL THEN 100.0 WHEN expected_completion_date > work_order_date
  THEN round_even(least(greatest(({REF} - work_order_date) / (expected_completion_date - work_order_date) * 100.0, 0.0), 100.0), 2) ELSE 0.0 END)::DOUBLE"""


@query("h10_planned_schedule", sql(f"SELECT project_id, {PLAN} AS planned_schedule_pct FROM joined", "joined"))
def _(t):
    return H.progress_gap(H.load_joined(t), CFG).select("project_id", "planned_schedule_pct")


PHY, FIN = "least(greatest(coalesce(physical_progress_pct, 0), 0), 100)", "least(greatest(coalesce(financial_progress_pct, 0), 0), 100)"


@query("h11_progress_gap", sql(f"""WITH g AS (SELECT project_id, round_even({PLAN} - {PHY}, 2)::DOUBLE AS progress_gap, round_even({FIN} - {PHY}, 2)::DOUBLE AS progress_gap_fin_phy FROM joined)
  SELECT *, progress_gap > 0 AS is_schedule_lagging, progress_gap_fin_phy > 15 AS is_disbursement_skewed FROM g""", "joined"))
def _(t):
    return H.progress_gap(H.load_joined(t), CFG).select("project_id", "progress_gap", "progress_gap_fin_phy", "is_schedule_lagging", "is_disbursement_skewed")


BENCH = """b AS (SELECT project_id, sector, greatest(coalesce(sanctioned_amount::DOUBLE, recommended_amount::DOUBLE, 0), 0)::DOUBLE AS x FROM projects LEFT JOIN financials USING (project_id)),
  s AS (SELECT sector, avg(x) AS m, quantile_cont(x, 0.5) AS med, coalesce(stddev_samp(x), 0) AS sd, min(x) AS lo, max(x) AS hi, count(*) AS n FROM b GROUP BY 1)"""


@query("h12_sector_benchmarks", sql(f"""WITH {BENCH} SELECT project_id, round_even(m, 2) AS category_mean_cost, round_even(med, 2) AS category_median_cost, round_even(sd, 2) AS category_std_cost, lo AS category_min_cost,
  hi AS category_max_cost, n AS category_project_count FROM b JOIN s USING (sector)""", "projects", "financials"))
def _(t):
    d = t["projects"].select("project_id", "sector").join(t["financials"], "project_id", "left")
    return H.category_benchmarks(d, CFG).select("project_id", "category_mean_cost", "category_median_cost", "category_std_cost", "category_min_cost",
                                                "category_max_cost", "category_project_count")


@query("h13_relative_cost", sql(f"""WITH {BENCH} SELECT project_id, round_even(x / m, 4) AS cost_relative_to_category, round_even((x - m) / sd, 4) AS cost_category_zscore FROM b JOIN s USING (sector)""", "projects", "financials"))
def _(t):
    d = t["projects"].select("project_id", "sector").join(t["financials"], "project_id", "left")
    return H.category_benchmarks(d, CFG).select("project_id", "cost_relative_to_category", "cost_category_zscore")


@query("h14_feature_pipeline", sql(f"""WITH {BENCH} SELECT project_id, {DELAY} AS delay_days, coalesce({_pos(f'coalesce(actual_completion_date, {REF})', START)}, 0) AS project_duration,
  (CASE WHEN {R} > 0 THEN {UR} ELSE {US} END)::DOUBLE AS utilization_ratio, {DEV}, {PLAN} AS planned_schedule_pct, round_even({PLAN} - {PHY}, 2)::DOUBLE AS progress_gap,
  round_even(m, 2) AS cost_per_category, round_even((x - m) / sd, 4) AS cost_category_zscore FROM joined JOIN b USING (project_id) JOIN s ON b.sector = s.sector""", "joined"))
def _(t):
    return H.feature_pipeline(H.load_joined(t), CFG).select(
        "project_id", "delay_days", "project_duration", "utilization_ratio", "cost_deviation_sanction", "cost_deviation_sanction_pct", "cost_deviation_expenditure",
        "cost_deviation_expenditure_pct", "has_cost_overrun", "unreleased_allocation", "planned_schedule_pct", "progress_gap", "cost_per_category", "cost_category_zscore")


@query("h15_stored_features", sql(f"""WITH {BENCH} SELECT project_id, {DELAY} AS delay_days, coalesce({_pos(f'coalesce(actual_completion_date, {REF})', START)}, 0) AS project_duration,
  (CASE WHEN abs(round({US}, 4)) < 100 THEN {US} END)::DOUBLE AS utilization_ratio_sanctioned, round_even(m, 2) AS cost_per_category,
  {_pos('actual_completion_date', START)} AS actual_duration_days FROM joined JOIN b USING (project_id) JOIN s ON b.sector = s.sector""", "joined"))
def _(t):
    return H.stored_features(H.feature_pipeline(H.load_joined(t), CFG)).select("project_id", "delay_days", "project_duration", "utilization_ratio_sanctioned",
                                                                         "cost_per_category", "actual_duration_days")
