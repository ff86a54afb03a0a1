"""Project features: delays, durations, utilization, cost deviation, progress gaps, sector benchmarks."""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from civicledger.functions import columns as X
from civicledger.operators.ranks import group_quantiles
from civicledger.operators.views import last_non_null_per_key


@dataclass(frozen=True)
class FeatureConfig:
    as_of: dt.date | None = None
    positive_means_delayed: bool = True
    sanction_sla_days: int = 75
    epsilon: float = 1e-6
    skew_points: float = 15.0


def _num(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _pos_days(later: Column, earlier: Column) -> Column:
    """max(0, days) that stays NULL when a date is missing."""
    return X.clip(F.datediff(later, earlier), 0)


def load_joined(t) -> DataFrame:
    """Projects with finance and, column by column, the last known progress values; of reports of one day
    the one with the highest progress_id is the last."""
    p, f = t["projects"], t["financials"]
    pr = last_non_null_per_key(t["progress"], "project_id", ["reported_date", "progress_id"]).drop("progress_id")
    f = f.drop(*[c for c in f.columns if c in p.columns and c != "project_id"])
    seen = {*p.columns, *f.columns}
    pr = pr.drop(*[c for c in pr.columns if c in seen and c != "project_id"])
    return p.join(f, "project_id", "left").join(pr, "project_id", "left")


def ref_date(cfg: FeatureConfig) -> Column:
    return F.lit(cfg.as_of) if cfg.as_of else F.coalesce("reported_date", F.current_date())


def delay_days(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    exp, act = F.col("expected_completion_date"), F.col("actual_completion_date")
    d = (F.when(act.isNotNull() & exp.isNotNull(), F.datediff(act, exp))
         .when(exp.isNotNull(), F.greatest(F.lit(0), F.datediff(ref_date(cfg), exp))).otherwise(F.lit(0)))
    if "days_delayed" in df.columns:
        d = F.when(F.col("days_delayed") > 0, F.col("days_delayed").cast("int")).otherwise(d)
    d = d if cfg.positive_means_delayed else -d
    sla = F.datediff("sanction_date", "recommendation_date") - cfg.sanction_sla_days
    return df.withColumns({"delay_days": d.cast("int"), "is_delayed": d > 0,
                           "sanction_sla_delay_days": F.coalesce(X.clip(sla, 0), F.lit(0))})


def start_date() -> Column:
    return F.coalesce("work_order_date", "sanction_date", "recommendation_date")


def durations(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    start, exp, act = start_date(), F.col("expected_completion_date"), F.col("actual_completion_date")
    san, rec, wo = F.col("sanction_date"), F.col("recommendation_date"), F.col("work_order_date")
    life = F.coalesce(_pos_days(F.coalesce(act, ref_date(cfg)), start), F.lit(0))
    return df.withColumns({
        "planned_duration_days": _pos_days(exp, start), "actual_duration_days": _pos_days(act, start),
        "project_duration": life, "project_duration_days": life,
        "elapsed_duration_days": F.coalesce(_pos_days(ref_date(cfg), start), F.lit(0)),
        "admin_sanction_duration_days": _pos_days(san, rec), "tendering_duration_days": _pos_days(wo, san),
        "total_planned_lifecycle_days": _pos_days(exp, rec)})


def utilization(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    e, s, r = (F.greatest(_num(f"{c}_amount"), F.lit(0.0)) for c in ("expenditure", "sanctioned", "released"))
    ratio = lambda den: F.when(den > 0, F.bround(e / F.greatest(den, F.lit(cfg.epsilon)), 4)).otherwise(0.0)
    return df.withColumns({"utilization_ratio_sanctioned": ratio(s), "utilization_ratio_released": ratio(r),
                           "utilization_ratio": F.when(r > 0, ratio(r)).otherwise(ratio(s))})


def cost_deviation(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    rec, s, r, e = (_num(f"{c}_amount") for c in ("recommended", "sanctioned", "released", "expenditure"))
    pct = lambda d, base: F.when(base > 0, F.bround(d / F.greatest(base, F.lit(cfg.epsilon)) * 100.0, 2)).otherwise(0.0)
    spent = F.bround(e - s, 2)
    return df.withColumns({
        "cost_deviation_sanction": F.bround(s - rec, 2), "cost_deviation_sanction_pct": pct(s - rec, rec),
        "cost_deviation_expenditure": spent, "cost_deviation_expenditure_pct": pct(e - s, s),
        "cost_deviation": spent, "has_cost_overrun": spent > 0,
        "unreleased_allocation": F.bround(F.greatest(F.lit(0.0), s - r), 2)})


def progress_gap(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    wo, exp = F.col("work_order_date"), F.col("expected_completion_date")
    total, gone = F.datediff(exp, wo), F.datediff(ref_date(cfg), wo)
    plan = (F.when(F.col("actual_completion_date").isNotNull(), 100.0)
            .when(total > 0, F.bround(F.least(F.greatest(gone / total * 100.0, F.lit(0.0)), F.lit(100.0)), 2)).otherwise(0.0))
    phy, fin = (F.least(F.greatest(_num(c), F.lit(0.0)), F.lit(100.0)) for c in ("physical_progress_pct", "financial_progress_pct"))
    lag, skew = F.bround(plan - phy, 2), F.bround(fin - phy, 2)
    return df.withColumns({"planned_schedule_pct": plan, "progress_gap_schedule": lag, "progress_gap": lag,
                           "progress_gap_fin_phy": skew, "is_schedule_lagging": lag > 0,
                           "is_disbursement_skewed": skew > cfg.skew_points})


def category_benchmarks(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), group: str = "sector",
                        cost: str = "sanctioned_amount") -> DataFrame:
    """Sector statistics per row. Groups are few and each may hold a large share of all rows, so the
    median comes from rank arithmetic and the one-row-per-group statistics are joined back."""
    fallback = F.col("recommended_amount").cast("double") if "recommended_amount" in df.columns else F.lit(None)
    own = F.greatest(F.coalesce(F.col(cost).cast("double"), fallback, F.lit(0.0)), F.lit(0.0))
    df = df.withColumns({"__g": F.trim(F.coalesce(F.col(group), F.lit("Uncategorized"))), "__x": own})
    x = F.col("__x")
    stats = df.groupBy("__g").agg(F.avg(x).alias("__m"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("__s"),
                                  F.min(x).alias("__lo"), F.max(x).alias("__hi"), F.count(F.lit(1)).alias("__n"))
    med = group_quantiles(df.select("__g", "__x"), ["__g"], "__x", {"__med": 0.5}).drop("n")
    out = df.join(stats.join(med, "__g"), "__g")
    m, s = F.col("__m"), F.col("__s")
    return out.withColumns({
        "category_mean_cost": F.bround(m, 2), "category_median_cost": F.bround("__med", 2), "category_std_cost": F.bround(s, 2),
        "category_min_cost": F.bround("__lo", 2), "category_max_cost": F.bround("__hi", 2),
        "category_project_count": F.col("__n").cast("int"), "cost_per_category": F.bround(m, 2),
        "cost_relative_to_category": F.bround(x / F.greatest(m, F.lit(cfg.epsilon)), 4),
        "cost_category_zscore": F.when(s < cfg.epsilon, 0.0).otherwise(F.bround((x - m) / F.greatest(s, F.lit(cfg.epsilon)), 4)),
    }).drop("__g", "__x", "__m", "__s", "__lo", "__hi", "__n", "__med")


STEPS = (delay_days, durations, utilization, cost_deviation, progress_gap, category_benchmarks)


def feature_pipeline(joined: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    for step in STEPS:
        joined = step(joined, cfg)
    return joined


def feature_groups() -> dict[str, list[str]]:
    """Column groups: identity, known at recommendation, and known only in flight."""
    return {
        "core_identity": "project_id project_code project_title sector sub_sector state_id constituency_id district_name "
                         "implementing_agency mp_name financial_year current_status".split(),
        "recommendation_time_features": "recommended_amount sanctioned_amount cost_deviation_sanction cost_deviation_sanction_pct "
                                        "cost_per_category cost_relative_to_category cost_category_zscore planned_duration_days "
                                        "admin_sanction_duration_days tendering_duration_days sanction_sla_delay_days "
                                        "category_project_count".split(),
        "in_flight_monitoring_features": "released_amount expenditure_amount unspent_balance utilization_ratio utilization_ratio_sanctioned "
                                         "utilization_ratio_released cost_deviation_expenditure cost_deviation_expenditure_pct has_cost_overrun "
                                         "unreleased_allocation physical_progress_pct financial_progress_pct planned_schedule_pct progress_gap "
                                         "progress_gap_schedule progress_gap_fin_phy delay_days is_delayed elapsed_duration_days "
                                         "actual_duration_days project_duration project_duration_days is_schedule_lagging "
                                         "is_disbursement_skewed".split(),
    }


def stored_features(featured: DataFrame) -> DataFrame:
    """The feature table in its stored types; values too wide for a column become NULL."""
    from civicledger.schemas import TABLES
    fields = TABLES["project_features"].schema.fields
    return featured.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name != "project_id"
                             else F.col("project_id") for f in fields])
