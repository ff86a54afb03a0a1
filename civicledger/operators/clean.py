"""Cleaning operators: duplicates, typed frames, logic flags, reconciliations and the state dimension."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from civicledger import fixed_values as fv
from civicledger.functions import columns as X


def dedupe_exact(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows, and a one-row frame with the number of rows removed."""
    counts = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    removed = counts.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_removed"),
                         F.count(F.lit(1)).alias("n_kept"))
    return counts.drop("__n"), removed


def add_rates(df: DataFrame) -> DataFrame:
    """Utilization, sanction and completion rates plus the two row-logic flags."""
    df = df.withColumns({
        "utilization_rate_pct": X.safe_pct("expenditure_cr", "released_cr"),
        "sanction_rate_pct": X.safe_pct("works_sanctioned", "works_recommended"),
        "completion_rate_pct": X.safe_pct("works_completed", "works_sanctioned")})
    return add_logic_flags(df)


def add_logic_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_utilization_valid": F.col("utilization_rate_pct").between(0, 100),
        "is_workflow_valid": (F.col("works_completed") <= F.col("works_sanctioned"))
        & (F.col("works_sanctioned") <= F.col("works_recommended"))})


def reconcile_total(items: DataFrame, footer: DataFrame, amount: str, total: str, tol: float = 0.01) -> DataFrame:
    """Compare the sum of item amounts with the reported footer total (one row out)."""
    left = items.agg(F.sum(amount).alias("computed_total"), F.count(F.lit(1)).alias("n_items"))
    right = footer.agg(F.sum(total).alias("reported_total"))
    both = left.select("*", F.lit(1).alias("__k")).join(right.select("*", F.lit(1).alias("__k")), "__k").drop("__k")
    return both.withColumn("reconciled", F.abs(F.col("computed_total") - F.col("reported_total")) < tol)


def clean_consents(raw: DataFrame) -> DataFrame:
    """Relief consents: split names, label the house, scale amounts."""
    return (raw.withColumn("__n", X.split_honorific("raw_name"))
            .select("s_no", F.col("__n.honorific").alias("honorific"), F.col("__n.mp_name").alias("mp_name"),
                    X.map_house("house_code").alias("house_of_parliament"), "consented_amount_inr",
                    X.to_lakh("consented_amount_inr").alias("consented_amount_lakhs"),
                    "consent_date", "tenure_start_date", "tenure_end_date"))


def build_master_dim(states: DataFrame, const: DataFrame, qa: DataFrame) -> DataFrame:
    """State dimension: seat counts by reservation joined to state finances."""
    cat = F.col("reservation_category")
    seats = const.groupBy("canonical_state_key").agg(
        F.count(F.lit(1)).alias("total_lok_sabha_seats"), F.count_if(cat == "General").alias("general_seats"),
        F.count_if(cat == "SC").alias("sc_reserved_seats"), F.count_if(cat == "ST").alias("st_reserved_seats"))
    money = qa.select("canonical_state_key", F.col("released_cr").alias("cumulative_released_cr"),
                      F.col("expenditure_cr").alias("cumulative_expenditure_cr"), "unspent_balance_cr",
                      F.col("utilization_rate_pct").alias("utilization_pct"),
                      F.col("works_completed").alias("works_completed_count"))
    share = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("total_lok_sabha_seats")) * 100, 2)
    return (states.join(seats, "canonical_state_key", "left").join(money, "canonical_state_key", "left")
            .select("state_id", "state_name", "canonical_state_key", "category", "total_lok_sabha_seats",
                    "general_seats", "sc_reserved_seats", "st_reserved_seats",
                    share("sc_reserved_seats").alias("sc_seat_share_pct"),
                    share("st_reserved_seats").alias("st_seat_share_pct"),
                    F.lit(fv.STATUTORY_SC_PCT).alias("statutory_sc_allocation_pct"),
                    F.lit(fv.STATUTORY_ST_PCT).alias("statutory_st_allocation_pct"),
                    "cumulative_released_cr", "cumulative_expenditure_cr", "unspent_balance_cr",
                    "utilization_pct", "works_completed_count"))


def sanitize_types(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Cast text columns to a declared schema; blanks and bad values become NULL, then defaults."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        s = F.trim(F.col(f"`{f.name}`").cast("string"))
        s = F.when(s != "", s)
        c = s if isinstance(f.dataType, T.StringType) else s.try_cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def expectation_report(df: DataFrame, rules: dict[str, tuple]) -> DataFrame:
    """Evaluate aggregate rules {name: (aggregate column, expected)} in one pass."""
    aggs = [agg.cast("double").alias(f"__a{i}") for i, (agg, _) in enumerate(rules.values())]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(float(exp)).alias("expected"), F.col(f"__a{i}").alias("actual"))
        for i, (name, (_, exp)) in enumerate(rules.items())])).alias("r")
    return one.select(rows).select("r.*").withColumn("passed", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def assert_expectations(df: DataFrame, rules: dict[str, tuple]) -> DataFrame:
    """Hard gate: raise when a rule fails (the report has one row per rule)."""
    report = expectation_report(df, rules)
    failed = [r.rule for r in report.filter(~F.col("passed")).collect()]
    if failed:
        raise ValueError("expectations failed: " + ", ".join(failed))
    return df
