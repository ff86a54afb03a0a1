"""Column profiles of text tables: inferred types, counts, moments, exact quartiles, top values, tags."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from civicledger.operators.ranks import group_quantiles
from civicledger.sources.sinks import staged

DATE_TEXT = r"^(\d{4}-\d{2}-\d{2}|\d{2}-[A-Za-z]{3}-\d{4}|[A-Za-z]{3}\s+\d{1,2},\s+\d{4}.*)$"
MOJIBAKE = ["â\x82¹", "�", "â€", "\xc3\xa2"]


def long_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, raw, value) rows; value is trimmed text, NULL when blank or 'null'."""
    cols = cols or df.columns
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw"))
                                         for c in cols])).alias("x")).select("x.*")
    v = F.trim("raw")
    return long.withColumn("value", F.when((v != "") & (F.lower(v) != "null"), v))


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value, n, padded): the only aggregate of a profile that meets all rows; everything else
    follows from the distinct values and their counts. The NULL value counts missing entries."""
    return long_values(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw").rlike(r"^ | $")).alias("padded"))


def infer_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return _typed(value_counts(df, cols).groupBy("column").agg(*_kinds())).select("column", "inferred_type")


def _kinds() -> list:
    """How many values there are and how many fit none of the kinds, over distinct values."""
    v = F.col("value")
    return [F.sum(F.when(v.isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count_if(~v.rlike(r"^-?\d+$")).alias("__not_int"),
            F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias("__not_float"), F.count_if(~v.rlike(DATE_TEXT)).alias("__not_date")]


def _typed(g: DataFrame) -> DataFrame:
    kind = (F.when(F.col("non_null") == 0, "EMPTY").when(F.col("__not_int") == 0, "INTEGER")
            .when(F.col("__not_float") == 0, "FLOAT").when(F.col("__not_date") == 0, "DATE").otherwise("STRING"))
    return g.withColumn("inferred_type", kind).drop("__not_int", "__not_float", "__not_date")


def top_values(long: DataFrame, k: int = 4) -> DataFrame:
    """Most frequent values per column with share, and the number of other distinct values."""
    counts = long.filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    totals = counts.groupBy("column").agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("unique_values"))
    return ranked.join(totals, "column").withColumns({
        "share_pct": F.round(F.col("n") / F.col("non_null") * 100, 1),
        "other_values": F.greatest(F.col("unique_values") - k, F.lit(0))})


def string_extremes(long: DataFrame) -> DataFrame:
    key = F.struct(F.length("value"), F.col("value"))
    return long.groupBy("column").agg(F.min_by("value", F.when(F.col("value").isNotNull(), key)).alias("min_text"),
                                      F.max_by("value", F.when(F.col("value").isNotNull(), key)).alias("max_text"))


def profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column. The rows are aggregated once, to distinct values with counts; types, extremes and
    moments follow from these, quartiles from their ranks, so no column is gathered in one place."""
    counts = staged(value_counts(df, cols), "profile")
    x, n = F.col("value").try_cast("double"), F.col("n")
    weighed = F.when(x.isNotNull(), n)
    text = F.when(F.col("value").isNotNull(), F.struct(F.length("value"), F.col("value")))
    base = _typed(counts.groupBy("column").agg(
        *_kinds(), F.sum(n).alias("total"), F.count("value").alias("unique_values"), F.min(x).alias("min_value"), F.max(x).alias("max_value"),
        (F.sum(x * n) / F.sum(weighed)).alias("__mean"), F.sum(weighed).alias("__numbers"), F.sum("padded").alias("padded"),
        F.sum(F.when(F.col("value").rlike("|".join(MOJIBAKE)), n).otherwise(0)).alias("mojibake"),
        F.min_by("value", text).alias("min_text"), F.max_by("value", text).alias("max_text")))
    # deviations are taken from the mean itself, as squares of large numbers would cancel
    mean = counts.groupBy("column").agg((F.sum(x * n) / F.sum(weighed)).alias("__mean"))
    spread = counts.join(F.broadcast(mean), "column").groupBy("column").agg(F.sum(n * F.pow(x - F.col("__mean"), 2)).alias("__square"))
    quart = group_quantiles(counts.select("column", x.alias("x"), "n"), ["column"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, weight="n").drop("n")
    out = base.join(spread, "column").join(quart, "column", "left").withColumns({
        "mean_value": F.round("__mean", 2), "std_value": F.round(F.sqrt(F.col("__square") / F.col("__numbers")), 2)}).drop("__mean", "__square", "__numbers")
    num = F.col("inferred_type").isin("INTEGER", "FLOAT")
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * 100, 2)).otherwise(0.0)
    out = out.withColumns({
        "null_count": F.col("total") - F.col("non_null"), "duplicate_count": F.col("non_null") - F.col("unique_values"),
        **{c: F.when(num, F.col(c)) for c in ("min_value", "max_value", "mean_value", "std_value", "q1", "median", "q3")}})
    out = out.withColumns({"null_pct": pct("null_count", "total"), "unique_pct": pct("unique_values", "non_null")})
    t = lambda c: F.format_string("%.2f", F.col(c))
    summary = F.concat(F.lit("Min: "), t("min_value"), F.lit(" | Q1: "), t("q1"), F.lit(" | Med: "), t("median"),
                       F.lit(" | Q3: "), t("q3"), F.lit(" | Max: "), t("max_value"))
    return out.withColumn("distribution", F.when(num, summary))


def quality_tags(prof: DataFrame) -> DataFrame:
    """Issue tags of a profile, joined with '; '."""
    num = F.col("inferred_type").isin("INTEGER", "FLOAT")
    several, pct = F.col("non_null") > 1, F.col("null_pct")
    tags = F.array_compact(F.array(
        F.when(num & (F.col("min_value") < 0) & ~F.lower("column").contains("variance"), "Negative values present in non-variance metric"),
        F.when(num & several & (F.col("min_value") == F.col("max_value")), "Constant column (zero variance)"),
        F.when(pct > 50, F.concat(F.lit("Critical missingness (>50% null: "), pct, F.lit("%)")))
         .when(pct > 15, F.concat(F.lit("Moderate missingness ("), pct, F.lit("% null)"))),
        F.when((F.col("unique_values") == 1) & several, "Single unique value across all rows"),
        F.when((F.col("unique_values") == F.col("total")) & (F.col("null_count") == 0), "Candidate Primary Key (100% unique, 0% null)"),
        F.when(F.col("padded") > 0, "Leading/trailing whitespace detected in raw values"),
        F.when(F.col("mojibake") > 0, "Potential UTF-8 mojibake / encoding artifact detected")))
    text = F.when(F.size(tags) == 0, "No quality anomalies detected (Clean)").otherwise(F.concat_ws("; ", tags))
    return prof.select("column", text.alias("quality_tags"))


# Features that may be negative in the feature report.
SIGNED = {"delay_days", "cost_category_zscore", "progress_gap", "progress_gap_schedule", "progress_gap_fin_phy", "cost_deviation",
          "cost_deviation_sanction", "cost_deviation_sanction_pct", "cost_deviation_expenditure", "cost_deviation_expenditure_pct"}


def feature_report(df: DataFrame, features: list[str], signed: set[str] = frozenset(SIGNED)) -> DataFrame:
    """Range, centre, missing and invalid counts and three example values per feature."""
    types = dict(df.dtypes)
    num = lambda c: F.col(c).cast("int").cast("double") if types[c] == "boolean" else F.col(c).cast("double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), num(c).alias("x"), F.col(c).cast("string").alias("s"))
                                         for c in features])).alias("f")).select("f.*")
    x = F.col("x")
    inf = x.isin(float("inf"), float("-inf"))
    neg = ~F.col("feature").isin(list(signed)) & (x < 0)
    base = long.groupBy("feature").agg(
        F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.round(F.avg(x), 4).alias("mean"),
        F.count_if(x.isNull()).alias("missing_count"), F.count_if(inf | neg).alias("invalid_count"))
    med = group_quantiles(long, ["feature"], "x", {"median": 0.5}).drop("n")
    vals = long.filter("s is not null").groupBy("feature", "s").agg(F.min("x").alias("x"))
    w = Window.partitionBy("feature").orderBy("x", "s")
    ex = (vals.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("feature")
          .agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda e: e["s"])).alias("example_values")))
    return base.join(med, "feature", "left").join(ex, "feature", "left")
