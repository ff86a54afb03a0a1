"""Exact ranks and order statistics that never hold a whole group in one task.

Values are first collapsed to distinct (group, value) rows with weights, which also melts ties.
A monotone bucket of the value then splits each group: bucket totals are few and give offsets,
and the running count inside a bucket completes the rank. Nothing is approximate; a bad bucket
choice only changes how even the tasks are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS_PER_OCTAVE = 256


def value_bucket(v: Column) -> Column:
    """Non-decreasing bucket number of a double: about 0.3 % wide, so a few thousand per group."""
    return F.floor(F.signum(v) * F.log2(F.abs(v) + 1.0) * BUCKETS_PER_OCTAVE).cast("bigint")


def value_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct (keys, value) rows with: cnt, below (weight of smaller values), upto (below + cnt)
    and n (weight of the whole group). Rows of weight 0 get ranks without counting. NaN is missing, as
    null is; infinities rank at the ends."""
    w = F.col(weight) if weight else F.lit(1)
    rows = (df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
            .groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.sum(w).cast("bigint").alias("cnt"))
            .withColumn("__b", value_bucket(F.col(value))))
    buckets = rows.groupBy(*keys, "__b").agg(F.sum("cnt").alias("__c"))
    over_group = Window.partitionBy(*keys)
    buckets = buckets.select(
        *keys, "__b",
        (F.sum("__c").over(over_group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__off"),
        F.sum("__c").over(over_group).alias("n"))
    inside = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(buckets, [*keys, "__b"])
            .withColumn("upto", F.col("__off") + F.sum("cnt").over(inside))
            .withColumn("below", F.col("upto") - F.col("cnt")).drop("__b", "__off"))


def order_stats(ranked: DataFrame, keys: list[str], value: str, positions: Column, carry: list[Column] = ()) -> DataFrame:
    """Per group a map position -> value for the 0-based positions in the array column ``positions``
    (an expression over n). At most one row per position reaches the aggregate."""
    hit = F.filter(positions, lambda p: (p >= F.col("below")) & (p < F.col("upto")))
    rows = ranked.select(*keys, "n", F.col(value).alias("__v"), F.explode(hit).alias("__p"))
    return rows.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("__p", "__v")))).alias("stats"))


def quantile_positions(q: float) -> tuple[Column, Column]:
    pos = (F.col("n") - 1) * F.lit(float(q))
    lo = F.floor(pos).cast("bigint")
    return lo, pos - lo


def interpolate(lo: Column, hi: Column, frac: Column) -> Column:
    return F.when(frac == 0, lo).otherwise(lo * (1 - frac) + hi * frac)


def group_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of ``qs``; a row stands for ``weight`` equal ones."""
    ranked = value_ranks(df, keys, value, weight)
    pos = {name: quantile_positions(q) for name, q in qs.items()}
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(lo, lo + 1) for lo, _ in pos.values()])))
    stats = order_stats(ranked, keys, value, wanted)
    at = lambda p: F.element_at("stats", p)
    return stats.select(*keys, "n", *[interpolate(at(lo), at(lo + 1), fr).alias(name) for name, (lo, fr) in pos.items()])


def chunked_previous(df: DataFrame, key: str, order: list[str], chunk: Column, take: list[str]) -> DataFrame:
    """Previous row's values per key (like lag) with a hot key split into chunks.

    ``chunk`` must not decrease along the order. Inside a chunk it is a plain lag; the first row of
    a chunk takes the last row of the nearest earlier chunk, found on one summary row per chunk.
    """
    row = F.struct(*take)
    d = df.withColumn("__ch", chunk)
    w = Window.partitionBy(key, "__ch").orderBy(*order)
    d = d.withColumn("__prev", F.lag(row).over(w))
    last = d.groupBy(key, "__ch").agg(F.max_by(row, F.struct(*order)).alias("__last"))
    wc = Window.partitionBy(key).orderBy("__ch")
    carried = last.select(key, "__ch", F.lag("__last").over(wc).alias("__carry"))
    return (d.join(carried, [key, "__ch"]).withColumn("previous", F.coalesce("__prev", "__carry"))
            .drop("__ch", "__prev", "__carry"))
