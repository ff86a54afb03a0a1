"""Chains of kept versions against a plain fold."""
import numpy as np
import pandas as pd
import pytest

from civicledger.operators import chains as C

TOL = {"a": 1.0, "b": 2.0}


def plain(rows: pd.DataFrame) -> list:
    out, last, tol = [], {}, np.array(list(TOL.values()))
    for r in rows.sort_values(["k", "ts", "u"]).itertuples(index=False):
        v = np.array([r.a, r.b], float)
        if r.k not in last or (np.abs(v - last[r.k]) >= tol).any():
            last[r.k] = v
            out.append((r.k, r.u))
    return sorted(out)


def histories(seed: int) -> pd.DataFrame:
    """Slow drifts, long rests with a jump, noise and short histories."""
    g, parts = np.random.default_rng(seed), []
    shapes = {1: np.cumsum(g.normal(0.01, 0.02, 700)), 2: np.r_[np.zeros(400), 5.0, np.zeros(200)], 3: g.normal(0, 0.4, 500), 4: np.arange(600) * 0.013,
              5: np.zeros(300), 6: np.array([0.0]), 7: np.array([0.0, 0.5, 1.0])}
    for k, a in shapes.items():
        b = np.cumsum(g.normal(0, 0.05, len(a)))
        parts.append(pd.DataFrame({"k": k, "ts": np.arange(len(a)) // 3, "u": np.arange(len(a)) + 10_000 * k, "a": a, "b": np.where(g.random(len(a)) < 0.1, np.nan, b)}))
    return pd.concat(parts).sample(frac=1, random_state=seed)


@pytest.mark.parametrize("seed, width", [(1, 4), (2, 16)])
def test_follow_equals_a_plain_fold(spark, monkeypatch, seed, width):
    monkeypatch.setattr(C, "WIDTH", width)
    rows = histories(seed)
    df = spark.createDataFrame(rows, "k int, ts int, u int, a double, b double").repartition(5)
    got = sorted((r.k, r.u) for r in C.follow(df, "k", ["ts", "u"], TOL).collect())
    assert got == plain(rows)


def test_follow_empty_and_null_key(spark):
    schema = "k int, ts int, u int, a double, b double"
    assert C.follow(spark.createDataFrame([], schema), "k", ["ts", "u"], TOL).collect() == []
    rows = [(None, 1, 1, 0.0, 0.0), (None, 2, 2, 0.5, 0.0), (None, 3, 3, 1.0, None), (7, 1, 4, None, None), (7, 2, 5, 9.0, None)]
    got = sorted(r.u for r in C.follow(spark.createDataFrame(rows, schema), "k", ["ts", "u"], TOL).collect())
    assert got == [1, 3, 4]


def test_one_slow_project_is_spread(spark, monkeypatch):
    """A project that moves by a thousandth of its tolerance each time lies in many blocks of at most WIDTH rows, in several partitions."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(C, "WIDTH", 512)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # a small table would be read as one partition
    df = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").alias("ts"), F.col("id").alias("u"), (F.col("id") / 1024.0).alias("a"), F.lit(0.0).alias("b"))
    cut = C._cut(df, "k", ["ts", "u"]).groupBy("block").count()
    assert cut.agg(F.max("count")).first()[0] <= C.WIDTH and cut.select((F.col("block") / 2 ** 33).cast("int").alias("p")).distinct().count() > 1
    got = sorted(r.u for r in C.follow(df, "k", ["ts", "u"], TOL).select("u").collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == list(range(0, 60_000, 1024))
