"""Halves that a double cannot hold."""
from pyspark.sql import functions as F

from civicledger.functions import columns as X


def test_multiples_and_percentages_round_as_the_double_lies(spark):
    d = spark.createDataFrame([(1.015,), (0.545,), (0.125,), (2.0,), (-0.001,)], "x double")
    got = [r[0] for r in d.select(X.fmt_mult(F.col("x"))).collect()]
    assert got == ["1.01×", "0.55×", "0.12×", "2×", "0×"]
    assert d.select(X.fmt_pct(F.lit(1.015), 2, False)).first()[0] == "1.01%"
