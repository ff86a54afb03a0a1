"""Shares of changes that miss a half in their 16th decimal."""
from pyspark.sql import functions as F

from civicledger.operators import history as K


def test_shares_of_changes_take_a_missed_half_as_the_half(spark):
    rows = [(18000.0, 18081.0), (16000.0, 15420.0), (18000.0, 18000.0), (40000.0, 39990.0)]
    d = spark.createDataFrame(rows, "a double, b double").select(F.struct(F.col("a").alias("released_amount")).alias("p"), F.struct(F.col("b").alias("released_amount")).alias("c"))
    got = [[(c["delta_pct"], c["summary"].rsplit(" (", 1)[1]) for c in r[0]] for r in d.select(K.field_changes("p", "c", {"released_amount"})).collect()]
    assert got == [[(0.45, "+0.5%)).")], [(-3.63, "-3.6%)).")], [], [(-0.03, "-0.0%)).")]]
