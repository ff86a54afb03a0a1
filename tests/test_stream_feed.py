"""Streams of versions whose arrivals are many files, and rows just behind the watermark."""
from pyspark.sql import functions as F

from civicledger.operators import history as K
from civicledger.plans import q_history as Q
from civicledger.plans.bindings import Tables


def feed(spark, folder, late_rows: bool = False):
    """Two hours of 480 events of four projects, in twelve files."""
    n = F.col("id")
    (spark.range(480).repartition(12).select(
        n.alias("event_id"), F.timestamp_micros(F.lit(1704067200000000) + n * 15_000_000).alias("ts"), (n % 4).alias("user_id"), F.lit("view").alias("event_type"),
        ((n * 37) % 101).cast("double").alias("value"), F.concat(F.lit('{"k": '), (n * 13) % 97, F.lit("}")).alias("props"))
     .withColumn("ts", F.col("ts").cast("timestamp_ntz" if not late_rows else "timestamp")).write.parquet(f"{folder}/events.parquet"))
    return Tables(spark, str(folder))


def same(got, readings):
    want = K.snapshot_chain(readings, Q.FOLD).select(*Q.FOLD_COLS)
    a, b = (sorted(map(tuple, d.collect())) for d in (got, want))
    assert a == b and a


def test_an_arrival_of_many_files_is_one_batch(spark, tmp_path):
    t = feed(spark, tmp_path)
    same(Q._stream_versions(t, "feed1"), t["readings"])


def test_rows_between_the_last_two_watermarks_are_late(spark, tmp_path):
    t = feed(spark, tmp_path, late_rows=True)
    timely = t["readings"].filter(~((F.col("update_id") % 10 == 0) & (F.col("update_id") < 240)))
    same(Q._stream_versions(t, "feed3", late=True, watermark="1 hour"), timely)
