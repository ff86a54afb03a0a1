"""Keyed stream tables: a batch rewrites the buckets it touches, a replay changes nothing."""
from pyspark.sql import functions as F

from civicledger.operators import history as K
from civicledger.sources.sinks import upsert
from civicledger.streaming import jobs as L


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def put(table, batch, batch_id):
    table.merge(batch, batch_id, lambda cur, new: upsert(cur, new, ["project_id"]))


def make(spark, n=100, buckets=16):
    root, _ = L.fresh(spark, "bucket-table")
    seed = spark.range(n).select(F.col("id").alias("project_id"), F.lit(0).cast("long").alias("v"))
    return L.BucketTable(spark, root, seed, ["project_id"], buckets)


def test_a_batch_writes_only_the_buckets_it_touches(spark):
    table = make(spark)
    before = table.versions()
    batch = spark.createDataFrame([(7, 70)], "project_id int, v int")      # narrower types fall into the same bucket
    put(table, batch, 0)
    after = table.versions()
    changed = [k for k in after if after[k] != before[k]]
    assert len(changed) == 1 and after[changed[0]] == [-1, 0] and table.touched(batch) == changed
    assert rows(table.read()) == sorted(((k, 70 if k == 7 else 0) for k in range(100)), key=repr)
    assert rows(table.read(before=0)) == sorted(((k, 0) for k in range(100)), key=repr)


def test_a_merge_reads_only_those_buckets(spark):
    table = make(spark)
    batch = spark.createDataFrame([(7, 70)], "project_id long, v long")
    files = table.read(before=0, buckets=table.touched(batch)).inputFiles()
    assert files and all(f"bucket={table.touched(batch)[0]}/" in f for f in files)


def test_replays_and_unfinished_batches(spark):
    """A batch that was written in part and runs again gives what it would have given at once."""
    table = make(spark)
    add = lambda cur, new: cur.join(new.withColumnRenamed("v", "w"), "project_id", "left").select("project_id", (F.col("v") + F.coalesce("w", F.lit(0))).alias("v"))
    batch = spark.createDataFrame([(k, 1) for k in range(50)], "project_id long, v long")
    half = batch.filter("project_id < 5")
    table.merge(half, 0, add)                                              # the part a failed run left behind
    for _ in range(2):
        table.merge(batch, 0, add)
    assert rows(table.read()) == sorted(((k, int(k < 50)) for k in range(100)), key=repr)
    for n in (1, 2, 2, 3):
        table.merge(batch, n, add)
    assert rows(table.read()) == sorted(((k, 4 * (k < 50)) for k in range(100)), key=repr)
    assert max(len(v) for v in table.versions().values()) == 2             # older batches are gone


def test_empty_seed_new_keys_null_keys_and_empty_batches(spark):
    table = make(spark, n=0)
    assert table.read().count() == 0
    batch = spark.createDataFrame([(1, 1), (None, 2), (3, None)], "project_id long, v long")
    put(table, batch, 0)
    assert rows(table.read()) == rows(batch)
    put(table, batch.filter("false"), 1)
    assert rows(table.read()) == rows(batch)


def test_progress_of_one_project_is_spread(spark):
    """The key is project and day: a project with many reports does not fall into one bucket."""
    root, _ = L.fresh(spark, "bucket-progress")
    seed = spark.createDataFrame([], "project_id long, reported_date date, physical_progress_pct double, current_stage string, milestone_status string")
    table = L.BucketTable(spark, root, seed, ["project_id", "reported_date"], 16)
    new = spark.range(200).selectExpr("1L AS project_id", "date_add(date'2024-01-01', int(id)) AS reported_date", "double(id % 100) AS physical_progress_pct",
                                      "'x' AS milestone_status", "timestamp'2024-01-01 00:00:00' AS event_ts", "id AS update_id")
    table.merge(new, 0, K.merge_progress)
    assert table.read().count() == 200 and len(table.versions()) > 10
