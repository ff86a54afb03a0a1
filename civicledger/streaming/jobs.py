"""Structured Streaming versions: snapshot versioning, exactly-once ingest, progress and transactions."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from civicledger.operators import history as K
from civicledger.sources.sinks import upsert, work_dir


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def stream_snapshots(updates: DataFrame, fields: dict[str, float], watermark: str | None = None, event_ts: str = "event_ts") -> DataFrame:
    """Accepted versions of a full-state update stream. The state is the last accepted version of each
    project; the key has one writer, so concurrent updates are serialised. With a watermark, rows later
    than it are dropped before they reach the state (the one deliberate difference from stamping
    arrival time). Spark filters late rows for a grouped state that has an event-time timeout, but by the
    watermark of the batch before; rows between that and the present one are dropped here. No timeout is
    ever set, so the state itself does not expire."""
    names, tol = list(fields), np.array(list(fields.values()))
    stream = updates.withWatermark(event_ts, watermark) if watermark else updates
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = last = np.array(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values([event_ts, "update_id"], kind="stable")
        if watermark:
            rows = rows[rows[event_ts] > pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")]
            if rows.empty:
                return
        kept, last = K.kept_rows(rows[names].to_numpy(float), last, tol)
        out = rows.iloc[kept][["project_id", event_ts, "update_id", *names]].copy()
        summary = []
        for v in out[names].to_numpy(float):
            summary.append("baseline" if before is None else "; ".join(f"{n}: {a:g} -> {b:g}" for n, a, b, t in zip(names, before, v, tol) if abs(b - a) >= t))
            before = v
        state.update(tuple(float(x) for x in last))
        out["changes"] = summary
        yield out

    types = dict(updates.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ["project_id", event_ts, "update_id", *names]) + ", changes string"
    return stream.groupBy("project_id").applyInPandasWithState(step, schema, ", ".join(f"{n} double" for n in names), "append", timeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


class BucketTable:
    """A keyed table in hash buckets of its key, as Spark's writer lays it out: bucket=k/batch=b.

    A micro-batch reads only the buckets its keys fall into and writes those again under its own batch id;
    the newest batch of a bucket is the live one and all other buckets stay untouched. The folder a batch
    reads is never one it writes: a batch that is replayed after a failure starts from the batches before
    it and replaces what it left behind, so transactions that add up are applied once. Batches that no
    replay can need are removed. Executors need no state: a lost task only reads its files again.

    A bucket should hold a few files' worth of rows: choose ``buckets`` by the size of the table. A null
    key is a key like any other. Rows of one bucket may be spread over several files.
    """

    def __init__(self, spark: SparkSession, root: str, seed: DataFrame, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root, seed.schema, keys, buckets
        self._write(seed, -1)

    def bucket(self, df: DataFrame) -> Column:
        """The bucket of each row; keys are read in the table's types, so that equal keys hash alike."""
        return F.pmod(F.xxhash64(*[F.col(k).cast(self.schema[k].dataType) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of a micro-batch: at most ``buckets`` numbers reach the driver."""
        return [r["bucket"] for r in batch.select(self.bucket(batch).alias("bucket")).distinct().collect()]

    def versions(self) -> dict[int, list[int]]:
        """Batches stored per bucket, oldest first: names of folders, no data."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/bucket=*/batch=*")
        found: dict[int, list[int]] = {}
        for s in pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern):
            path = s.getPath()
            found.setdefault(int(path.getParent().getName()[7:]), []).append(int(path.getName()[6:]))
        return {k: sorted(v) for k, v in found.items()}

    def _folder(self, bucket: int, batch: int) -> str:
        return f"{self.root}/bucket={bucket}/batch={batch}"

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The live rows, or those before a batch, of all or some buckets."""
        live = []
        for k, stored in self.versions().items():
            stored = [v for v in stored if before is None or v < before]
            if stored and (buckets is None or k in buckets):
                live.append(self._folder(k, stored[-1]))
        return self.spark.read.schema(self.schema).parquet(*live) if live else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame, batch_id: int) -> None:
        rows = df.select(*self.schema.names)
        rows = rows.withColumns({"bucket": self.bucket(rows), "batch": F.lit(batch_id)})
        (rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "batch").parquet(self.root))

    def merge(self, batch: DataFrame, batch_id: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets that ``batch`` touches by ``change(rows before, batch)``, which must keep
        every key and add only keys of the batch."""
        batch = batch.persist()
        touched = self.touched(batch)
        if touched:
            self._write(change(self.read(before=batch_id, buckets=touched), batch), batch_id)
        batch.unpersist()
        self._expire(batch_id, touched)

    def _expire(self, batch_id: int, buckets: list[int]) -> None:
        """Remove all but the newest batch before this one, from which a replay starts."""
        jvm = self.spark._jvm
        stored = self.versions()
        for k in buckets:
            for old in [v for v in stored.get(k, []) if v < batch_id][:-1]:
                path = jvm.org.apache.hadoop.fs.Path(self._folder(k, old))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _run_batches(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_upsert(stream: DataFrame, table: BucketTable, keys: list[str], checkpoint: str, prepare=lambda b: b) -> None:
    """Merge each micro-batch into the table. Rows equal to what is stored change nothing."""
    _run_batches(stream, checkpoint, lambda b, n: table.merge(prepare(b), n, lambda cur, new: upsert(cur, new, keys)))


def stream_progress(stream: DataFrame, table: BucketTable, checkpoint: str) -> None:
    """Progress reports merged per project and day."""
    _run_batches(stream, checkpoint, lambda b, n: table.merge(b, n, K.merge_progress))


def stream_transactions(stream: DataFrame, finances: BucketTable, checkpoint: str) -> None:
    """Releases, bills and sanctions applied to the finance table. ``finances`` keeps the project fields
    a sanction changes, so that the next batch builds on them. Transactions of unknown projects are left out."""
    own = ["project_id", "current_status", "sanction_date", "implementing_agency"]
    _run_batches(stream, checkpoint, lambda b, n: finances.merge(b, n, lambda cur, tx: K.apply_transactions(cur.drop(*own[1:]), cur.select(*own), tx)))


def fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    root = work_dir(spark, name)
    return root + "/out", root + "/checkpoint"
