"""File provenance: manifests of size and SHA-256, immutability and shape audits, feature contract."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from civicledger import fixed_values as fv

CHUNK = 4 << 20


def hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 and size of each file in ``path``, read in chunks of CHUNK bytes."""
    from pyarrow import fs

    for batch in batches:
        for path in batch["path"].to_pylist():
            scheme, rest = path.split(":", 1)
            store, name = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(name, compression=None) as f:
                while chunk := f.read(CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
            yield pa.RecordBatch.from_pydict({"path": [path], "size_bytes": [size], "sha256": [digest.hexdigest()]})


def provenance_manifest(spark: SparkSession, path: str, source: str, glob: str | None = None) -> DataFrame:
    """One row per file: name, bytes, SHA-256, source and time.

    The listing names the files without reading them; each task then streams its own files through the
    digest, so a file of any size takes one chunk of memory."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(path).select("path")
    n = files.count()
    return (files.repartition(max(1, min(n, 10_000))).mapInArrow(hash_files, "path string, size_bytes bigint, sha256 string")
            .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "size_bytes", "sha256", F.lit(source).alias("source"), F.current_timestamp().alias("recorded_at"), "path"))


def audit_hashes(now: DataFrame, log: DataFrame) -> DataFrame:
    """Each current file against all hashes ever recorded for its name."""
    known = log.select("file_name", "sha256").distinct().withColumn("__known", F.lit(True))
    return (now.join(known, ["file_name", "sha256"], "left")
            .select("file_name", "sha256", F.when(F.col("__known"), "PASS").otherwise("FAIL").alias("status")))


def audit_shapes(tables: dict[str, DataFrame], expected: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows and columns of each table against what is expected."""
    parts = []
    for name, df in tables.items():
        rows, cols = expected[name]
        parts.append(df.agg(F.count(F.lit(1)).alias("actual_rows")).select(
            F.lit(name).alias("dataset"), F.lit(rows).cast("bigint").alias("expected_rows"), "actual_rows",
            F.lit(cols).alias("expected_columns"), F.lit(len(df.columns)).alias("actual_columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ok = (F.col("expected_rows") == F.col("actual_rows")) & (F.col("expected_columns") == F.col("actual_columns"))
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


VECTOR_DDL = (
    "project_id string, delay_days int, utilization_ratio double, cost_per_category double, progress_gap double, cost_deviation double, "
    "project_duration int, cost_relative_to_category double, sanction_sla_delay_days int, progress_gap_fin_phy double, unreleased_allocation double, "
    "planned_duration_days int, is_delayed boolean, is_schedule_lagging boolean, is_disbursement_skewed boolean, has_cost_overrun boolean")


def feature_vector(df: DataFrame) -> DataFrame:
    """The typed vector; a value that does not fit its type becomes NULL."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(VECTOR_DDL).fields])


def check_feature_contract(df: DataFrame, specs=fv.FEATURE_CONTRACT) -> DataFrame:
    """Missing and out-of-range counts per contracted feature."""
    specs = [s for s in specs if s[0] in df.columns]
    one = df.agg(*[F.count_if(~F.col(n).between(lo, hi)).alias(f"{n}__o") for n, _, _, lo, hi, _ in specs],
                 *[F.count_if(F.col(s[0]).isNull()).alias(f"{s[0]}__m") for s in specs])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(t).alias("data_type"), F.lit(ctx).alias("context"), F.lit(float(lo)).alias("expected_min"),
                                        F.lit(float(hi)).alias("expected_max"), F.lit(imp).alias("imputation"), F.col(f"{n}__o").alias("out_of_range"),
                                        F.col(f"{n}__m").alias("missing")) for n, t, ctx, lo, hi, imp in specs])).alias("r")
    return one.select(rows).select("r.*")
