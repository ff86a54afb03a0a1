"""Writers: dual-format sink, full refresh with a count check, and keyed upserts."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from civicledger.schemas import LOAD_ORDER, TABLES


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares through spark.checkpoint.dir. A session without
    that setting must be local; it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        import tempfile
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, mode: str = "overwrite", csv: bool = True) -> None:
    """Parquet for later jobs and, as the published form, CSV next to it."""
    df.write.mode(mode).parquet(path + "/parquet")
    if csv:
        df.write.mode(mode).option("header", True).csv(path + "/csv")


def derived_only(featured: DataFrame, source: DataFrame, key: str = "project_id") -> DataFrame:
    """The key and the columns the source did not have (what the feature sink keeps)."""
    return featured.select(key, *[c for c in featured.columns if c not in source.columns])


def overwrite_table(df: DataFrame, path: str, expected_rows: int | None = None) -> int:
    """Full refresh, then a count of what was written."""
    df.write.mode("overwrite").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if expected_rows is not None and n != expected_rows:
        raise ValueError(f"{path}: {n} rows written, {expected_rows} expected")
    return n


def upsert(target: DataFrame, incoming: DataFrame, pk: list[str], update: list[str] | None = None) -> DataFrame:
    """Insert new keys and, on a known key, replace the listed columns that the incoming rows carry.

    ``update`` None means every shared non-key column; an empty list means keep existing rows.
    Both sides are shuffled once on the key by one full outer join.
    """
    cols = target.columns
    shared = [c for c in incoming.columns if c in cols]
    update = [c for c in (shared if update is None else update) if c in shared and c not in pk]
    t = target.select(*pk, F.struct(*cols).alias("__t"))
    i = incoming.select(*pk, F.struct(*shared).alias("__i"))
    both = t.join(i, pk, "full")
    old, new = F.col("__t").isNotNull(), F.col("__i").isNotNull()

    def pick(c: str):
        if c in pk:
            return F.col(c)
        kept = F.col(f"__t.{c}")
        if c not in shared:
            return kept.alias(c)
        fresh = F.col(f"__i.{c}")
        value = F.when(old & ~new, kept).when(~old, fresh)
        return value.otherwise(fresh if c in update else kept).alias(c)

    return both.select(*[pick(c) for c in cols])


def load_all(spark: SparkSession, incoming: dict[str, DataFrame], root: str, version: str) -> dict[str, int]:
    """Upsert every incoming table in parent-first order into ``root/<table>/<version>``. The previous
    version is never overwritten while it is read, so a failed job can simply run again."""
    written = {}
    for name in LOAD_ORDER:
        if name not in incoming:
            continue
        spec = TABLES[name]
        df = incoming[name].select(*[c for c in incoming[name].columns if c in spec.schema.names and c not in spec.generated])
        old = _latest(spark, f"{root}/{name}", version)
        new = upsert(old, df, list(spec.pk), spec.updates) if old is not None else df
        written[name] = overwrite_table(new, f"{root}/{name}/{version}")
    return written


def _latest(spark: SparkSession, path: str, before: str) -> DataFrame | None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(fs_path) if s.getPath().getName() < before)
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate result to the shared folder and read it back: a table used by several
    branches is computed once, and its lineage is cut at data that survives lost executors. Zstandard takes about half
    the disk of Spark's default."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
