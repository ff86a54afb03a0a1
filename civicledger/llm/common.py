"""Shared folder, staging and input preparation of the corpus operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BLANKS = " \t\n\x0b\f\r"


def shared_root(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir. A local session without that setting
    (tests) gets a folder of its own; a cluster must name one that all executors reach."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/llm-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back: later jobs start from files
    that outlive any executor, and a table that several jobs use is computed once."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reclaim(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs. Spark deletes them when the driver's plans are garbage
    collected, which a quiet driver may not do for half an hour."""
    import gc
    gc.collect()
    spark._jvm.System.gc()


def drop_staged(spark: SparkSession) -> None:
    """Remove everything this application has staged; call it once the results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text read as the empty one; all other columns are left behind, so
    their names cannot clash with anything an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_text(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
