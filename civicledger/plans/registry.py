"""Catalogue of named queries: a builder over the table bindings and, where possible, its SQL twin."""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from civicledger.plans.bindings import Tables


class Query(NamedTuple):
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(fn, sql)
        return fn
    return add


def flat(df: DataFrame) -> DataFrame:
    """Plain column types for exchange: long, double, boolean and string only."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType | T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.concat_ws("|", c)
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(CATALOG[name].build(Tables(spark, sf_dir)))
