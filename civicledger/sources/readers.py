"""Schema-first readers for CSV tables and the nested JSON feeds."""
from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from civicledger.functions import columns as X
from civicledger.schemas import TABLES
from civicledger.sources.sinks import staged


class MissingInput(Exception):
    """A required file or column is absent."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def locate(spark: SparkSession, file: str, dirs: list[str]) -> str:
    for d in dirs:
        path = os.path.join(d, file)
        if _exists(spark, path):
            return path
    raise MissingInput(f"{file} not found in {dirs}")


def read_table(spark: SparkSession, table: str, dirs: list[str]) -> DataFrame:
    """Typed CSV scan of a declared table; directories are tried in order."""
    spec = TABLES[table]
    path = locate(spark, spec.file, dirs)
    header = spark.read.option("header", True).csv(path).columns     # header line only
    absent = set(spec.required) - set(header)
    if absent:
        raise MissingInput(f"{spec.file}: missing columns {sorted(absent)}")
    types = {f.name: f for f in spec.schema.fields}
    schema = T.StructType([types.get(h, T.StructField(h, T.StringType())) for h in header])
    return spark.read.option("header", True).schema(schema).csv(path)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """JSON arrays of records: one array per file, or with ``multi_line`` off one array per line (splittable)."""
    return spark.read.option("multiLine", multi_line).schema(schema).json(path)


def _scan(text: str, inside: bool) -> tuple[int, bool]:
    """Change of nesting depth over a fragment that ends in a closing brace, and whether it ends inside a string."""
    parts = (re.sub(r"\\.", "", text, flags=re.S) if "\\" in text else text).split('"')
    depth = sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts[int(inside)::2])
    inside ^= len(parts) % 2 == 0
    return depth - (not inside), inside


def _split_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per byte range: whether it turns the string state, and the change of depth from either state."""
    at, state = None, None
    for pdf in batches:
        out = []
        for file, split, value in zip(pdf["file"], pdf["split"], pdf["value"]):
            if at != (file, split):
                if at:
                    out.append((*at, state[0][1], state[0][0], state[1][0]))
                at, state = (file, split), [(0, False), (0, True)]
            for k in (0, 1):
                depth, inside = _scan(value, state[k][1])
                state[k] = state[k][0] + depth, inside
        yield pd.DataFrame(out, columns=["file", "split", "turns", "outside", "inside"])
    if at:
        yield pd.DataFrame([(*at, state[0][1], state[0][0], state[1][0])], columns=["file", "split", "turns", "outside", "inside"])


def _split_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records of a byte range (piece 0), the end of one begun before it (1) and what is open at its end (2)."""
    cols, at, held, piece = ["file", "split", "piece", "text"], None, [], 0
    depth, inside = 0, False
    for pdf in batches:
        out = []
        for file, split, value, d, s in zip(pdf["file"], pdf["split"], pdf["value"], pdf["depth"], pdf["in_string"]):
            if at != (file, split):
                if held:
                    out.append((*at, 2, "".join(held)))
                at, held, depth, inside = (file, split), [], int(d), bool(s)
                piece = int(depth > 1 or inside)
            held.append(value + "}")
            change, inside = _scan(value, inside)
            depth += change
            if depth == 1 and not inside:
                out.append((*at, piece, "".join(held)))
                held, piece = [], 0
        yield pd.DataFrame(out, columns=cols)
    if held:
        yield pd.DataFrame([(*at, 2, "".join(held))], columns=cols)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold one JSON array of objects, read by many tasks however large a file is.

    Spark cuts the files into byte ranges at closing braces. A first pass notes per range what it does to nesting
    depth and string state, these are summed along the file, and a second pass starts each range in its right state and
    takes out the records; a record over a border is put together from its pieces. Elements that are not objects are
    skipped; a record that does not fit the schema gives nulls, as in Spark's reader; empty files give no rows; a file
    whose array is not closed is an error."""
    text = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("__i"))
    states = staged(text.select("file", "split", "value").mapInPandas(_split_states, "file string, split bigint, turns boolean, outside bigint, inside bigint"), "json-states")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("in_string", F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    states = states.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)))
    # the fragment behind the last brace counts as closed by one more, so a whole file ends one below its start
    ends = states.groupBy("file").agg(F.sum(change).alias("end"), F.count_if("turns").alias("turned"))
    open_file = ends.filter("end <> -1 or turned % 2 = 1").select("file").head(1)
    if open_file:
        raise ValueError(f"{open_file[0]['file']}: the JSON array is not closed")
    pieces = (text.join(states.select("file", "split", "depth", "in_string"), ["file", "split"]).sortWithinPartitions("file", "split", "__i")
              .select("file", "split", "value", "depth", "in_string").mapInPandas(_split_records, "file string, split bigint, piece int, text string"))
    pieces = staged(pieces, "json-pieces")
    parts = pieces.filter("piece > 0").withColumn("__record", F.coalesce(F.sum((F.col("piece") == 1).cast("bigint")).over(
        Window.partitionBy("file").orderBy("split", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = parts.groupBy("file", "__record").agg(F.min("piece").alias("ended"), F.array_sort(F.collect_list(F.struct("split", "piece", "text"))).alias("p"))
    joined = joined.filter("ended = 1").select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    whole = pieces.filter("piece = 0").select("text").unionByName(joined)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return whole.select(F.from_json(F.regexp_replace("text", r"^[^{]*", ""), ddl).alias("r")).select("r.*")


SEAT_MAP = "map<string,struct<state_id:int,constituencies:array<struct<ID:bigint,CAPTION:string>>>>"


def flatten_nested_map(df: DataFrame, text: str) -> DataFrame:
    """{state: {state_id, constituencies: [{ID, CAPTION}]}} text to one row per seat."""
    m = df.select(F.explode(F.from_json(text, SEAT_MAP)).alias("state_name", "s"))
    return m.select(X.title_case("state_name").alias("state_name"), F.col("s.state_id").alias("state_id"),
                    F.explode("s.constituencies").alias("c")).select(
        "state_id", "state_name", F.col("c.ID").alias("constituency_id"), F.upper(X.clean_text("c.CAPTION")).alias("raw_caption"))


def flatten_metric_tiles(df: DataFrame, text: str, skip: tuple[str, ...] = ("Current Tenure",)) -> DataFrame:
    """{label: [inr, crore] or [count, inr, crore]} text to metric rows; a two-part tile has no count."""
    items = df.select(F.explode(F.from_json(text, "map<string,string>")).alias("metric_key", "j")).filter(~F.col("metric_key").isin(list(skip)))
    v = F.from_json("j", "array<string>")
    three = F.size(v) == 3
    at = lambda i2, i3: X.parse_currency(F.when(three, F.try_element_at(v, F.lit(i3))).otherwise(F.try_element_at(v, F.lit(i2))))
    return items.select(X.clean_text("metric_key").alias("metric_key"), F.when(three, F.try_element_at(v, F.lit(1)).try_cast("double")).alias("count_works"),
                        at(1, 2).alias("amount_inr"), at(2, 3).alias("amount_crores"))


def parse_embedded_json(df: DataFrame, field: str, schema: str, keep: list[str] = (), id_field: str = "Sno") -> tuple[DataFrame, DataFrame]:
    """A JSON string holding an array of rows: item rows, and footer rows whose id is missing."""
    rows = df.select(*keep, F.explode(F.from_json(field, f"array<{schema}>")).alias("r")).select(*keep, "r.*")
    return rows.filter(F.col(id_field).isNotNull()), rows.filter(F.col(id_field).isNull())
