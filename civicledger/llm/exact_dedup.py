"""Exact dedup over an extendible-hash index kept as shared files."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from civicledger.llm.common import sha256_text, staged, texts

ENTRY = "key long, text string, last_id long, n long"
INDEX = "key long, chain int, last_id long, n long, text_sha256 string"


def combine_copies(batches: Iterator[pa.RecordBatch], flush_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: equal texts of a task become one entry with their count and largest id. The
    table is emptied whenever it holds ``flush_bytes`` of text, so memory is bounded and a group that
    holds a third of all rows leaves each task as a handful of entries."""
    table: dict[str, list] = {}
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([v[0] for v in table.values()], pa.int64()), pa.array(list(table), pa.string()),
            pa.array([v[1] for v in table.values()], pa.int64()), pa.array([v[2] for v in table.values()], pa.int64())],
            ["key", "text", "last_id", "n"])

    for b in batches:
        for key, text, i in zip(b["key"].to_pylist(), b["text"].to_pylist(), b["doc_id"].to_pylist()):
            e = table.get(text)
            if e is None:
                table[text] = [key, i, 1]
                held += len(text)
            else:
                e[1] = i if e[1] is None or i is not None and i > e[1] else e[1]
                e[2] += 1
        if held > flush_bytes:
            yield out()
            table, held = {}, 0
    if table:
        yield out()


def chain_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner task: entries arrive in key order. Entries of one key form a chain; an entry joins the link
    whose bytes equal its own, otherwise it becomes the next link. Memory: the links of one key."""
    import hashlib

    key, links, rows = None, {}, []

    def close() -> None:
        rows.extend((key, k, v[0], v[1], hashlib.sha256(t.encode()).hexdigest()) for k, (t, v) in enumerate(links.items()))

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())],
                                          ["key", "chain", "last_id", "n", "text_sha256"])

    for b in batches:
        for k, text, i, n in zip(*(b[c].to_pylist() for c in ("key", "text", "last_id", "n"))):
            if k != key:
                if links:
                    close()
                key, links = k, {}
            e = links.get(text)        # compares the bytes of texts that share a key
            if e is None:
                links[text] = [i, n]
            else:
                e[0] = i if e[0] is None or i is not None and i > e[0] else e[0]
                e[1] += n
        if len(rows) >= 20_000:
            yield out()
            rows = []
    if links:
        close()
    if rows:
        yield out()


def build_directory(keys: DataFrame, capacity: int) -> list[tuple[int, int, int]]:
    """Buckets (prefix, local depth, distinct keys) of an extendible-hash directory.

    It starts with one bucket. A bucket with more than ``capacity`` distinct keys splits on its next bit;
    where its depth was the directory's, the directory doubles. Counts come from one aggregation by key
    prefix, deep enough for the expected size and repeated deeper while a leaf is still overfull. What
    the driver holds is a few rows per bucket, never keys.
    """
    total = keys.count()
    depth = max(0, (total // max(capacity, 1)).bit_length() + 3)
    while True:
        prefix = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
        leaf = {r["p"]: r["n"] for r in keys.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
        levels = [leaf]                         # counts of every depth, deepest first
        for _ in range(depth):
            up: dict[int, int] = {}
            for p, n in levels[-1].items():
                up[p >> 1] = up.get(p >> 1, 0) + n
            levels.append(up)
        levels.reverse()
        done, todo = [], [(0, 0)]
        while todo:
            p, d = todo.pop()
            n = levels[d].get(p, 0)
            if n > capacity and d < depth:
                todo += [(2 * p + 1, d + 1), (2 * p, d + 1)]
            else:
                done.append((p, d, n))
        if depth >= 60 or all(n <= capacity for _, _, n in done):
            return done
        depth += 4


def build_index(docs: DataFrame, capacity: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(directory, index), both stored in the shared folder.

    directory: one row per bucket with its local depth and first key. index: one row per distinct text
    with its key, place in the key's chain, largest doc_id and number of rows. Each owner task takes the
    whole buckets of one key range, in key order.
    """
    spark = docs.sparkSession
    keyed = texts(docs).withColumn("key", F.xxhash64("text"))
    keys = staged(keyed.select("key").distinct(), "keys")
    buckets = sorted((p << (64 - d), d, n) for p, d, n in build_directory(keys, capacity))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    directory = staged(spark.createDataFrame([(i, d, signed(low), n) for i, (low, d, n) in enumerate(buckets)],
                                             "bucket int, local_depth int, first_key long, n_keys long"), "directory")
    common = min(d for _, d, _ in buckets)      # slots that agree in so many bits hold whole buckets
    owner = F.shiftrightunsigned("key", 64 - common).cast("int") if common else F.lit(0)
    entries = keyed.select("key", "text", "doc_id").mapInArrow(combine_copies, ENTRY)
    chained = (entries.repartitionById(1 << common, owner).sortWithinPartitions("key")
               .mapInArrow(chain_entries, INDEX))
    return directory, staged(chained, "index")


def exact_dedup(docs: DataFrame, capacity: int = 20_000) -> DataFrame:
    """Every row with keep_id, group_size and kept.

    Equal texts form a group (null counts as empty); the largest doc_id stays. A null doc_id is smaller
    than any other; a group of such rows only has keep_id null and keeps them. Repeated rows with the
    kept doc_id are all kept, as nothing tells them apart. Rows are matched with their index entry by key
    and digest; the index side has one row per text, so Spark may split a hot key's rows freely.
    """
    _, index = build_index(docs, capacity)
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("key"), sha256_text(F.col("text")).alias("text_sha256"))
    return (rows.join(index.drop("chain"), ["key", "text_sha256"])
            .select("doc_id", F.col("last_id").alias("keep_id"), F.col("n").alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.col("last_id")).alias("kept"), "text_sha256"))



def op2(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs)


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
