"""Sharding by a hierarchical weighted hash tree (law ``key``)."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from civicledger.llm.common import staged, texts


class Node(NamedTuple):
    """A region, rack or shard. A leaf has a shard number and a weight, an inner node weighs what its
    children weigh."""
    name: str
    children: tuple = ()
    shard: int = -1
    leaf_weight: float = 0.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def hash_tree(shards: int, base: int = 8, per_rack: int = 2, racks: int = 2, weight: float = 1.0) -> Node:
    """Regions of ``racks`` racks with ``per_rack`` shards for the first ``base`` shards. Every shard
    beyond ``base`` is a region of its own, so only weights on its own path differ from the smaller tree."""
    leaf = lambda i: Node(f"s{i}", (), i, weight)
    regions, per_region = [], per_rack * racks
    for r0 in range(0, min(shards, base), per_region):
        ids = range(r0, min(r0 + per_region, shards, base))
        rows = [ids[k:k + per_rack] for k in range(0, len(ids), per_rack)]
        regions.append(Node(f"g{r0 // per_region}", tuple(
            Node(f"g{r0 // per_region}k{k}", tuple(leaf(i) for i in row)) for k, row in enumerate(rows))))
    for i in range(base, shards):
        regions.append(Node(f"g+{i}", (Node(f"g+{i}k0", (leaf(i),)),)))
    return Node("root", tuple(regions))


def draw(key: Column, node: Node) -> Column:
    """Exponential draw -ln(u)/weight of a key at a node; the smallest draw among siblings wins with a
    probability in proportion to weight, and a weight that rises only ever attracts keys."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11).cast("double") + 0.5) / F.lit(float(2 ** 53))
    return -F.log(u) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """Shard number of a key: the winner of the draws on each level, from the root down."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    won = F.least(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)])["i"]
    out = descend(key, node.children[-1])
    for i, c in reversed(list(enumerate(node.children[:-1]))):
        out = F.when(won == i, descend(key, c)).otherwise(out)
    return out


def place(docs: DataFrame, tree: Node, grown: Node) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes + 1), text_crc32, text_group (equal for equal texts),
    shard under ``tree`` and grown_shard under ``grown``.

    A narrow scan: the place depends on doc_id and the tree alone, so rows with the same doc_id (null
    counts as one id) share a shard whatever their texts; a null text has size 1.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-1).cast("long"))
    return texts(docs).select(
        "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("text_group"), descend(key, tree).cast("int").alias("shard"),
        descend(key, grown).cast("int").alias("grown_shard"))


def number_slots(placed: DataFrame) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... without gaps within each shard.

    A shard is never gathered. The slim rows are staged with the number of the task that wrote them;
    counts per (shard, task) give each such piece its first slot, and rows are numbered inside a piece,
    which is never larger than one input split. Hot ids or sources cannot enlarge a piece.
    """
    rows = staged(placed.withColumn("__piece", F.spark_partition_id()), "slots")
    pieces = rows.groupBy("shard", "__piece").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("shard", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__piece").orderBy("doc_id", "text_crc32", "size")
    return (rows.join(starts, ["shard", "__piece"])
            .withColumn("slot", F.col("__start") + F.row_number().over(inside) - 1).drop("__start", "__piece"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Place every row of ``docs`` in a tree of ``shards`` shards and number the rows of each shard;
    ``grown_shard`` is the place with one shard more. An empty table gives no rows; repeated rows keep
    a slot each."""
    base = max(shards, 1)
    placed = place(docs, hash_tree(base, base), hash_tree(base + 1, base))
    return number_slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                                       F.col("slot").cast("long").alias("slot"), "grown_shard", "text_group")


def write_shards(docs: DataFrame, path: str, shards: int = 8, rows_per_file: int = 1_000_000) -> None:
    """Write the documents as files below ``path/shard=N``, straight from the scan."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    (docs.withColumn("shard", descend(key, hash_tree(shards, shards))).write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))
