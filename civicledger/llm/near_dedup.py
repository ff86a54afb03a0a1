"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures."""
from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from civicledger.llm.common import staged, texts
from civicledger.llm.components import connected_components
from civicledger.llm.textvec import BASE, TO_LOWER, U, mixed, range_hashes, slices, words

WIDTH = 5
CHUNKS, PER_CHUNK = 12, 8       # a chunk: up to 8 values of 8 bits, one long
VALUES = CHUNKS * PER_CHUNK
#: A pair that differs in at most this many values has a chunk with at most one of them (pigeonhole).
GUARANTEED = 2 * CHUNKS - 1
MISSED = 3e-6                   # chance that a pair at the threshold meets in no bucket
BLOCK = 1000                    # members of a bucket that one join key takes
BROADCAST_IDS = 200_000         # ids up to which a filter on documents is broadcast; more go through a shuffle

WIDE = 512                      # values of the longer signature that decides between members of a bucket

_rng = np.random.default_rng(20)
XORS, FACTORS = _rng.integers(0, 1 << 64, WIDE, U), _rng.integers(0, 1 << 64, WIDE, U) | U(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of the distinct word shingles of each text, sorted by row and hash. Words are runs of
    non-blank bytes with A-Z lower-cased; a text of fewer words is one shingle, without words none."""
    data = TO_LOWER[data]
    starts, ends, row = words(data, at)
    if not len(starts):
        return np.empty(0, U), np.empty(0, np.int64)
    word = range_hashes(data, starts, ends)
    first = np.searchsorted(row, np.arange(len(at)))
    count = np.diff(first)
    h = word.copy()
    size = np.minimum(count, width)[row]
    left = first[row + 1] - np.arange(len(word))        # words from here to the end of the text
    for k in range(1, width):
        more = size > k
        moved = np.zeros_like(h)
        moved[:len(h) - k] = word[k:]
        h = np.where(more & (left > k), mixed(h * U(BASE) + moved), h)
    kept = left >= size
    h, row = mixed(h[kept] ^ size[kept].astype(U)), row[kept]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def per_chunk(percent: int) -> int:
    """Values of a chunk: as many as leave a pair at the threshold a chance of at most ``MISSED`` of meeting
    in no bucket. A lower threshold has shorter chunks."""
    p = percent / 100 + (1 - percent / 100) / 256
    return next(k for k in range(PER_CHUNK, 0, -1) if (1 - p ** k - k * p ** (k - 1) * (1 - p)) ** CHUNKS <= MISSED)


def signatures(docs: DataFrame, values: int = VALUES, per: int = PER_CHUNK) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash (set_a, set_b) of the shingle set and the b-bit MinHash signature
    as one long for ``per`` values (null for texts without words). One pass, no shuffle."""
    longs_each = values // per

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in slices(batches):
            h, row = shingle_sets(data, at)
            rows = part.num_rows
            n = np.bincount(row, minlength=rows)
            has = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[has]
            sig = np.zeros((rows, 8 * longs_each), np.uint8)
            a, b = np.zeros(rows, U), np.zeros(rows, U)
            if len(has):
                a[has] = np.add.reduceat(mixed(h + U(1)), begin)
                b[has] = np.add.reduceat(mixed(h ^ U(BASE)), begin)
                for k in range(values):
                    sig[has, k // per * 8 + k % per] = np.minimum.reduceat(((h ^ XORS[k]) * FACTORS[k]) >> U(32), begin).astype(np.uint8)
            longs = pa.array(sig.view(np.int64).reshape(-1))
            ends = np.append(0, np.cumsum(np.where(n > 0, longs_each, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), longs.filter(pa.array(np.repeat(n > 0, longs_each))))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists],
                                             ["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return texts(docs).mapInArrow(task, "doc_id long, n_shingles long, set_a long, set_b long, sig array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted hashes of its whole shingle set."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in slices(batches, limit=1 << 20):
            h, row = shingle_sets(data, at)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["doc_id", "shingles"])

    return texts(docs).mapInArrow(task, "doc_id long, shingles array<long>")


def differing(x: Column, y: Column) -> Column:
    """The lowest bit of every byte in which two longs differ."""
    d = x.bitwiseXOR(y)
    for s, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3F3F3F3F3F3F3F3F), (1, 0x7F7F7F7F7F7F7F7F)):
        d = d.bitwiseOR(F.shiftrightunsigned(d, s).bitwiseAND(F.lit(mask)))
    return d.bitwiseAND(F.lit(0x0101010101010101))


def distance(x: str, y: str) -> Column:
    """Signature values that differ."""
    return sum((F.bit_count(differing(F.col(x)[c], F.col(y)[c])) for c in range(CHUNKS)), F.lit(0))


def wide_distance(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(differing(a, b))), F.lit(0), lambda s, d: s + d)


def first_key(x: str, y: str, per: int = PER_CHUNK) -> Column:
    """Number of the first index key that two signatures share: a pair meets in many buckets and is
    looked at in this one only."""
    def at(c: int) -> Column:
        d = differing(F.col(x)[c], F.col(y)[c])
        return F.when(F.bit_count(d) <= 1, c * per + F.floor(F.bit_count(d - 1) / 8) % 8)
    return F.coalesce(*[at(c) for c in range(CHUNKS)])


def distance_limit(similarity: float, values: int, sigmas: float = 5.0) -> int:
    """Signature distance that a pair of the given similarity exceeds with a chance below one in a million."""
    p = (1 - similarity) * (1 - 1 / 256)
    return int(values * p + sigmas * sqrt(values * p * (1 - p)))


def index_keys(classes: DataFrame, per: int = PER_CHUNK) -> DataFrame:
    """(key, node): each chunk with each one of its values left out, so that two chunks with at most one
    error share a key. The low seven bits of a key are its number."""
    def without(i: int) -> Column:
        mask = (1 << 64) - 1 - (0xFF << 8 * i)
        number = F.col("c") * per + i
        return F.xxhash64(number, F.col("v").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))).bitwiseAND(F.lit(-128)).bitwiseOR(number.cast("long"))
    return (classes.select("node", F.posexplode("sig").alias("c", "v"))
            .select("node", F.explode(F.array(*[without(i) for i in range(per)])).alias("key")))


def of_nodes(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the given nodes. Few ids are broadcast after a count, many go through a shuffle."""
    slim = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts(docs).withColumn("node", node_id()).join(slim, "node", "left_semi")


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose full sets satisfy 100 * intersection >= percent * union."""
    ids = staged(pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct(), "ids")
    sets = staged(full_sets(of_nodes(docs, ids)).withColumn("node", node_id()).select("node", "shingles"), "sets")
    sx, sy = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "xy")
    common = F.size(F.array_intersect("sx", "sy"))
    return (pairs.join(sy, "y").join(sx, "x").withColumn("__i", common)
            .filter(100 * F.col("__i") >= percent * (F.size("sx") + F.size("sy") - F.col("__i"))).select("x", "y"))


def node_id() -> Column:
    """doc_id as a node; a missing id is the smallest one."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def near_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Equal shingle sets are one class from the start, however many rows hold them. Classes meet in
    buckets of the multi-index. In a bucket all members are first compared with its smallest member
    (as many pairs as members); once those links are components, only members of different components
    are compared, in blocks of ``BLOCK`` members. A pair is looked at in its first common bucket and
    leaves the join only with suitable sizes and distances of its signature and of a longer one, which is
    made for such members alone. Every remaining pair is confirmed on full sets; no link is assumed.

    Guarantee: every pair with a signature distance up to ``GUARANTEED`` meets; a pair at the similarity
    threshold misses all buckets with a chance of 3 in a million, the distance limits with one of 2. Rows without words have no links and
    n_shingles 0. Rows with the same doc_id count as one document; a null doc_id is the smallest id and
    gives component_id null. Empty tables give no rows.
    """
    per = per_chunk(percent)
    values = CHUNKS * per
    base = staged(signatures(docs, values, per).withColumn("node", node_id()), "signatures")
    classes = staged(base.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles")
                     .agg(F.min("node").alias("node"), F.first("sig").alias("sig")), "classes")
    keys = index_keys(classes, per)
    buckets = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("__last"), F.count("*").alias("n")).filter("head < __last").drop("__last")
    members = staged(keys.join(buckets, "key"), "members")
    traits = classes.select("node", "set_a", F.col("n_shingles").alias("size"), "sig")
    limit, wide_limit = (distance_limit(percent / 100, v) for v in (values, WIDE))

    def close() -> Column:
        return ((100 * F.least("size_x", "size_y") >= percent * F.greatest("size_x", "size_y")) & (distance("sig_x", "sig_y") <= limit))

    tx, ty = (traits.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "xy")
    star = members.filter("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y")).distinct()
    star = staged(star.join(ty, "y").join(tx, "x").filter(close()).select("x", "y").distinct(), "pairs")
    links = staged(confirm(docs, classes, star, percent), "links")
    labels = connected_components(links)

    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = staged(named, "named")
    mixed_up = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    rest = staged(named.join(mixed_up, "key", "left_semi").filter("node <> head")
                  .select("key", "node", "label", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "rest")
    ids = staged(rest.select("node").distinct(), "ids")
    wide = staged(signatures(of_nodes(docs, ids), WIDE).select(node_id().alias("node"), "set_a", F.col("sig").alias("wide")).dropDuplicates(["node", "set_a"]), "wide")
    rest = rest.join(traits.join(wide, ["node", "set_a"]).drop("set_a"), "node")

    def side(k: str, block: Column) -> DataFrame:
        return rest.select("key", block.alias("block"), F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("label", "size", "sig", "wide")])

    x = side("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    y = side("y", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    more = x.join(y, ["key", "block"]).filter(
        (F.col("x") < F.col("y")) & (F.col("label_x") != F.col("label_y")) & close()
        & (first_key("sig_x", "sig_y", per) == F.col("key").bitwiseAND(F.lit(127))) & (wide_distance("wide_x", "wide_y") <= wide_limit))
    more = staged(more.select("x", "y").distinct(), "pairs")
    if not more.isEmpty():
        links = staged(links.unionByName(confirm(docs, classes, more, percent)), "links")
        labels = connected_components(links)
    named_sets = classes.join(labels, "node", "left").select("set_a", "set_b", "n_shingles", F.coalesce("label", "node").alias("component"))
    out = base.drop("sig").join(named_sets, ["set_a", "set_b", "n_shingles"], "left").withColumn("component", F.coalesce("component", "node"))
    none = F.col("component") == F.lit(-(1 << 63))
    return out.select("doc_id", "n_shingles", F.when(~none, F.col("component")).alias("component_id"))


def op4(docs: DataFrame) -> DataFrame:
    g = near_groups(docs, 85)
    return g.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group: the smallest doc_id. Only the ids that go
    meet the documents again, broadcast if they are few, else in a join."""
    gone = staged(near_groups(docs, percent).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    slim = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(slim, F.col("doc_id") == F.col("__gone"), "left_anti")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.c)
SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, id = min(c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY id"""
