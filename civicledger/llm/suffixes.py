"""Removal of repeated byte windows by a depth-limited radix sort of suffixes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from civicledger.llm.common import reclaim, staged, texts
from civicledger.llm.textvec import U, mixed, range_hashes, raw_bytes, slices, spread

DEPTH = 50                          # bytes of a window: suffixes are ordered no deeper
GRAM = 16                           # bytes of an anchor
SPAN = DEPTH - GRAM + 1             # anchors' places in a window
BROADCAST_ROWS = 200_000
SMALLEST_ID = -(1 << 63)
ANCHOR_BYTES, SORT_BYTES = 64 << 20, 12 << 20      # text for one task that compares anchors, that sorts suffixes
FLUSH = 24 << 20                    # bytes that a task holds before it writes


def doc_key() -> list[Column]:
    """A missing id is the smallest; the text's hash tells rows of one id apart."""
    return [F.coalesce("doc_id", F.lit(SMALLEST_ID)).alias("id"), F.xxhash64("text").alias("th")]


def anchored_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of the anchor, row) of the runs of windows with one anchor.

    The anchor of a window is its GRAM-byte piece with the smallest hash (the leftmost of equals). It
    depends on the window's bytes only, so equal windows have equal anchors wherever they stand.
    """
    n, none = len(data), np.empty(0, np.int64)
    if n < DEPTH:
        return none, none, np.empty(0, U), none
    where = np.arange(n - GRAM + 1)
    h = range_hashes(data, where, where + GRAM)
    bits = U(max(1, int(n).bit_length()))
    low = (h >> bits << bits) | where.astype(U)
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:len(low) - (SPAN - size)], low[SPAN - size:]) if size < SPAN else low
    anchor = (low & ((U(1) << bits) - U(1))).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)                  # windows that lie in one row
    lens = np.diff(at)
    full = np.flatnonzero(lens >= DEPTH)
    inside[at[full]] += 1
    inside[at[full] + lens[full] - DEPTH + 1] -= 1
    valid = np.cumsum(inside)[:len(anchor)] > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(anchor))
    total = np.append(0, np.cumsum(valid))
    return first, total[stop] - total[first], mixed(h[anchor[first]]), np.searchsorted(at, first, "right") - 1


def group_of(h: np.ndarray, groups: int) -> np.ndarray:
    return (h % U(groups)).astype(np.int64)


def short_key(h: np.ndarray, groups: int) -> np.ndarray:
    """Group and 32 further bits of an anchor: enough to look for repeats; a false one costs a little work."""
    return (group_of(h, groups) << 32) | (h >> U(32)).astype(np.int64)


def _bytes(a: np.ndarray, kind: str) -> bytes:
    return a.astype(kind).tobytes()


def bucket_of(ids: np.ndarray, ths: np.ndarray, buckets: int) -> np.ndarray:
    """Group of documents that one task gathers."""
    return group_of(mixed(ths.astype(np.int64).view(U) ^ mixed(ids.astype(np.int64).view(U))), buckets)


def packed_text(a: np.ndarray) -> bytes:
    """Length and zstd frame; pieces overlap, so they are worth more than the shuffle's fast codec."""
    return len(a).to_bytes(8, "little") + pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def unpacked_text(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def repeated_anchors(firsts: DataFrame, groups: int) -> DataFrame:
    """(id, th, keys): the short keys of each document's anchors that another document has too.

    Tasks write the anchors of many documents as one packed row per group, 4 bytes an anchor, instead of
    a row per anchor; a group's task sorts them and sends what is shared, packed again, to the tasks that
    gather it by document.
    """
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0

        def flush() -> pa.RecordBatch:
            ids, ths, h = (np.concatenate([x[k] for x in held]) for k in range(3))
            g = group_of(h, groups)
            order = np.lexsort((ths, ids, g))
            ids, ths, h, g = ids[order], ths[order], h[order], g[order]
            docs, parts = _runs(ids, ths, g), _runs(g)
            edges = [*parts.tolist(), len(g)]
            cut = np.searchsorted(docs, edges)
            counts = np.diff(np.append(docs, len(g)))
            rows = []
            for a, b, da, db in zip(edges[:-1], edges[1:], cut[:-1].tolist(), cut[1:].tolist()):
                d = docs[da:db]
                rows.append((int(g[a]), _bytes(ids[d], "<i8"), _bytes(ths[d], "<i8"), _bytes(counts[da:db], "<u4"), _bytes(h[a:b] >> U(32), "<u4")))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["grp", "ids", "ths", "counts", "keys"])

        for part, data, at in slices(batches):
            _, _, h, row = anchored_runs(data, at)
            if len(h):
                held.append((part["id"].to_numpy()[row], part["th"].to_numpy()[row], h))
                weight += 24 * len(h)
            if weight > FLUSH:
                yield flush()
                held, weight = [], 0
        if held:
            yield flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            for g, *cols in zip(b["grp"].to_pylist(), *(b[c].to_pylist() for c in ("ids", "ths", "counts", "keys"))):
                got.setdefault(g, []).append(cols)
        for g, blobs in got.items():
            ids, ths = (np.concatenate([np.frombuffer(x[k], "<i8") for x in blobs]) for k in (0, 1))
            counts, keys = (np.concatenate([np.frombuffer(x[k], "<u4") for x in blobs]) for k in (2, 3))
            doc = np.repeat(np.arange(len(ids)), counts)
            order = np.argsort(keys, kind="stable")
            own, start = ids[doc[order]], _runs(keys[order])
            if not len(own):
                continue
            many = np.minimum.reduceat(own, start) < np.maximum.reduceat(own, start)
            hit = np.zeros(len(keys), bool)
            hit[order] = np.repeat(many, np.diff(np.append(start, len(own))))
            doc, keys = doc[hit], keys[hit].astype(np.int64) | g << 32
            bucket = bucket_of(ids, ths, groups)[doc]
            order = np.argsort(bucket, kind="stable")
            doc, keys, bucket = doc[order], keys[order], bucket[order]
            edges = [*_runs(bucket).tolist(), len(doc)] if len(doc) else [0]
            for x, y in zip(edges[:-1], edges[1:]):
                own = _runs(doc[x:y])
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[x])], pa.int32()), *(pa.array([c], pa.binary()) for c in (
                    _bytes(ids[doc[x:y][own]], "<i8"), _bytes(ths[doc[x:y][own]], "<i8"), _bytes(np.diff(np.append(own, y - x)), "<u4"), _bytes(keys[x:y], "<i8")))],
                    ["bucket", "ids", "ths", "counts", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ("<i8", "<i8", "<u4", "<i8")
        got = [[np.frombuffer(x, k) for x in b[c].to_pylist()] for b in batches for c, k in zip(("ids", "ths", "counts", "keys"), kinds)]
        if not got:
            return
        ids, ths, counts, keys = (np.concatenate([x for part in got[k::4] for x in part]) for k in range(4))
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((ths[doc], ids[doc]))
        ids, ths, keys = ids[doc[order]], ths[doc[order]], keys[order]
        docs = _runs(ids, ths)
        ends = pa.array(np.append(docs, len(ids)).astype(np.int32))
        out = pa.RecordBatch.from_arrays([pa.array(ids[docs]), pa.array(ths[docs]), pa.ListArray.from_arrays(ends, pa.array(keys))], ["id", "th", "keys"])
        for k in range(0, out.num_rows, 10_000):
            yield out.slice(k, 10_000)

    packed = firsts.mapInArrow(collect, "grp int, ids binary, ths binary, counts binary, keys binary").repartitionById(groups, F.col("grp"))
    shared = packed.mapInArrow(compare, "bucket int, ids binary, ths binary, counts binary, keys binary").repartitionById(groups, F.col("bucket"))
    return staged(shared.mapInArrow(answer, "id long, th long, keys array<long>"), "anchors")


def suffix_pieces(firsts: DataFrame, anchors: DataFrame, groups: int, sorters: int) -> DataFrame:
    """Packed rows of the text pieces whose windows may repeat, dealt out by anchor, so that equal windows
    meet in one task. A piece that a task has met before is written once, with all its places."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, ths, place, size, to, digest = (np.concatenate([x[k] for x in held]) for k in range(6))
            lens = size + DEPTH - 1
            text = np.concatenate([x[6] for x in held])
            begin = np.cumsum(lens) - lens
            order = np.lexsort((digest, to))
            to_, digest_ = to[order], digest[order]
            new = np.zeros(len(order), bool)
            new[_runs(to_, digest_)] = True
            content = np.cumsum(new) - 1
            edges = [*_runs(to_).tolist(), len(order)]
            for a, b in zip(edges[:-1], edges[1:]):
                o, kept = order[a:b], order[a:b][new[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array([int(to_[a])], pa.int32()), *(pa.array([x], pa.binary()) for x in (
                    _bytes(ids[o], "<i8"), _bytes(ths[o], "<i8"), _bytes(place[o], "<i4"), _bytes(content[a:b] - content[a], "<i4"), _bytes(size[kept], "u1"),
                    packed_text(text[spread(begin[kept], lens[kept])])))], ["sorter", "ids", "ths", "places", "contents", "sizes", "text"])

        for part, data, at in slices(batches):
            first, size, h, row = anchored_runs(data, at)
            wanted = np.unique(np.asarray(part["keys"].flatten()))
            hit = np.isin(short_key(h, groups), wanted)
            if not hit.any():
                continue
            first, size, h, row = first[hit], size[hit], h[hit], row[hit]
            digest = range_hashes(data, first, first + size + DEPTH - 1)
            held.append((part["id"].to_numpy()[row], part["th"].to_numpy()[row], first - at[row], size, group_of(mixed(h), sorters), digest,
                         data[spread(first, size + DEPTH - 1)]))
            weight += len(held[-1][6])
            if weight > FLUSH:
                yield from flush()
                held, weight = [], 0
        if held:
            yield from flush()

    return firsts.join(anchors, ["id", "th"]).mapInArrow(
        task, "sorter int, ids binary, ths binary, places binary, contents binary, sizes binary, text binary").repartitionById(sorters, F.col("sorter"))


def radix_groups(text: np.ndarray, start: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each suffix start: the smallest id in its group of equal windows (the largest integer if no
    other document is in it).

    Most-significant-digit passes over eight bytes each, DEPTH bytes in all. ``least`` and ``most`` bound
    the ids that have the suffix. After each pass, groups of one document leave; a group whose next digit
    is the same throughout is not sorted again.
    """
    out = np.full(len(start), np.iinfo(np.int64).max)
    digit = np.ndarray((max(0, len(text) - 7),), ">u8", text, strides=(1,))
    order = np.argsort(digit[start].astype(np.uint64), kind="stable")
    key = digit[start[order]].astype(np.uint64)
    group = np.zeros(len(order), np.int64)
    for k, depth in enumerate([*range(0, DEPTH - 8, 8), DEPTH - 8]):
        if not len(order):
            return out
        bound = _runs(group)
        if k:
            key = digit[start[order] + depth].astype(np.uint64)
            count = np.diff(np.append(bound, len(order)))
            odd = np.repeat(np.logical_or.reduceat(key != np.repeat(key[bound], count), bound), count)
            idx = np.flatnonzero(odd)
            perm = idx[np.lexsort((key[idx], group[idx]))]
            order[idx], key[idx] = order[perm], key[perm]
        bound = _runs(group, key)
        count = np.diff(np.append(bound, len(order)))
        many = np.minimum.reduceat(least[order], bound) < np.maximum.reduceat(most[order], bound)
        stay = np.repeat(many, count)
        group = np.repeat(np.arange(len(bound)), count)[stay]
        order = order[stay]
    if len(order):
        bound = _runs(group)
        out[order] = np.repeat(np.minimum.reduceat(least[order], bound), np.diff(np.append(bound, len(order))))
    return out


def sort_suffixes(pieces: DataFrame, buckets: int) -> DataFrame:
    """(id, th, starts, ends): byte ranges covered by windows that a smaller id has as well, a row for each
    document. Sorters write one packed row for each of ``buckets`` groups of documents."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            for s, *cols in zip(b["sorter"].to_pylist(), *(b[c].to_pylist() for c in ("ids", "ths", "places", "contents", "sizes", "text"))):
                got.setdefault(s, []).append(cols)
        for blobs in got.values():
            kinds = ("<i8", "<i8", "<i4", "<i4", "u1", "u1")
            arrays = [[np.frombuffer(x[k], kind) for x in blobs] for k, kind in enumerate(kinds[:5])]
            arrays.append([np.frombuffer(unpacked_text(x[5]), "u1") for x in blobs])
            shift = np.cumsum([0] + [len(x) for x in arrays[4]])
            ids, ths, place = (np.concatenate(arrays[k]) for k in range(3))
            content = np.concatenate([x.astype(np.int64) + d for x, d in zip(arrays[3], shift)])
            size, text = np.concatenate(arrays[4]).astype(np.int64), np.concatenate(arrays[5])
            lens = size + DEPTH - 1
            begin = np.cumsum(lens) - lens
            least, most = np.full(len(size), np.iinfo(np.int64).max), np.full(len(size), SMALLEST_ID)
            np.minimum.at(least, content, ids)
            np.maximum.at(most, content, ids)
            smallest = radix_groups(text, spread(begin, size).astype(np.int64), np.repeat(least, size), np.repeat(most, size))
            window = np.cumsum(size) - size
            useful = np.minimum.reduceat(smallest, window) < most        # pieces of which some document loses a window
            keep = useful[content]
            ids, ths, place, content = ids[keep], ths[keep], place[keep].astype(np.int64), content[keep]
            n = size[content]
            gone = smallest[spread(window[content], n)] < np.repeat(ids, n)
            entry, where = np.repeat(np.arange(len(ids)), n), spread(place, n)
            entry, where = entry[gone], where[gone].astype(np.int64)
            if not len(entry):
                continue
            run = np.ones(len(entry), bool)
            run[1:] = (entry[1:] != entry[:-1]) | (where[1:] != where[:-1] + 1)
            start = np.flatnonzero(run)
            stop = np.append(start[1:], len(entry)) - 1
            entry, lo, hi = entry[start], where[start], where[stop] + DEPTH
            ids, ths = ids[entry], ths[entry]
            bucket = bucket_of(ids, ths, buckets)
            order = np.lexsort((lo, ths, ids, bucket))
            edges = [*_runs(bucket[order]).tolist(), len(order)]
            rows = [(int(bucket[order[x]]), *(_bytes(c[order[x:y]], k) for c, k in ((ids, "<i8"), (ths, "<i8"), (lo, "<i4"), (hi, "<i4")))) for x, y in zip(edges[:-1], edges[1:])]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "ids", "ths", "lows", "highs"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ("<i8", "<i8", "<i4", "<i4")
        got = [[np.frombuffer(x, k) for x in b[c].to_pylist()] for b in batches for c, k in zip(("ids", "ths", "lows", "highs"), kinds)]
        if not got:
            return
        ids, ths, lo, hi = (np.concatenate([x for part in got[k::4] for x in part]) for k in range(4))
        order = np.lexsort((lo, ths, ids))
        ids, ths, lo, hi = ids[order], ths[order], lo[order], hi[order]
        docs = _runs(ids, ths)
        ends = pa.array(np.append(docs, len(ids)).astype(np.int32))
        out = pa.RecordBatch.from_arrays([pa.array(ids[docs]), pa.array(ths[docs]), pa.ListArray.from_arrays(ends, pa.array(lo)), pa.ListArray.from_arrays(ends, pa.array(hi))],
                                         ["id", "th", "starts", "ends"])
        for k in range(0, out.num_rows, 10_000):
            yield out.slice(k, 10_000)

    packed = pieces.mapInArrow(task, "bucket int, ids binary, ths binary, lows binary, highs binary").repartitionById(buckets, F.col("bucket"))
    return packed.mapInArrow(merge, "id long, th long, starts array<int>, ends array<int>")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(id, th, starts, ends): the byte ranges that go, for every document that loses any."""
    keyed = texts(docs).select(*doc_key(), "text", F.octet_length("text").alias("n"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    slim = staged(keyed.select("id", "th", "n", "sha"), "digests")
    total = slim.agg(F.sum("n").alias("b")).first()["b"] or 0
    groups, sorters = total // ANCHOR_BYTES + 1, total // SORT_BYTES + 1
    smallest = slim.groupBy("sha").agg(F.min("id").alias("lo"), F.count("*").alias("c")).filter("c > 1").select("sha", "lo")
    copies = staged(slim.join(smallest, "sha").filter("id > lo").select("id", "th", "n").distinct(), "copies")
    few = copies.select("id", "th")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    firsts = keyed.filter(F.col("n") >= DEPTH).select("id", "th", "text").join(few, ["id", "th"], "left_anti")
    anchors = repeated_anchors(firsts, groups)
    merged = staged(sort_suffixes(suffix_pieces(firsts, anchors, groups, sorters), groups), "ranges")
    whole = copies.filter(F.col("n") >= DEPTH).select("id", "th", F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends"))
    return merged.unionByName(whole)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row.

    A byte goes if it lies in a 50-byte string that also starts in a row with a smaller doc_id; strings
    are judged on the input and never cross rows. A null or empty text has no bytes. A null doc_id is the
    smallest one; rows with the same doc_id take nothing from each other. A row whose whole text (of 50
    bytes or more) stands under a smaller doc_id goes whole without being sorted, so groups of exact
    copies cost one row each.

    Suffixes that cannot repeat are left out before the sort: only those whose anchor another document has
    too are dealt out, by anchor, and ordered to 50 bytes in most-significant-digit passes. Equal groups
    are exactly the repeated windows.
    """
    ranges = repeated_ranges(docs)
    reclaim(docs.sparkSession)
    rows = texts(docs).select("doc_id", *doc_key(), "text").join(ranges, ["id", "th"], "left").select("doc_id", "text", "starts", "ends")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = raw_bytes(b["text"])
            removed, spans, kept = [], [], []
            for s, e, starts, ends in zip(at[:-1].tolist(), at[1:].tolist(), b["starts"].to_pylist(), b["ends"].to_pylist()):
                if starts is None:
                    removed.append(0)
                    spans.append(0)
                    kept.append(data[s:e].tobytes())
                    continue
                cover = np.zeros(e - s + 1, np.int32)
                np.add.at(cover, np.asarray(starts), 1)
                np.add.at(cover, np.asarray(ends), -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(data[s:e][~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
f AS (SELECT k, min(doc_id) AS lo FROM w GROUP BY k),
g AS (SELECT w.doc_id, p FROM w JOIN f USING (k) WHERE f.lo < w.doc_id),
b AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
s AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM r GROUP BY doc_id, run),
k AS (SELECT s.doc_id, hi - lo AS gone, lo, coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0) AS start FROM s),
t AS (SELECT k.doc_id, sum(gone) AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, 2 * start + 1, 2 * (lo - start)), '' ORDER BY lo) AS front FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
e AS (SELECT doc_id, max(hi) AS hi FROM s GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE front || substr(h, 2 * hi + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)"""
