"""Document fingerprints from content-defined chunks."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from civicledger.llm.common import texts
from civicledger.llm.textvec import mixed, range_hashes, slices

SMALLEST, NORMAL, LARGEST = 16, 64, 256     # bytes of a chunk
STRICT, LOOSE = 0x7F << 25, 0x1F << 27      # hash bits that end a chunk before and after the normal size
GEAR = (mixed(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
RECORD = 6                                  # bytes of a chunk in a fingerprint: 5 of the digest, 1 of the length
WINDOW = 32                                 # bytes the gear hash sees
PART_BYTES = 16 << 20


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: the last 32 bytes, each shifted once more than the next. Doubling the
    window takes five vector steps instead of a loop over bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        moved = np.zeros_like(h)
        moved[k:] = h[:-k] if k < len(h) else 0
        h = h + (moved << np.uint32(k))
    return h


def chunk_records(texts_: list[bytes]) -> list[np.ndarray]:
    """The fingerprint of each text: its distinct chunks as sorted 48-bit records of digest and length.

    Before the normal size a boundary needs more hash bits than after it (normalised chunking); a chunk
    has SMALLEST to LARGEST bytes, the last one may be shorter. As the hash sees 32 bytes only, boundaries
    settle again soon after an insertion or deletion. Bytes that no text has stand before each text, so
    a text's hashes do not depend on its neighbours.
    """
    lead = b"\xff" * WINDOW
    data = np.frombuffer(lead + lead.join(texts_), np.uint8) if texts_ else np.empty(0, np.uint8)
    size = np.array([len(t) for t in texts_], np.int64)
    begin = np.cumsum(size + WINDOW) - size
    h = gear_hashes(data)
    at = np.flatnonzero((h & np.uint32(LOOSE)) == 0)
    strict = (h[at] & np.uint32(STRICT)) == 0
    at += 1
    edge = np.searchsorted(at, np.stack([begin + SMALLEST, begin + size]).ravel(), "left").reshape(2, -1)
    at, strict = at.tolist(), strict.tolist()
    starts, owner = [], []
    for k, (b, n, lo, hi) in enumerate(zip(begin.tolist(), size.tolist(), edge[0].tolist(), edge[1].tolist())):
        if not n:
            continue
        starts.append(b)
        last = b
        for end, sure in zip(at[lo:hi], strict[lo:hi]):
            gap = end - last
            if gap < SMALLEST:
                continue
            while gap > LARGEST:
                last += LARGEST
                starts.append(last)
                gap = end - last
            if gap >= NORMAL or sure and gap >= SMALLEST:
                starts.append(end)
                last = end
        while b + n - last > LARGEST:
            last += LARGEST
            starts.append(last)
        owner.append((k, len(starts)))
    out = [np.empty(0, np.uint64)] * len(texts_)
    if not owner:
        return out
    starts = np.array(starts, np.int64)
    first = np.append(0, [n for _, n in owner])
    ends = np.append(starts[1:], 0)
    which = np.array([k for k, _ in owner])
    ends[first[1:] - 1] = begin[which] + size[which]
    record = range_hashes(data, starts, ends) >> np.uint64(24) << np.uint64(8) | (ends - starts - 1).astype(np.uint64)
    for (k, _), lo, hi in zip(owner, first[:-1].tolist(), first[1:].tolist()):
        out[k] = np.unique(record[lo:hi])
    return out


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's distinct chunk bytes that b has as well; 1 for two empty texts, 0 if one is empty."""
    if not len(a):
        return float(not len(b))
    weight = lambda x: int((x & np.uint64(0xFF)).sum()) + len(x)
    return weight(np.intersect1d(a, b, assume_unique=True)) / weight(a)


def written(records: np.ndarray) -> str:
    """12 hex digits for each chunk, in ascending order."""
    return records.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - RECORD:].tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every text (null: empty, with an empty fingerprint). No shuffle."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in slices(batches):
            out = [written(r) for r in chunk_records([data[s:e].tobytes() for s, e in zip(at[:-1], at[1:])])]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(task, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """The texts in ascending (doc_id, text), cut into parts, with the row that follows each part.

    Cut points are quantiles of doc_id, one for about ``PART_BYTES`` of text: the driver sees one id per
    part. A row whose id is a cut point goes to its part and, marked by ``look``, to the part before, whose
    last row needs it; the very first row also goes to the last part. So every text is shuffled about once
    and no task sees more than its part. Rows of one doc_id stay together.
    """
    d = texts(docs)
    total = d.agg(F.sum(F.octet_length("text")).alias("b"), F.min("doc_id").alias("lo"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    parts = (total["b"] or 0) // PART_BYTES + 1
    points: list[int] = []
    if parts > 1:
        got = d.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
        points = sorted({p for p in got if p > total["lo"]})
    first_id, sorted_points = None if total["nulls"] else total["lo"], np.array(points, np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = b["doc_id"].fill_null(0).to_numpy()
            part = np.where(null, 0, np.searchsorted(sorted_points, ids, "right")).astype(np.int32)
            cut = np.flatnonzero(~null & np.isin(ids, sorted_points))
            opening = np.flatnonzero(null if first_id is None else ~null & (ids == first_id))
            look = np.zeros(b.num_rows + len(cut) + len(opening), np.int32)
            look[b.num_rows:] = 1
            rows = pa.array(np.concatenate([np.arange(b.num_rows), cut, opening]))
            to = np.concatenate([part, part[cut] - 1, np.full(len(opening), len(sorted_points), np.int32)])
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(rows), b["text"].take(rows), pa.array(to, pa.int32()), pa.array(look)],
                                             ["doc_id", "text", "part", "look"])

    routed = d.mapInArrow(route, "doc_id long, text string, part int, look int")
    return routed.repartitionById(len(points) + 1, F.col("part")).sortWithinPartitions("look", "doc_id", "text")


def half_replaced(text: str, following: str) -> str:
    """The last half of the code points gives way to as many from the start of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, the one of its edited text and the containment of its fingerprint in
    that one and in the next document's.

    The next document is the one after it by (doc_id, text), the first one after the last; a missing id is
    the smallest, a single row follows itself, repeated rows follow each other. Each text is fingerprinted
    once as itself, and a task holds the text before and one Arrow batch.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256
        before: list[tuple] = []        # the row whose successor has not come yet: id, text, records
        looked = False

        for part, _, _ in slices(batches):
            new = []
            for i, text, look in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["look"].to_pylist()):
                if not look or before + new and not looked:
                    new.append((i, text))
                looked = looked or bool(look)
            pairs = list(zip([*((b[0], b[1]) for b in before), *new], new if before else new[1:]))
            edited = [half_replaced(a[1], b[1]).encode() for a, b in pairs]
            records = chunk_records([*(t.encode() for _, t in new), *edited])
            own = [*(b[2] for b in before), *records[:len(new)]]
            rows = [(i, len(t), sha256(e).hexdigest(), written(own[k]), written(r), containment(own[k], r), containment(own[k], own[k + 1]))
                    for k, (((i, t), _), e, r) in enumerate(zip(pairs, edited, records[len(new):]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            if new:
                before = [(*new[-1], own[-1])]

    return in_order(docs).mapInArrow(task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
