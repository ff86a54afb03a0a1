"""Cost-balanced packing of token documents into sequences of fixed capacity."""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from civicledger.llm.bpe import SLICE, default_path, vocabulary
from civicledger.llm.common import texts
from civicledger.llm.textvec import slices

END = 0                 # id after each document
NOTHING = (float("inf"), -1, -1)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenSequences:
    """Sequences with room left, by cost. One heap of (cost, sequence) per amount of room and a tree of
    minima over the amounts: the cheapest sequence with enough room is the minimum of a suffix."""

    def __init__(self, count: int, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]
        self.tree = [NOTHING] * (2 * self.width)
        self.heaps[capacity] = [(0.0, s) for s in range(count)]
        self._refresh(capacity)

    def _refresh(self, room: int) -> None:
        tree, k = self.tree, room + self.width
        tree[k] = (*self.heaps[room][0], room) if self.heaps[room] else NOTHING
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(self, cost: float, s: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, s))
            self._refresh(room)

    def take(self, size: int) -> tuple[float, int, int] | None:
        """Remove the cheapest sequence with room for ``size`` tokens (ties: the lowest number)."""
        tree, k = self.tree, size + self.width
        best = tree[k]
        while k > 1:
            if not k & 1:
                best = min(best, tree[k + 1])
            k >>= 1
        if best is NOTHING:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._refresh(best[2])
        return best


def plan(lengths: np.ndarray, capacity: int, linear: float, quadratic: float
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, start, length, sequence, offset) of the pieces of a group of documents, and the number
    of sequences.

    Whole multiples of the capacity fill sequences of their own. The remainders go in descending order
    to the sequence of the lowest cost so far that has room for them, where a piece of t tokens costs
    linear*t + quadratic*t*t. As many sequences are open as the tokens need, so less than one capacity is
    left empty in a group: a piece that fits in no sequence is cut to fill the cheapest one, and the rest
    of it is placed in the same way.
    """
    full = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    pieces = [(doc, nth * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64))]
    rest = lengths - full * capacity
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    count, base = -(-int(rest.sum()) // capacity), len(doc)
    sequences = OpenSequences(count, capacity)
    rows = []
    for d, size in zip(order.tolist(), rest[order].tolist()):
        at = int(full[d]) * capacity
        while size:
            cost, s, room = sequences.take(size) or sequences.take(1)
            n = min(size, room)
            rows.append((d, at, n, base + s, capacity - room))
            sequences.put(cost + linear * n + quadratic * n * n, s, room - n)
            at, size = at + n, size - n
    if rows:
        pieces.append(tuple(np.array(c, np.int64) for c in zip(*rows)))
    return *(np.concatenate(c) for c in zip(*pieces)), base + count


def pack(docs: DataFrame, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024, path: str | None = None,
         group_tokens: int = 4 << 20, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked
    for, the ids.

    Every text (null: empty) is encoded and ends with id 0, so an empty one is one token. Each task packs
    the documents it reads in groups of ``group_tokens`` tokens (a longer document makes a longer group):
    no shuffle, no sort of the corpus, memory of one group, and less than one capacity of padding a group.
    A sequence_id holds the task's number and a counter, and a task that runs again numbers alike. A
    repeated row is packed again.
    """
    from zlib import crc32
    path = path or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            doc_ids = pa.concat_arrays([h[0] for h in held])
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            first = np.cumsum(lengths) - lengths
            doc, start, length, seq, offset, used = plan(lengths, capacity, linear, quadratic)
            lo = first[doc] + start
            packed = [ids[a:b] for a, b in zip(lo.tolist(), (lo + length).tolist())]
            cols = [doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([crc32(p) for p in packed], pa.int64()),
                    pa.array(lengths[doc]), pa.array(sequence + seq), pa.array(offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.append(0, np.cumsum(length)).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(packed))))
                names.append("ids")
            sequence += used
            whole = pa.RecordBatch.from_arrays(cols, names)
            for k in range(0, whole.num_rows, 8192):
                yield whole.slice(k, 8192)

        for part, data, at in slices(batches, limit=SLICE):
            ids, rows = v.encode(data, at)
            ids = np.insert(ids.astype("<i4"), rows[1:], END)
            lengths = np.diff(rows) + 1
            held.append((part["doc_id"], ids, lengths))
            tokens += len(ids)
            if tokens >= group_tokens:
                yield from flush()
                held, tokens = [], 0
        if held:
            yield from flush()

    return texts(docs).mapInArrow(task, PIECES + (", ids array<int>" if with_ids else ""))


def op6(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)
