"""Byte-level BPE encoding and decoding with segment trees over adjacent pair ranks."""
from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from civicledger.llm.common import texts
from civicledger.llm.textvec import range_hashes, slices, spread

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
NEVER = 1 << 30
SLICE = 3 << 20         # bytes encoded at once: larger slices repeat more words
LONG = 128              # words with more symbols get a tree of their own


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return table


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable letter: itself where it is one, else the next
    free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in plain))
    return out


class Vocabulary:
    """Tables of one tokenizer file, and the word cache of the worker that loaded it."""

    def __init__(self, path: str, cache_words: int = 1 << 19):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token
        self.piece_length = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_id = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left << 20 | right
        # pairs by a multiplicative hash; a pair whose slot is taken goes to the sorted rest
        slot = self._slot(keys)
        self.slot_key, self.slot_rank = np.full(1 << 18, -1, np.int64), np.full(1 << 18, NEVER, np.int32)
        self.slot_key[slot[::-1]], self.slot_rank[slot[::-1]] = keys[::-1], np.arange(len(keys), dtype=np.int32)[::-1]
        rest = np.flatnonzero(self.slot_key[slot] != keys)
        rest = rest[np.argsort(keys[rest])]
        self.rest_key, self.rest_rank = keys[rest], rest.astype(np.int32)
        self.shared = np.zeros(1 << 18, bool)
        self.shared[slot[rest]] = True
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        self.known, self.known_at = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.known_n, self.known_ids = np.empty(0, np.int64), np.empty(0, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER where it does not merge or a side is missing (-1)."""
        key = left.astype(np.int64) << 20 | right
        slot = self._slot(key)
        rank = np.where(self.slot_key[slot] == key, self.slot_rank[slot], np.int32(NEVER))
        again = np.nonzero((rank == NEVER) & self.shared[slot])
        if len(again[0]) and len(self.rest_key):
            k = np.minimum(np.searchsorted(self.rest_key, key[again]), len(self.rest_key) - 1)
            rank[again] = np.where(self.rest_key[k] == key[again], self.rest_rank[k], np.int32(NEVER))
        return rank

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).view(np.int64)

    def encode_short(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words with at most ``size`` symbols (a power of two), all trees at once.

        Leaf p of a tree holds rank and position of the pair that starts at symbol p, a node the smaller
        of its children, so the root is the leftmost pair of the lowest rank. A merge changes three
        leaves; their paths are updated level by level. Trees whose root is NEVER are finished.
        """
        rows, width = len(starts), size + 1
        cols = np.arange(width, dtype=np.int32)
        inside = cols < lens[:, None]
        sym = np.where(inside, self.byte_id[data[np.minimum(starts[:, None] + cols, len(data) - 1)]], np.int32(-1))
        following, before = np.tile(cols + 1, (rows, 1)), np.tile(cols - 1, (rows, 1))
        tree = np.full((rows, 2 * size), NEVER, np.int32)
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        tree[:, size:] = np.where(rank < NEVER, rank << 8 | cols[:size], np.int32(NEVER))
        level = size // 2
        while level:
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
            level //= 2
        symbols, follow, prior, nodes = sym.reshape(-1), following.reshape(-1), before.reshape(-1), tree.reshape(-1)
        active = np.arange(rows)
        while True:
            root = nodes[active * (2 * size) + 1]
            live = root < NEVER
            active, root = active[live], root[live]
            if not len(active):
                break
            p, row, top = root & 0xFF, active * width, active * (2 * size)
            q = follow[row + p]
            after = follow[row + q]
            symbols[row + p] = self.merged[root >> 8]
            symbols[row + q] = -1
            follow[row + p] = after
            has_after = after < lens[active]
            prior[(row + after)[has_after]] = p[has_after]
            pp = prior[row + p]
            has_before = pp >= 0
            here = self.ranks(symbols[row + p], np.where(has_after, symbols[row + np.minimum(after, size)], np.int32(-1)))
            nodes[top + size + p] = np.where(here < NEVER, here << 8 | p, np.int32(NEVER))
            nodes[top + size + q] = NEVER
            ahead = self.ranks(symbols[(row + pp)[has_before]], symbols[(row + p)[has_before]])
            nodes[(top + size + pp)[has_before]] = np.where(ahead < NEVER, ahead << 8 | pp[has_before], np.int32(NEVER))
            base = np.concatenate([top, top, top[has_before]])
            node = np.concatenate([size + p, size + q, (size + pp)[has_before]]) >> 1
            while len(node) and node[0]:
                nodes[base + node] = np.minimum(nodes[base + 2 * node], nodes[base + 2 * node + 1])
                node = node >> 1
        kept = inside & (sym >= 0)
        return sym[kept].astype(np.int32), kept.sum(1)

    def encode_long(self, word: bytes) -> list[int]:
        """The same with one tree in plain lists: n log n for a word without any break."""
        n = len(word)
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        size = 1 << max(1, (n - 1).bit_length())
        follow, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        never, rank_of, merged = 1 << 62, self.rank_of, self.merged.tolist() if n > 4096 else self.merged
        shift = size.bit_length()
        tree = [never] * (2 * size)
        for p in range(n - 1):
            r = rank_of.get(sym[p] << 20 | sym[p + 1])
            if r is not None:
                tree[size + p] = r << shift | p
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(p: int, value: int) -> None:
            k = size + p
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
                k >>= 1

        while tree[1] < never:
            p, r = tree[1] & (1 << shift) - 1, tree[1] >> shift
            q = follow[p]
            sym[p], sym[q] = int(merged[r]), -1
            after = follow[p] = follow[q]
            put(q, never)
            r = rank_of.get(sym[p] << 20 | sym[after]) if after < n else None
            put(p, never if r is None else r << shift | p)
            if after < n:
                prior[after] = p
            pp = prior[p]
            if pp >= 0:
                r = rank_of.get(sym[pp] << 20 | sym[p])
                put(pp, never if r is None else r << shift | pp)
        return [s for s in sym if s >= 0]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) in the order given; words of similar length share a block of trees."""
        lens = ends - starts
        counts, parts, origin = np.zeros(len(starts), np.int64), [], []
        sizes = np.where(lens > LONG, -1, 1 << np.ceil(np.log2(np.maximum(lens, 2))).astype(np.int64))
        for size in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == size)
            if size < 0:
                for w in which.tolist():
                    word = data[starts[w]:ends[w]].tobytes()
                    ids = [self.special[word]] if word in self.special else self.encode_long(word)
                    counts[w] = len(ids)
                    parts.append(np.array(ids, np.int32))
                    origin.append(np.array([w]))
                continue
            step = max(1, (1 << 19) // size)
            for k in range(0, len(which), step):
                block = which[k:k + step]
                ids, n = self.encode_short(data, starts[block], lens[block], size)
                counts[block] = n
                parts.append(ids)
                origin.append(block)
        if not parts:
            return np.empty(0, np.int32), counts
        flat, order = np.concatenate(parts), np.concatenate(origin)
        at = np.empty(len(starts), np.int64)
        n = counts[order]
        at[order] = np.cumsum(n) - n
        out = flat[spread(at, counts)]
        for token, i in self.special.items():           # a special token is a word of its own, never merged
            for w in np.flatnonzero(lens == len(token)).tolist() if len(token) <= LONG else []:
                if data[starts[w]:ends[w]].tobytes() == token:
                    s = int(counts[:w].sum())
                    out = np.concatenate([out[:s], np.array([i], np.int32), out[s + counts[w]:]])
                    counts[w] = 1
        return out, counts

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in them) of the texts of a slice."""
        starts = word_starts(data, at, self.special)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(at), np.int64)
        codes, distinct = pd.factorize(range_hashes(data, starts, ends))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        order = np.argsort(distinct)
        distinct, first = distinct[order], first[order]
        if len(self.known) + len(distinct) > self.cache_words:
            self._forget()
        k = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(k, len(self.known) - 1)] != distinct
        if new.any():
            ids, n = self.encode_words(data, starts[first[new]], ends[first[new]])
            self.known_at = np.insert(self.known_at, k[new], len(self.known_ids) + np.cumsum(n) - n)
            self.known_n = np.insert(self.known_n, k[new], n)
            self.known = np.insert(self.known, k[new], distinct[new])
            self.known_ids = np.concatenate([self.known_ids, ids])
            k = np.searchsorted(self.known, distinct)
        place = np.empty(len(order), np.int64)
        place[order] = k
        word = place[codes]
        n = self.known_n[word]
        ids = self.known_ids[spread(self.known_at[word], n)]
        total = np.append(0, np.cumsum(n))
        rows = total[np.searchsorted(starts, at)]
        if not np.array_equal(self.decode(ids), data):      # two words of one hash: encode without the cache
            ids, n = self.encode_words(data, starts, ends)
            total = np.append(0, np.cumsum(n))
            rows = total[np.searchsorted(starts, at)]
            self._forget()
        return ids, rows

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        return self.piece_bytes[spread(self.piece_start[ids], self.piece_length[ids])]


def word_starts(data: np.ndarray, at: np.ndarray, special: dict[bytes, int]) -> np.ndarray:
    """Where the words of the byte-level pattern begin: contractions, letters, numbers or others with one
    leading blank, runs of white space without the character that leads the next word."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    table = classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = [data[np.minimum(lead + k, n - 1)].astype(np.int64) for k in range(4)]
        two = (b[0] & 0x1F) << 6 | b[1] & 0x3F
        three = (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
        four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F
        c = table[np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, np.minimum(four, 0x10FFFF)))]
        for k, least in ((0, 0xC0), (1, 0xC0), (2, 0xE0), (3, 0xF0)):
            own = b[0] >= least
            kind[lead[own] + k] = c[own]
    fixed = np.zeros(n + 1, bool)
    fixed[at] = True
    spans = []
    text = data.tobytes() if special else b""
    for token in special:
        k = text.find(token)
        while k >= 0:
            row = int(np.searchsorted(at, k, "right"))
            if k + len(token) <= at[row]:
                spans.append((k, k + len(token)))
                fixed[[k, k + len(token)]] = True
            k = text.find(token, k + len(token))
    begin = fixed[:-1].copy()
    begin[0] = True
    begin[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begin)
    stops = np.append(runs[1:], n)
    cls = kind[runs]
    joined = np.append(~fixed[runs[1:]], False)             # the next run belongs to the same text
    blank = np.flatnonzero((cls == SPACE) & joined)
    last = stops[blank] - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    begin[last] = True
    begin[stops[blank][data[last] == 0x20]] = False
    quote = np.flatnonzero((cls[:-1] == OTHER) & (data[runs[:-1]] == 0x27) & (stops[:-1] - runs[:-1] == 1)
                           & begin[runs[:-1]] & joined[:-1] & (cls[1:] == LETTER))
    if len(quote):
        s, e = stops[quote], stops[quote + 1]
        a, b = data[s], np.where(s + 1 < e, data[np.minimum(s + 1, n - 1)], 0)
        one = np.isin(a, list(b"stmd"))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(one, 1, np.where(two, 2, 0))
        begin[s[size > 0]] = False
        rest = (size > 0) & (s + size < e)
        begin[(s + size)[rest]] = True
    for s, e in spans:
        begin[s + 1:e] = False
    return np.flatnonzero(begin)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the token ids of every text. Null and empty texts have no ids; a special token's string
    is that token. The tokenizer file must lie at ``path`` on every executor. No shuffle."""
    path = path or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part, data, at in slices(batches, limit=SLICE):
            ids, rows = v.encode(data, at)
            lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], lists], ["doc_id", "ids"])

    return texts(docs).mapInArrow(task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of every list of ids (null: empty); bytes that are not UTF-8 are replaced."""
    path = path or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = [v.decode(np.array(ids or [], np.int64)).tobytes().decode("utf-8", "replace") for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def op7(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the text they decode to, made where the ids are."""
    path = path or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256
        v = vocabulary(path)
        for part, data, at in slices(batches, limit=SLICE):
            ids, rows = v.encode(data, at)
            back, packed = v.decode(ids), ids.astype("<u4")
            ends = np.append(0, np.cumsum(v.piece_length[ids]))[rows]
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], pa.array(np.diff(rows), pa.int64()),
                pa.array([sha256(packed[a:b]).hexdigest() for a, b in zip(rows[:-1], rows[1:])], pa.string()),
                pa.array([sha256(back[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
