"""Spelling variant grouping over permuterm rotations."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from civicledger.llm.common import lower_ascii, staged

END = "$"
LONGEST_KEY = 64
MODULUS, BASE = (1 << 127) - 1, 0x5DEECE66D1F3A9B7C6E58D2F4B13579B
EXACT, LAST_OF_RUN, INSIDE_RUN = 0, 1, 2
ROTATION = "key string, id long, n long, kind int"
NEIGHBOUR = "id long, n_near long, best_n long, best_id long"
FLUSH_ROWS = 50_000


# ---- words ---------------------------------------------------------------------------------------

def count_words(docs: DataFrame, min_chars: int = 7, min_count: int = 2, slip_every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of Latin letters with A-Z lower-cased, of at least ``min_chars`` code
    points and ``min_count`` occurrences over all documents.

    ``slip_every`` plants typing slips: with h the crc32 of ``<doc_id>:<run>``, a run whose h it divides
    loses its code point h % length. A null text has no words; a null doc_id reads as the empty string;
    repeated rows count again. Occurrences are summed per task before the shuffle.
    """
    # a slip takes one code point away, so shorter runs can never become long enough
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-zÀ-ÿ]{{{max(1, min_chars)},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    words = words.select("doc", lower_ascii(F.col("run")).alias("w"))
    if slip_every:
        words = words.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "w"), "UTF-8")))
        at = F.pmod("h", F.char_length("w")).cast("int")
        slipped = F.concat(F.substring("w", F.lit(1), at), F.substring(F.col("w"), at + 2, F.char_length("w")))
        words = words.select(F.when(F.pmod("h", F.lit(slip_every)) == 0, slipped).otherwise(F.col("w")).alias("w"))
    return (words.filter(F.char_length("w") >= min_chars).groupBy(F.col("w").alias("word"))
            .agg(F.count("*").alias("n")).filter(F.col("n") >= min_count))


# ---- rotations -------------------------------------------------------------------------------------

def _digests(w: str) -> tuple[list[int], list[int]]:
    pre, power = [0], [1]
    for c in w:
        pre.append((pre[-1] * BASE + ord(c)) % MODULUS)
        power.append(power[-1] * BASE % MODULUS)
    return pre, power


def rotations(w: str) -> Iterator[tuple[str, int]]:
    """(prefix, kind) of every rotation of ``w`` + END that an edit can meet.

    Written x c y, the rotation that starts behind c is ``y END x c``: all words that differ from w at c
    only share its prefix ``y END x``, and the word without c is that prefix itself. So a rotation gives
    its prefix (kinds LAST_OF_RUN and INSIDE_RUN: c skipped) and itself (EXACT: nothing skipped). Taking
    any letter out of a run of equal ones gives the same word; only the run's last one counts for that.
    Prefixes longer than LONGEST_KEY are given by a 127-bit polynomial digest, made in constant time from
    those of w's beginnings, so a word of m letters costs m and not m * m.
    """
    m = len(w)
    if m >= LONGEST_KEY:
        pre, power = _digests(w)
        tail = lambda i: (pre[m] - pre[i] * power[m - i]) % MODULUS
        spin = lambda i, j: f"\x00{((tail(j) * BASE + ord(END)) * power[i] + pre[i]) % MODULUS:032x}"
    for i in range(m + 1):
        yield (w[i:] + END + w[:i] if m + 1 <= LONGEST_KEY else spin(i, i)), EXACT
    for i in range(m):
        kind = LAST_OF_RUN if i + 1 == m or w[i] != w[i + 1] else INSIDE_RUN
        yield (w[i + 1:] + END + w[:i] if m <= LONGEST_KEY else spin(i, i + 1)), kind


def _rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, kinds, ids, ns, times = [], [], [], [], []

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.repeat(np.array(ids, np.int64), times)),
                                        pa.array(np.repeat(np.array(ns, np.int64), times)), pa.array(kinds, pa.int32())],
                                       ["key", "id", "n", "kind"])
        for x in (keys, kinds, ids, ns, times):
            x.clear()
        return b

    for b in batches:
        for i, w, n in zip(b["id"].to_pylist(), b["word"].to_pylist(), b["n"].to_pylist()):
            ids.append(i)
            ns.append(n)
            times.append(0)
            for key, kind in rotations(w):
                keys.append(key)
                kinds.append(kind)
                times[-1] += 1
                if len(keys) >= FLUSH_ROWS:
                    yield out()
                    ids.append(i)
                    ns.append(n)
                    times.append(0)
    if keys:
        yield out()


# ---- sorted scan -----------------------------------------------------------------------------------

def _first_two(g: np.ndarray, n: np.ndarray, i: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the most frequent and the next member of each group (ties: smaller id), or -1."""
    order = np.lexsort((i, -n, g))
    start = np.searchsorted(g[order], np.arange(groups))
    size = np.bincount(g, minlength=groups)
    at = np.append(order, -1)       # the place behind the end is never used
    one = np.where(size > 0, at[np.minimum(start, len(order))], -1)
    two = np.where(size > 1, at[np.minimum(start + 1, len(order))], -1)
    return one, two


def neighbours_of_groups(key: pa.Array, ids: np.ndarray, n: np.ndarray, kind: np.ndarray) -> pa.RecordBatch | None:
    """For whole groups of equal prefixes, in order: each member's number of near words in its group and
    the best of them. A group has at most one word per letter of the alphabet and one shorter word, and
    no pair is listed: two leaders per group answer for all members."""
    new = np.ones(len(key), bool)
    if len(key) > 1:
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    g = np.cumsum(new) - 1
    shared = np.bincount(g)[g] > 1
    if not shared.any():
        return None
    ids, n, kind, g = ids[shared], n[shared], kind[shared], np.unique(g[shared], return_inverse=True)[1]
    groups = g[-1] + 1
    longer, last, exact = np.flatnonzero(kind != EXACT), np.flatnonzero(kind == LAST_OF_RUN), np.flatnonzero(kind == EXACT)
    lead, second = (np.where(x >= 0, longer[x] if len(longer) else -1, -1) for x in _first_two(g[longer], n[longer], ids[longer], groups))
    lead_last = _first_two(g[last], n[last], ids[last], groups)[0]
    lead_last = np.where(lead_last >= 0, last[lead_last] if len(last) else -1, -1)
    shorter = np.full(groups, -1)
    shorter[g[exact]] = exact
    n_longer, n_last = np.bincount(g[longer], minlength=groups), np.bincount(g[last], minlength=groups)

    rows = np.arange(len(g))
    is_exact = kind == EXACT
    meets_shorter = (kind == LAST_OF_RUN) & (shorter[g] >= 0)
    near = np.where(is_exact, n_last[g], n_longer[g] - 1 + meets_shorter)
    best = np.where(is_exact, lead_last[g], np.where(lead[g] == rows, second[g], lead[g]))
    other = np.where(meets_shorter, shorter[g], -1)
    better = (other >= 0) & ((best < 0) | (n[other] > n[best]) | (n[other] == n[best]) & (ids[other] < ids[best]))
    best = np.where(better, other, best)
    told = near > 0
    best = best[told]
    return pa.RecordBatch.from_arrays([pa.array(ids[told]), pa.array(near[told].astype(np.int64)), pa.array(n[best]), pa.array(ids[best])],
                                      ["id", "n_near", "best_n", "best_id"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rotations arrive sorted by prefix; the last, perhaps unfinished group waits for the next batch."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.concat_batches([held, b]) if held is not None else b
        key = t["key"]
        same = pc.not_equal(key, key[len(key) - 1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(same)[-1]) + 1 if same.any() else 0
        held = t.slice(cut)
        if cut and (out := neighbours_of_groups(key[:cut], *(t[c].to_numpy()[:cut] for c in ("id", "n", "kind")))) is not None:
            yield out
    if held is not None and (out := neighbours_of_groups(held["key"], *(held[c].to_numpy() for c in ("id", "n", "kind")))) is not None:
        yield out


# ---- variants --------------------------------------------------------------------------------------

def near_words(vocabulary: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best_id) of the words that have near ones, from (id, word, n)."""
    return (vocabulary.mapInArrow(_rotate, ROTATION).repartition("key").sortWithinPartitions("key").mapInArrow(_scan, NEIGHBOUR)
            .groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best_id")).alias("minus"))).alias("b"))
            .select("id", "n_near", F.col("b.best_n").alias("best_n"), (-F.col("b.minus")).alias("best_id")))


def follow_forms(edges: DataFrame, ratio: int) -> DataFrame:
    """(id, to) with ``to`` moved on to the end of its chain. Each step multiplies n by ``ratio``, so the
    largest n bounds a chain's length and with it the number of doubling rounds."""
    hops, top = 1, edges.agg(F.max("form_n")).first()[0] or 0
    while ratio > 1 and ratio ** (hops + 1) <= top:
        hops += 1
    if ratio <= 1:
        raise ValueError("the ratio must be above 1, or forms could run in circles")
    to = edges.select("id", F.col("form_id").alias("to"))
    for k in range((hops - 1).bit_length()):
        on = to.select(F.col("id").alias("to"), F.col("to").alias("further"))
        to = staged(to.join(on, "to", "left").select("id", F.coalesce("further", "to").alias("to")), f"forms-{k}")
    return to


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of ``words`` (word, n; distinct words).

    Two words are near if one insertion, deletion or replacement of a code point turns one into the
    other. The form is the near word of largest n (ties: first in code-point order) if that n is at least
    ``ratio`` times the word's own, else null; the root is where following forms ends. Words are
    numbered in code-point order by a range sort. Rotations meet in tasks dealt out by prefix; a prefix
    has at most one row per letter, so no group is hot however frequent its words are.
    """
    plain = words.select("word", F.col("n").cast("long").alias("n")).filter("word is not null")
    vocabulary = staged(plain.repartitionByRange("word").sortWithinPartitions("word")
                        .select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    near = staged(near_words(vocabulary), "near")
    edges = staged(near.join(vocabulary.select("id", "n"), "id").filter(F.col("best_n") >= ratio * F.col("n"))
                   .select("id", F.col("best_id").alias("form_id"), F.col("best_n").alias("form_n")), "edges")
    named = (edges.join(follow_forms(edges, ratio), "id")
             .join(vocabulary.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id")
             .join(vocabulary.select(F.col("id").alias("to"), F.col("word").alias("root")), "to")
             .select("id", "form", "form_n", "root"))
    return (vocabulary.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")))


def op11(docs: DataFrame) -> DataFrame:
    return group_variants(count_words(docs, slip_every=31))
