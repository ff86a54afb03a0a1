"""Quality classifier: ordinal cumulative-link regression on hashed text."""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from civicledger.llm.common import staged, texts
from civicledger.llm.textvec import TO_LOWER, U, range_hashes, slices, words

BITS = 18
GRADES = 3              # 0 toxic, 1 poor, 2 good
BINS = 16               # of each share-like property of a text
PROPERTIES = 7
_OFFSET = (1 << BITS) - BINS * PROPERTIES      # the last buckets hold the properties

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


class Model(NamedTuple):
    """One weight per bucket for all grades and ordered thresholds: P(grade <= k) = logistic(theta[k] - score)."""
    weights: np.ndarray
    theta: np.ndarray

    def expected_and_tail(self, score: np.ndarray, grade: int = GRADES - 1) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= ``grade``)."""
        at_most = _logistic(self.theta - score[:, None])
        return (1 - at_most).sum(1), 1 - at_most[:, grade - 1]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), sorted and distinct, of the texts of a slice: the words without outer punctuation and
    with A-Z lower-cased, and one bucket for each property of the whole text (shares of upper-case words,
    of words that end in or are punctuation, of distinct words, of punctuation and digits; mean length).
    ``wanted`` limits the result to buckets that have a weight."""
    rows = len(at) - 1
    starts, ends, row = words(data, at)
    n = len(data)
    ok = _ALNUM[data]
    ahead = np.minimum.accumulate(np.where(ok, np.arange(n), n)[::-1])[::-1] if n else np.empty(0, np.int64)
    back = np.maximum.accumulate(np.where(ok, np.arange(n), -1)) if n else np.empty(0, np.int64)
    s, e = ahead[starts], back[ends - 1] + 1
    core = e > s
    s, e = np.where(core, s, starts), np.where(core, e, ends)
    low = TO_LOWER[data]
    h = range_hashes(low, s, e)
    bucket = (h >> U(64 - BITS)).astype(np.int64) % _OFFSET
    total = np.bincount(row, minlength=rows)
    upper, lower = np.append(0, np.cumsum(_UPPER[data])), np.append(0, np.cumsum(_LOWER[data]))
    shouting = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    trailing = ends - e >= 2
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=rows)
    size = np.diff(at)
    marks, digits = np.append(0, np.cumsum((data < 128) & ~ok & (data > 32))), np.append(0, np.cumsum((data >= 48) & (data < 58)))
    per_word, per_byte = 1 / np.maximum(total, 1), 1 / np.maximum(size, 1)
    shares = [np.bincount(row, shouting, rows) * per_word, np.bincount(row, trailing, rows) * per_word, np.bincount(row, ~core, rows) * per_word,
              distinct * per_word, (marks[at[1:]] - marks[at[:-1]]) * per_byte, (digits[at[1:]] - digits[at[:-1]]) * per_byte,
              np.minimum(size * per_word / 16, 1)]
    bins = np.stack([np.minimum((np.sqrt(x) if k in (0, 1, 2, 4, 5) else x) * BINS, BINS - 1).astype(np.int64) + _OFFSET + k * BINS for k, x in enumerate(shares)], 1)
    full = np.flatnonzero(total)
    row, bucket = np.concatenate([row, np.repeat(full, PROPERTIES)]), np.concatenate([bucket, bins[full].ravel()])
    if wanted is not None:
        keep = wanted[bucket]
        row, bucket = row[keep], bucket[keep]
    key = np.unique(row << BITS | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, min_docs: int = 5, min_z: float = 5.0,
        rounds: int = 300, l2: float = 1e-4) -> Model:
    """Train on at most ``max_labelled`` labelled documents, those with the smallest hash of their id;
    equal texts count once, with the lowest of their grades.

    Grade: 0 for toxic documents, 1 for others of poor quality, 2 for good ones (a missing label counts as
    poor or not toxic). A bucket gets a weight if ``min_docs`` sample documents have it and one of the
    grades among them is off its share by ``min_z`` standard deviations; words that say nothing about the
    grade would only add noise to long texts. The driver holds the sample's buckets that have a weight,
    and counts of 2**18 buckets at most. Without labelled documents the model calls everything good.
    """
    rated = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.when(F.coalesce("toxic", F.lit(0)) != 0, 0).when(F.coalesce("quality", F.lit(0)) != 0, 2).otherwise(1)).alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in slices(batches):
            row, bucket = features(data, at)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part["grade"], pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket, pa.int32()))], ["grade", "buckets"])

    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("grade").alias("grade"))
    sample = staged(rows.mapInArrow(buckets, "grade int, buckets array<int>"), "sample")
    share = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    everyone = max(1, sum(share.values()))
    counts = sample.select("grade", F.explode("buckets").alias("b")).groupBy("b").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(GRADES)]).filter(F.col("n") >= min_docs)
    off = [F.abs(F.col(f"g{g}") - F.col("n") * q) >= min_z * F.sqrt(F.col("n") * (q * (1 - q))) for g, q in
           ((g, share.get(g, 0) / everyone) for g in range(GRADES)) if 0 < q < 1]
    wanted = np.zeros(1 << BITS, bool)
    wanted[[r["b"] for r in counts.filter(F.greatest(*off) if len(off) > 1 else F.lit(False)).select("b").collect()]] = True

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[x for x in r if wanted[x]] for r in b["buckets"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["grade"], pa.array(out, pa.list_(pa.int32()))], ["grade", "buckets"])

    got = sample.mapInArrow(pruned, "grade int, buckets array<int>").toPandas()
    weights = np.zeros(1 << BITS)
    if not len(got):
        return Model(weights, np.array([-20.0, -10.0]))
    got = got.iloc[sorted(range(len(got)), key=lambda k: (got["grade"].iloc[k], list(got["buckets"].iloc[k])))]     # the same sums on any cluster
    y, n = got["grade"].to_numpy(), got["buckets"].map(len).to_numpy()
    ids, flat = np.unique(np.concatenate([np.asarray(b, np.int64) for b in got["buckets"]]), return_inverse=True)
    weights[ids], theta = _cumulative_link(y, n, flat, len(ids), rounds, l2)
    return Model(weights, theta)


def _cumulative_link(y: np.ndarray, n: np.ndarray, flat: np.ndarray, width: int, rounds: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with Adam over all rows; the gap between thresholds is exp(gap) and stays positive."""
    row = np.repeat(np.arange(len(y)), n)
    p = np.zeros(width + 2)
    p[-2:] = [np.log(((y == 0).sum() + 1) / ((y > 0).sum() + 1)), 0.0]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        theta = np.array([p[-2], p[-2] + np.exp(p[-1])])
        score = np.bincount(row, p[flat], len(y))
        at_most = np.concatenate([np.zeros((len(y), 1)), _logistic(theta - score[:, None]), np.ones((len(y), 1))], 1)
        hi, lo = at_most[np.arange(len(y)), y + 1], at_most[np.arange(len(y)), y]
        prob = np.maximum(hi - lo, 1e-12)
        d_score = (1 - hi - lo) / len(y)                 # of the negative log likelihood
        d_hi, d_lo = -hi * (1 - hi) / prob / len(y), lo * (1 - lo) / prob / len(y)
        first, second = d_hi[y == 0].sum() + d_lo[y == 1].sum(), d_hi[y == 1].sum() + d_lo[y == 2].sum()
        g = np.concatenate([np.bincount(flat, d_score[row], width) + l2 * p[:-2], [first + second, second * np.exp(p[-1])]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return p[:-2], np.array([p[-2], p[-2] + np.exp(p[-1])])


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Expected grade and tail probability of every text, next to the ``carry`` columns (doc_id by default).
    A null or empty text has no bucket: its score is 0. One pass, no shuffle."""
    carried = docs.select(*[f"`{c}`" for c in carry]) if carry else texts(docs)
    at_text = carried.columns.index("text")
    kept = [k for k, c in enumerate(carried.columns) if carry or c != "text"]
    names = [carried.columns[k] for k in kept]
    wanted, weights = model.weights != 0, model.weights
    schema = carried.select(*[f"`{c}`" for c in names]).schema.add("__expected", "double").add("__tail", "double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in slices(batches, at_text):
            row, bucket = features(data, at, wanted)
            expected, tail = model.expected_and_tail(np.bincount(row, weights[bucket], part.num_rows))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(expected), pa.array(tail)], [*names, "__expected", "__tail"])

    return carried.mapInArrow(task, schema)


def select_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose probability of the best grade is at least ``least``, with all columns of ``docs``."""
    model = fit(docs, labels)
    own = ["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)]      # no clash with the scores' names
    return score(docs.toDF(*own), model, own).filter(F.col("__tail") >= least).select(*own).toDF(*docs.columns)


def op5(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, expected grade, probability of the best grade and whether the document is selected."""
    return score(docs, fit(docs, labels)).select("doc_id", F.col("__expected").alias("expected_grade"), F.col("__tail").alias("p_good"),
                                                 (F.col("__tail") >= least).alias("kept"))
