"""Personal data spans by weak supervision: labelers vote, EM weighs them, a span classifier decides."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from civicledger.llm.common import staged, texts

KINDS = ("email", "ip", "card", "phone")
MASKS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")
LABELERS = ("pattern", "gazetteer", "context", "shape", "border")
BUCKETS = 4             # length classes, a feature of the classifier beside the votes

# The base patterns. Possessive forms and the look-behind keep them linear on long runs; they match as the plain ones do.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates beyond the base patterns
HIDDEN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]{2,63}){1,4}")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]{4}(?![0-9]))*+")

# Gazetteers
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name io co uk de fr es it nl eu us ca au jp in br".split())
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5)|35|62")
HINTS = tuple(re.compile(p, re.I) for p in (r"mail|contact|write|courriel|correo|kontakt|@", r"\bip\b|host|server|address|adress|client|login", r"card|visa|master|credit|debit|carte|tarjeta|karte|payment",
                                            r"phone|\btel|call|mobile|fax|contact|téléph|teléf|telef"))
DOUBTS = re.compile(r"version|release|isbn|invoice|order|serial|token|\bid\b|\bno\.|page|section|chapter", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @: the run of local characters before it, from the last match on."""
    last, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            last = m.end()
            yield s, last
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, in kind order and then by start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span and no earlier candidate: written-out addresses, phone numbers
    without a country code, and single numbers of 13 to 19 digits, with or without a valid check digit."""
    found = []
    if "at]" in text or "at)" in text or "at}" in text:
        found += [(0, *m.span()) for m in HIDDEN_EMAIL.finditer(text)]
    found += [(3, *m.span()) for m in LOCAL_PHONE.finditer(text)]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= sum(c.isdigit() for c in m[0]) <= 19:
            found.append((2, *m.span()))
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    from bisect import bisect_right
    out, last = [], 0
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        i = bisect_right(starts, s)
        if s >= last and not (i and taken[i - 1][1] > s) and not (i < len(taken) and taken[i][0] < e):
            out.append((k, s, e))
            last = e
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """One vote of each labeler: 0 abstains, 1 against, 2 for."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = text[max(0, start - 32):start]
    yes = lambda ok: 2 if ok else 1
    if kind == 0:
        end_label = re.split(r"[.\s\]})]+", span)[-1].lower()
        own = [2 if base else 0, 2 if end_label in TOP_DOMAINS else 0, yes(len(span) <= 128 and ".." not in span)]
    elif kind == 1:
        parts = span.split(".")
        own = [2 if base else 0, yes(0 < int(parts[0]) < 240), yes(not any(len(p) > 1 and p[0] == "0" for p in parts))]
    elif kind == 2:
        groups = re.split(r"[ -]", span)
        own = [yes(luhn(digits)), yes(ISSUERS.match(digits)), yes(len(groups) == 1 or all(len(g) == 4 for g in groups[:-1]))]
    else:
        own = [2 if base else 0, yes(digits.startswith(CALLING_CODES)) if base else 0, yes(10 <= len(digits) <= 13)]
    context = 2 if HINTS[kind].search(before) else 1 if DOUBTS.search(before) else 0
    joined = text[start - 1:start].isalnum() or text[end:end + 1].isalnum()
    return [own[0], own[1], context, own[2], yes(not joined)]


def signature(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """Kind, votes and length class of a candidate as one number: all that EM and the classifier see."""
    code = kind
    for v in votes(text, kind, start, end, base):
        code = code * 3 + v
    return code * BUCKETS + min((end - start) // 8, BUCKETS - 1)


PATTERNS = len(KINDS) * 3 ** len(LABELERS) * BUCKETS


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes, length class) of candidate numbers."""
    length, rest = codes % BUCKETS, codes // BUCKETS
    v = np.stack([rest // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))], 1)
    return rest // 3 ** len(LABELERS), v, length


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and the labelers' vote tables, by expectation-maximisation over
    pattern counts: given the truth of a span, labelers vote independently."""
    lean = ((v == 2).sum(1) - (v == 1).sum(1)).astype(float)
    post = 1 / (1 + np.exp(-2 * lean + 1))
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        prior = (w.sum(1) + 1) / (w.sum() + 2)
        table = np.stack([[[(w[y] * (v[:, j] == a)).sum() + 0.5 for a in range(3)] for j in range(v.shape[1])] for y in range(2)])
        # a labeler may not end up meaning the opposite of its vote
        table /= table.sum(2, keepdims=True)
        up, down = np.maximum(table[1, :, 2], table[0, :, 2]), np.minimum(table[1, :, 2], table[0, :, 2])
        table[1, :, 2], table[0, :, 2] = up, down
        table[:, :, 1] = np.maximum(1 - table[:, :, 0] - table[:, :, 2], 1e-3)
        logp = np.log(prior)[:, None] + sum(np.log(table[:, j, v[:, j]]) for j in range(v.shape[1]))
        post = 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -30, 30)))
    return post, table


def train(codes: np.ndarray, n: np.ndarray, steps: int = 30) -> np.ndarray:
    """Probability of every possible candidate number: a logistic regression per kind on votes and length
    class, fitted by Newton steps to the posteriors of the patterns seen."""
    out = np.zeros(PATTERNS)
    every_kind, every_votes, every_length = unpack(np.arange(PATTERNS))

    def design(v: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(v), 1)), *[(v == a).astype(float) for a in (1, 2)], (length[:, None] == np.arange(1, BUCKETS)).astype(float)], 1)

    kind, v, length = unpack(codes)
    for k in range(len(KINDS)):
        own = kind == k
        if not own.any():
            continue
        y, _ = reliabilities(v[own], n[own].astype(float))
        x, w = design(v[own], length[own]), n[own].astype(float)
        beta = np.zeros(x.shape[1])
        ridge = np.eye(len(beta))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
            beta = beta + np.clip(np.linalg.solve(h, x.T @ (w * (y - p)) - beta), -2, 2)
        all_k = every_kind == k
        out[all_k] = 1 / (1 + np.exp(-np.clip(design(every_votes[all_k], every_length[all_k]) @ beta, -30, 30)))
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of each text: kind, start, end (code points), base, code. No shuffle."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                out = []
                for text in part["text"]:
                    text = text.as_py()
                    base = base_spans(text)
                    out.append([{"kind": k, "start": s, "end": e, "base": own, "code": signature(text, k, s, e, own)}
                                for own, spans in ((True, base), (False, further_spans(text, base))) for k, s, e in spans])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(out, SPANS)], ["doc_id", "found"])

    return texts(docs).mapInArrow(task, "doc_id long, found array<struct<kind:int,start:int,end:int,base:boolean,code:int>>")


SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())]))


def fit(found: DataFrame, least: float = 0.9) -> list[int]:
    """The candidate numbers that the classifier accepts. Only counts by number (a few thousand at most)
    reach the driver, however large the corpus."""
    counts = found.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    p = train(np.array([r["code"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.int64))
    return np.flatnonzero(p >= least).tolist()


def spans(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, the base spans and all spans of every text (null: empty) as arrays of (kind, start, end).

    Base spans always stay; other candidates stay where the trained classifier gives them ``least``.
    Rows with the same doc_id are answered each on their own.
    """
    found = staged(candidates(docs), "candidates")
    accepted = fit(found, least)
    good = F.array(*[F.lit(c) for c in accepted]) if accepted else F.array().cast("array<int>")
    slim = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    return found.select("doc_id", slim(F.filter("found", lambda x: x["base"])).alias("base"),
                        slim(F.filter("found", lambda x: x["base"] | F.array_contains(good, x["code"]))).alias("spans"))


def redact(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """``docs`` with every span in its text replaced by the mask of its kind; all other columns and null
    texts stay as they are. Overlapping spans become one mask, that of the first one. An ``n_chars``
    column follows the text."""
    accepted = frozenset(fit(staged(candidates(docs), "candidates"), least))
    names, schema, at = docs.columns, docs.schema, docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        found = base + [(k, s, e) for k, s, e in further_spans(text, base) if signature(text, k, s, e, False) in accepted]
        if not found:
            return text
        out, last = [], 0
        for k, s, e in sorted(found, key=lambda x: (x[1], x[0])):
            if s >= last:
                out += [text[last:s], MASKS[k]]
            last = max(last, e)
        return "".join([*out, text[last:]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                new = pa.array([clean(t.as_py()) for t in part.column(at)], part.column(at).type)
                yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(part.columns)], names)

    out = docs.mapInArrow(task, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op3(docs: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])

    def line(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(k: int):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return spans(docs).select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
