"""Spelling variants, WARC archives and conversation repair against plain versions."""
import gzip
import hashlib
import heapq
import io
import itertools
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
from civicledger.llm import conversations, spelling, warc

ROWS = brute.corpus()


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# ---- spelling variants ---------------------------------------------------------------------------

def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(docs, slip: bool = True):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(brute.UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % 31 == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1:]
            n[w] += len(w) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def plain_variants(n: dict, ratio: int = 10) -> Counter:
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return Counter((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def typed(seed: int = 5):
    r = random.Random(seed)
    stems = ["abcdefgh", "aaaaaaaa", "abababab", "Straßenbau", "éçàôûïëü", "x" * 70, "y" * 64, "z" * 65, "".join(r.choice("abc") for _ in range(90))]
    bag = []
    for s in stems:
        bag += [s] * 400
        for _ in range(30):
            w = list(s)
            for _ in range(r.choice((1, 1, 1, 2))):
                p, c = r.randrange(len(w)), r.choice("abcxyzé")
                w[p:p + r.randint(0, 1)] = [c] * r.randint(0, 1)
            bag += ["".join(w)] * r.choice((2, 3, 25, 40))
    r.shuffle(bag)
    return [(k % 13 if k % 13 else None, " ".join(bag[k::200])) for k in range(200)] + [(14, None), (15, ""), (16, "short a I"), (17, "q" * 5000 + " " + "q" * 4999), (18, "q" * 5000 + "1" + "q" * 4999)]


def test_rotations_of_neighbours_share_a_prefix():
    r = random.Random(3)
    for _ in range(300):
        w = "".join(r.choice("ab") for _ in range(r.choice((7, 9, 63, 64, 65, 66))))
        p = r.randrange(len(w))
        for v in (w[:p] + "c" + w[p + 1:], w[:p] + w[p + 1:]):
            a, b = Counter(spelling.rotations(w)), Counter(spelling.rotations(v))
            longer, shorter = {k for k, kind in a if kind}, {k for k, kind in b if kind == (0 if len(v) < len(w) else kind or 9)}
            assert longer & shorter


def test_spelling_variants(spark):
    docs = typed()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, word string, n long").repartition(5)
    n = plain_words(docs)
    got = rows(spelling.op11(df))
    want = plain_variants(n)
    assert len(n) > 150 and sum(1 for w in want if w[3]) > 30 and got == want


def test_spelling_variants_of_the_corpus(spark):
    docs = [(r[0], r[1]) for r in ROWS] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(spelling.op11(df)) == plain_variants(plain_words(docs))
    words = spark.createDataFrame([("house", 90), ("hose", 9), ("horse", 9), (None, 3)], "word string, n long")
    assert rows(spelling.group_variants(words)) == plain_variants({"house": 90, "hose": 9, "horse": 9})


def test_chains_of_forms_are_followed_to_the_end(spark):
    words = [("a" * 7 + "bcdefghijklmnop"[:k], 10 ** k) for k in range(15)]
    got = {r["word"]: r["root"] for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]}


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.op11(empty).count() == 0 and spelling.op11(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).count() == 0


# ---- WARC --------------------------------------------------------------------------------------------

def pages():
    big, other = "<p>é</p>" * 200, "x" * 1000
    out = [(k, f"http://h/{k}", big) for k in (3, 1, 7, 7, 5)] + [(k, "http://h/ü x\r\nEvil: 1", other) for k in (10, 12)]
    out += [(20, None, None), (21, "", ""), (22, "u", "x" * 999), (23, "u", "x" * 999), (None, "n", big), (None, "n", "only null" * 200), (None, "m", "only null" * 200)]
    out += [(30, "long", "ab😀" * 300_000), (31, "odd", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 50)]
    return [(*r, "clash", 5) for r in out]


PAGES = "page_id long, url string, html string, payload string, key long"


def plain_warc(ps):
    last = {}
    for i, _, h, *_ in ps:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    out = Counter()
    for i, _, h, *_ in ps:
        b, top = (h or "").encode(), last[h or ""]
        again = len(b) >= 1000 and top != (-1 if i is None else i)
        out[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    return out


@pytest.mark.parametrize("hot_parts", [1000, 3, 1])
def test_archives(spark, hot_parts, monkeypatch):
    split = warc.with_revisits
    monkeypatch.setattr(warc, "with_revisits", lambda p, m: split(p, m, hot_parts))
    assert rows(warc.op12(spark.createDataFrame(pages(), PAGES).repartition(3))) == plain_warc(pages())


def test_archives_round_trip(spark):
    ps = pages()
    archives = warc.write_archives(spark.createDataFrame(ps, PAGES).coalesce(1), archive_bytes=3000)
    assert archives.count() > 2 and archives.agg(F.sum("records")).first()[0] == len(ps)
    got = warc.read_archives(archives, with_payload=True).collect()
    assert not any(r["problem"] for r in got)
    assert Counter((r["page_id"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response") == Counter(
        (i, h or "") for i, _, h, *_ in ps for _ in [0] if (i, h) not in {(k, ps[0][2]) for k in (3, 1, 5, None)} | {(10, ps[5][2])})
    assert all("\r" not in (r["url"] or "") and " " not in (r["url"] or "") for r in got)
    # every archive is plain gzip, with one member per record
    for a in archives.collect():
        raw = open(a["path"].removeprefix("file:"), "rb").read()
        assert len(raw) == a["bytes"] and gzip.decompress(raw).count(b"WARC-Record-ID: ") == a["records"]
    assert warc.op12(spark.createDataFrame([], PAGES)).count() == 0


def member(head: bytes, block: bytes) -> bytes:
    return gzip.compress(head + block + b"\r\n\r\n")


def test_broken_archives_are_told():
    good = member(*warc.record_bytes(1, "u", b"a" * 5000))
    head, block = warc.record_bytes(2, "u", b"b" * 5000)
    bad = member(head, block[:-1] + b"c")
    read = lambda raw: [(r.get("page_id"), r["problem"]) for r in warc.read_records(io.BytesIO(raw).read)]
    assert read(good + good) == [(1, None)] * 2 and read(b"") == []
    assert read(good + bad + good) == [(1, None), (2, "block digest"), (1, None)]
    lying = member(head.replace(b"sha1:", b"sha1:" + b"A" * 32 + b"\r\nX: ", 1), block)
    assert read(lying) == [(2, "payload digest")]
    assert [p is None for _, p in read(good + good[:-20])] == [True, False]
    assert [p is None for _, p in read(good + b"junk" + good)] == [True, False]
    assert read(member(head, block + b"more"))[0][1].startswith("the record goes on") and "shorter" in read(gzip.compress(head + block[:-9]))[0][1]
    assert "no end of the header" in read(gzip.compress(b"WARC/1.1 and nothing else"))[0][1] and "Content-Length" in read(gzip.compress(b"WARC/1.1\r\nA: b\r\n\r\n"))[0][1]
    assert read(gzip.compress(b"HTTP/1.1\r\n\r\n"))[0][1] == "not a WARC record"
    # two records in one member break the rule of one member per record
    assert "goes on" in read(gzip.compress(gzip.decompress(good) * 2))[0][1]
    # a huge record comes out in bounded pieces
    huge = warc.Members(io.BytesIO(gzip.compress(b"\0" * (50 << 20))).read)
    assert huge.next_member() and max(map(len, huge.pieces(50 << 20))) <= warc.CHUNK


# ---- conversations ---------------------------------------------------------------------------------------

def plain_repair(turns):
    """Cheapest audit of [(initial, must go, cut off)] by a shortest-path search over (cost, audit)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, line = heapq.heappop(heap)
        state = (i, "0" if not line else line[-1], line == "s")
        if state in done:
            continue
        done.add(state)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", line):
            return cost, audit, line
        want = "a" if line[-1:] == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, line + want))
        if i < len(turns):
            initial, must, cut = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, line))
            if not must:
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, line + want))
                if initial in ("u", "a") and initial == want or initial == "s" and not line:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, line + initial))


def all_repairs(turns, most: int = 4):
    """Every edit sequence with few insertions: the least (cost, audit) that gives a well-formed line."""
    best = None
    for inserts in itertools.product(range(most), repeat=len(turns) + 1):
        for edits in itertools.product("DKR", repeat=len(turns)):
            cost, audit, line = 0, "", ""
            for k in range(len(turns) + 1):
                for _ in range(inserts[k]):
                    cost, audit, line = cost + 3, audit + "I", line + ("a" if line[-1:] == "u" else "u")
                if k == len(turns):
                    break
                (initial, must, cut), e = turns[k], edits[k]
                audit += e
                if e == "D":
                    cost += 4
                elif must:
                    cost = 10 ** 6
                else:
                    cost += 3 * cut + 3 * (e == "R")
                    line += initial if e == "K" else "a" if line[-1:] == "u" else "u"
            if cost < 10 ** 6 and re.fullmatch("(s?(ua)+)?", line) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def symbols(turns):
    return bytes(conversations.symbol(*t) for t in turns)


def test_edits_against_all_edit_sequences():
    kinds = [(i, m, c) for i in "suat" for m in (False, True) for c in (False, True) if not (m and c)]
    for n in range(3):
        for turns in itertools.product(kinds, repeat=n):
            assert conversations.cheapest_edits(symbols(turns)) == all_repairs(turns, 3)
    r = random.Random(2)
    for _ in range(40):
        turns = [r.choice(kinds) for _ in range(3)]
        assert conversations.cheapest_edits(symbols(turns)) == all_repairs(turns, 3)


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_against_shortest_paths(block):
    r = random.Random(block)
    for _ in range(300):
        turns = [(r.choice("suauat"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 14))]
        assert conversations.cheapest_edits(symbols(turns), block) == plain_repair(turns)[:2]


def damaged(convs):
    out = defaultdict(list)
    for c, turn, role, text in convs:
        out[c] = out[c]
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out[c] += [] if h == 0 else [(turn, role, text)] * (2 if h == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def plain_conversations(convs):
    out, lines = Counter(), {}
    for c, turns in damaged(convs).items():
        seen, kinds, counts = set(), [], Counter()
        for _, role, text in turns:
            visible = text.strip(conversations.BLANKS)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        line = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(line, line[1:]))
        nums = {t for t, _, _ in turns if t is not None}
        gaps = max(nums) - min(nums) + 1 - len(nums) if nums else 0
        cost, audit, _ = plain_repair(kinds)
        fixed, left, names = [], list(turns), {"u": "user", "a": "assistant"}
        for e in audit:
            want = names["a" if fixed and fixed[-1][0][:1] == "u" else "u"]
            if e == "I":
                fixed.append((want, ""))
                continue
            _, role, text = left.pop(0)
            if e != "D":
                fixed.append((role if e == "K" else want, text))
        lines[c] = fixed
        out[c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{a}:{b}" for a, b in fixed).encode()).hexdigest()] += 1
    return out, lines


def talks(seed: int = 4):
    r = random.Random(seed)
    out = []
    for c in [*range(150), None]:
        for k in range(r.randint(0, 9)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "support"])
            text = r.choice(["Yes.", "No", "é?", " ", "", None, "a.b \n", "x" * 50, "Well!\t", "line\nbreak.", f"n {r.random()}."])
            out.append((c, r.choice([k, k, k, None, k + 3, -k]), role, text))
    out += [(1, 2, "user", "again.")] * 3 + [(777, None, None, None), (778, 5, "user", "y" * 200_000 + ".")]
    r.shuffle(out)
    return out


TALK = "conv_id long, turn long, role string, text string, blank string, h long"


@pytest.mark.parametrize("most", [200_000, 2])
def test_conversations(spark, most):
    """Whole conversations and, with most = 2, those that are sorted by all tasks together."""
    convs = talks()
    df = spark.createDataFrame([(*r, "clash", 1) for r in convs], TALK).repartition(4)
    want, lines = plain_conversations(convs)
    assert rows(conversations.repair(conversations.damage(df), most_turns=most)) == want
    got = defaultdict(list)
    for r in conversations.repaired_turns(conversations.damage(df), most_turns=most).orderBy("conv_id", "position").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(got) == {c: x for c, x in lines.items() if x}


def test_conversations_by_size_of_text(spark):
    convs = talks(9)
    df = spark.createDataFrame([(*r, "clash", 1) for r in convs], TALK)
    assert rows(conversations.repair(conversations.damage(df), most_bytes=100)) == plain_conversations(convs)[0]


def test_a_long_conversation(spark):
    """Many copies of one turn and many turns with one text."""
    convs = [(1, k % 7, "user", "same.") for k in range(3000)] + [(1, k, "assistant", "other?") for k in range(3000)] + [(2, 0, "user", "x.")]
    df = spark.createDataFrame(convs, "conv_id long, turn long, role string, text string")
    assert rows(conversations.repair(conversations.damage(df), most_turns=100)) == plain_conversations(convs)[0]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TALK)
    assert conversations.op13(empty).count() == 0 and conversations.repaired_turns(conversations.damage(empty)).count() == 0
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = conversations.op13(spark.createDataFrame([(lost, 0, "user", "hi.", "c", 1)], TALK)).collect()
    assert [tuple(r) for r in one] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
