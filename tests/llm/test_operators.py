import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
from civicledger.llm import bpe, exact_dedup, fingerprints, line_dedup, near_dedup, packing, pii, quality, sharding, suffixes

ROWS = brute.corpus()
PLAIN = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_path())


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_empty_tables_give_no_rows(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (line_dedup.op1(none), exact_dedup.op2(none), pii.op3(none), near_dedup.op4(none), quality.op5(none, labels), packing.op6(none),
               bpe.op7(none), fingerprints.compare_with_next(none), suffixes.op9(none), sharding.shard_documents(none)):
        assert df.count() == 0 and "doc_id" in df.columns


def test_line_dedup(docs):
    assert rows(line_dedup.op1(docs)) == Counter(brute.lines(PLAIN))


def test_line_dedup_counts_documents(spark):
    """A line in five rows of three documents stays; in five documents it goes, also where ids repeat or lack."""
    three, five = "x" * 40, "y" * 40
    plain = [(1, three), (1, three), (1, three + "\n"), (2, three), (3, three)] + [(i, f"{five}\n{i}") for i in (1, 1, 2, 3, 4, 5, None, None)]
    d = spark.createDataFrame(plain, "doc_id long, text string")
    assert rows(line_dedup.op1(d)) == Counter(brute.lines(plain))
    assert {r["n_dropped"] for r in line_dedup.op1(d.filter(f"text like '{three}%'")).collect()} == {0}


def test_line_dedup_hot_and_other_lines(spark, monkeypatch):
    """Some lines broadcast, others joined by key: the same result as without either kind."""
    r = random.Random(8)
    shared = [c * 45 for c in "abcdefgh"]
    plain = [(i, "\n".join([shared[0], *r.sample(shared[1:], 2), str(i)])) for i in range(60)]
    d = spark.createDataFrame(plain, "doc_id long, text string")
    for share in (1, 4, 1000):
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        assert rows(line_dedup.op1(d)) == Counter(brute.lines(plain))


def test_stages_keep_columns_named_like_inner_ones(spark):
    names = ["__text", "__th", "__id", "__h", "__lines", "__kept", "__dropped", "__expected", "__tail", "row", "w", "c1"]
    d = spark.createDataFrame([(i, "z" * 50, *range(len(names))) for i in range(6)], ["doc_id", "text", *names])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (line_dedup.without_repeated_lines(d), quality.select_good(d, labels)):
        assert got.columns == d.columns and got.count() == 6
        assert {tuple(r)[2:] for r in got.collect()} == {tuple(range(len(names)))}


def test_lines_leave_other_columns_alone(docs):
    got = line_dedup.without_repeated_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) and r["node"] == "n" for r in got.filter("text is not null").collect())
    assert got.filter("text is null").count() == 2


@pytest.mark.parametrize("capacity", [3, 20_000])
def test_exact_dedup_with_splitting_buckets(docs, capacity):
    groups = defaultdict(list)
    for i, t in PLAIN:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, brute.sha(t)) for i in ids)
    assert rows(exact_dedup.exact_dedup(docs, capacity)) == want


def test_directory_doubles_where_a_bucket_is_overfull(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as key")
    buckets = exact_dedup.build_directory(keys, 300)
    assert sum(n for *_, n in buckets) == 5000 and max(n for *_, n in buckets) <= 300 and len(buckets) < 64
    assert sum(2 ** -d for _, d, _ in buckets) == 1         # the buckets tile the key space


def test_colliding_keys_are_chained_by_bytes():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([5, 5, 5, 6]), pa.array(["a", "b", "a", "a"]), pa.array([1, 2, None, 3]), pa.array([1, 1, 2, 1])], ["key", "text", "last_id", "n"])
    got = [tuple(x.values()) for b in exact_dedup.chain_entries([batch]) for x in b.to_pylist()]
    assert [g[:4] for g in got] == [(5, 0, 1, 3), (5, 1, 2, 1), (6, 0, 3, 1)]


def test_base_spans_are_the_regular_expressions():
    r = random.Random(3)
    parts = ["4111111111111111", "4012 8888 8888 1881", "1.2.3.4", "256.1.1.1", "x@y.z", "@b.c", " ", "-", ".", "a", "+1 (234) 555-1234", "9", "\n", "é", "["]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == brute.personal(t)


def test_spans_of_long_runs_are_linear():
    for t in ("1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1(" * 100_000, "1 " * 150_000):
        pii.further_spans(t, pii.base_spans(t))


def test_pii_query(docs):
    want = Counter()
    for i, t in PLAIN:
        base = brute.personal(t)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        want[(i, *(sum(k == kind for k, *_ in base) for kind in pii.KINDS), brute.sha(line), line)] += 1
    assert rows(pii.op3(docs)) == want


def test_votes_teach_the_classifier():
    """Numbers with a valid check digit next to cards are accepted, others are not."""
    good = [pii.signature("x 4111111111111111 4012888888881881 y", 2, 2, 18, b) for b in (True, False)]
    poor = pii.signature("x 9111111111111112 y", 2, 2, 18, False)
    p = pii.train(np.array([*good, poor]), np.array([60, 3, 40]))
    assert p[good[0]] > 0.9 and p[good[1]] > 0.9 and p[poor] < 0.5


def test_redaction(docs):
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[9]["text"] == "mail <EMAIL> ip <IP> card <CARD> tel <PHONE>" and got[9]["n_chars"] == len(got[9]["text"])
    assert got[900]["text"] is None and got[4]["text"] == "word" and pii.redact(docs).columns == docs.columns


def test_near_dedup(docs):
    want = Counter((i, n, None if c == -1 else c, i == (None if c == -1 else c)) for i, n, c in brute.near(PLAIN))
    assert rows(near_dedup.op4(docs)) == want
    kept = near_dedup.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.count() == sum(n for r, n in want.items() if r[3])


def test_near_pairs_within_the_guarantee_share_a_key(spark):
    """Signatures that differ in up to GUARANTEED values meet, and first_key names the bucket they meet in."""
    from pyspark.sql import functions as F
    r = np.random.default_rng(5)
    data = []
    for node in range(0, 400, 2):
        a = r.integers(0, 256, near_dedup.VALUES, np.uint8)
        b = a.copy()
        at = r.choice(near_dedup.VALUES, near_dedup.GUARANTEED, replace=False)
        b[at] ^= r.integers(1, 256, len(at), np.uint8)
        data += [(node, a.view(np.int64).tolist()), (node + 1, b.view(np.int64).tolist())]
    sigs = spark.createDataFrame(data, "node long, sig array<long>")
    keys = near_dedup.index_keys(sigs)
    x, y = keys.selectExpr("node as x", "key"), keys.selectExpr("node as y", "key")
    met = x.join(y, "key").filter("y = x + 1 and x % 2 = 0")
    met = met.join(sigs.selectExpr("node as x", "sig as sx"), "x").join(sigs.selectExpr("node as y", "sig as sy"), "y")
    got = met.groupBy("x").agg(F.count_if(near_dedup.first_key("sx", "sy") == F.col("key").bitwiseAND(F.lit(127))).alias("n"), F.max(near_dedup.distance("sx", "sy")).alias("d")).collect()
    assert len(got) == 200 and all(g["n"] == 1 and g["d"] == near_dedup.GUARANTEED for g in got)


def test_chain_of_links_is_one_component(spark):
    """Only neighbours are similar; a bucket's smallest member does not reach the far end."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    data = [(k, " ".join(words[4 * k:4 * k + 100])) for k in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_groups(df).collect()) == [(i, c) for i, _, c in sorted(brute.near(data))]


def test_stage_links_pairs_between_80_and_85(spark):
    """The stage drops copies at 0.80 to below 0.85, which op4 keeps; its index is made for its own threshold."""
    import corpus_pipeline
    r = random.Random(11)
    data = []
    for k in range(40):
        base = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(104)]
        near = list(base)
        near[30] = near[60] = "changed"             # 10 of 100 shingles: 90 / 110
        far = list(base)
        far[20] = far[50] = far[80] = "moved"       # 85 / 115, below either threshold
        data += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = {i for i, _, c in brute.near(data, 80) if i == c}
    assert len(want) == 80 and {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == want
    assert near_dedup.op4(df).filter("kept").count() == 120
    for percent in (80, 85, 90):
        p, k = percent / 100 + (1 - percent / 100) / 256, near_dedup.per_chunk(percent)
        assert (1 - p ** k - k * p ** (k - 1) * (1 - p)) ** near_dedup.CHUNKS < 3e-6


def test_stage_on_documents_links_at_80(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {i for i, _, c in brute.near(data, 80) if i == c}
    assert want < {i for i, _, c in brute.near(data, 85) if i == c}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(d, labels.filter("doc_id % 3 <> 0"))
    assert (np.diff(model.theta) > 0).all()
    got = quality.score(d, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r["__tail"] >= 0.5 for r in got if r["quality"] and not r["toxic"]]
    bad = [r["__tail"] < 0.5 for r in got if not r["quality"] or r["toxic"]]
    assert np.mean(clean) > 0.97 and np.mean(bad) > 0.7
    low, high = np.mean([r["__expected"] for r in got if r["toxic"]]), np.mean([r["__expected"] for r in got if r["quality"] and not r["toxic"]])
    assert low < 1 < high


def test_classifier_gradient():
    """The fit separates grades that a single feature tells apart."""
    y, flat = np.array([0, 1, 2] * 40), np.array([0, 1, 2] * 40)
    w, theta = quality._cumulative_link(y, np.ones(120, int), flat, 3, 300, 1e-4)
    assert w[0] < theta[0] < w[1] < theta[1] < w[2]


def test_classifier_handles_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(0, None, None), (None, 1, 0), (12, 1, 0), (13, 0, 1), (13, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.op5(docs, labels).count() == docs.count()
    assert quality.select_good(docs, labels.filter("false")).count() == docs.count()


def test_classifier_takes_the_lowest_grade_of_equal_texts(spark):
    """Equal texts with different grades: the same model however the rows lie."""
    plain = [(i, f"word{i % 7} thing{i % 3} end") for i in range(84)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 5 == 0)) for i in range(84)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(plain, "doc_id long, text string")
    got = [sorted(map(tuple, quality.op5(d.repartition(n), labels).collect())) for n in (3, 7)]
    assert got[0] == got[1]


def test_encoding_is_the_librarys(docs, tokenizer):
    want = Counter()
    for i, t in PLAIN:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))] += 1
    assert rows(bpe.op7(docs)) == want
    assert rows(bpe.decode(bpe.encode(docs))) == Counter((i, t or "") for i, t in PLAIN)


def test_encoding_of_random_characters(tokenizer):
    r = random.Random(4)
    v = bpe.vocabulary(bpe.default_path())
    odd = "a b'é́s\n\t tr e v l1 9!?.\xa0　日😀<|>m d\x1c\x85"
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["a<|endoftext|> b<|endoftext|>", "'s's''s 'll'LL", "x" * 3000, "ab" * 1500]
    texts += ["".join(chr(r.choice([r.randint(0, 0x2fff), r.randint(0x20, 0x7f), r.randint(0xe000, 0x1ffff)])) for _ in range(30)) for _ in range(500)]
    coded = [t.encode() for t in texts]
    ids, at = v.encode(np.frombuffer(b"".join(coded), np.uint8), np.append(0, np.cumsum([len(c) for c in coded])))
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, tokenizer):
    got = [r.asDict() for r in packing.pack(docs, group_tokens=6000).collect()]
    text = {}
    for i, t in PLAIN:
        text.setdefault(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    tokens = Counter()
    for p in got:
        ids = text[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert zlib.crc32(ids.tobytes()) == p["ids_crc32"] and ids.tolist() == p["ids"] and p["doc_tokens"] == len(text[p["doc_id"]])
        tokens[p["doc_id"]] += p["length"]
    repeats = Counter(i for i, _ in PLAIN)
    assert tokens == Counter({i: len(text[i]) * n for i, n in repeats.items()})
    by = defaultdict(list)
    for p in got:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024


def test_plan_balances_cost_and_wastes_little():
    r = np.random.default_rng(1)
    lens = r.integers(1, 3000, 2000)
    doc, start, length, seq, offset, n = packing.plan(lens, 1024, 1.0, 1 / 1024)
    assert n == int((lens // 1024).sum()) + -(-int((lens % 1024).sum()) // 1024)
    assert (np.bincount(doc, length) == lens).all() and np.bincount(seq, length).max() <= 1024
    cost = np.bincount(seq, length + length ** 2 / 1024)[int((lens // 1024).sum()):]
    assert cost.std() / cost.mean() < 0.2


@pytest.mark.parametrize("low, high", [(1, 40), (1, 64), (20, 64), (50, 60), (1, 200)])
def test_plan_is_the_plain_greedy_rule(low, high):
    """Every remainder lies in the cheapest sequence with room; it is cut only where none has room."""
    r = np.random.default_rng(low + high)
    lens = r.integers(low, high, 700)
    doc, start, length, seq, offset, n = packing.plan(lens, 64, 1.0, 1 / 64)
    got, base = defaultdict(int), int((lens // 64).sum())
    for row in zip(doc.tolist(), start.tolist(), length.tolist(), seq.tolist(), offset.tolist()):
        got[row] += 1
    rest = lens % 64
    cost, used = [0.0] * (n - base), [0] * (n - base)
    for d in sorted(np.flatnonzero(rest).tolist(), key=lambda k: -rest[k]):
        at, size = int(lens[d] - rest[d]), int(rest[d])
        while size:
            fits = [k for k in range(n - base) if 64 - used[k] >= size] or [k for k in range(n - base) if used[k] < 64]
            k = min(fits, key=lambda k: (cost[k], k))
            take = min(size, 64 - used[k])
            assert got.pop((d, at, take, base + k, used[k])) == 1
            cost[k] += take + take * take / 64
            used[k] += take
            at, size = at + take, size - take
    assert all(row[2] == 64 and row[3] < base for row in got)


def test_fingerprints(docs):
    order = sorted(PLAIN, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = rows(fingerprints.compare_with_next(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint"))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t = t or ""
        half = len(t) // 2
        want[(i, len(t), brute.sha(t[:len(t) - half] + (n or "")[:half]), fingerprints.written(fingerprints.chunk_records([t.encode()])[0]))] += 1
    assert got == want


def test_fingerprints_over_many_parts(docs, monkeypatch):
    whole = rows(fingerprints.compare_with_next(docs))
    monkeypatch.setattr(fingerprints, "PART_BYTES", 3000)
    assert rows(fingerprints.compare_with_next(docs)) == whole


def test_chunks_settle_after_an_insertion():
    r = random.Random(2)
    a = bytes(r.randrange(97, 123) for _ in range(20_000))
    x, y = fingerprints.chunk_records([a, a[:9000] + b"inserted" + a[9000:]])
    assert fingerprints.containment(x, y) > 0.97 and fingerprints.containment(x, x) == 1
    assert fingerprints.containment(x, fingerprints.chunk_records([bytes(reversed(a))])[0]) < 0.05


@pytest.mark.parametrize("task_bytes", [None, 4000])
def test_suffix_dedup(docs, monkeypatch, task_bytes):
    if task_bytes:                  # many groups, sorters and buckets
        monkeypatch.setattr(suffixes, "ANCHOR_BYTES", task_bytes)
        monkeypatch.setattr(suffixes, "SORT_BYTES", task_bytes)
    assert rows(suffixes.op9(docs)) == Counter(brute.repeats(PLAIN))


def test_radix_groups_are_the_repeated_windows():
    r = np.random.default_rng(3)
    text = r.integers(97, 99, 3000, np.uint8)
    text[1000:1200] = text[200:400]
    start = np.arange(len(text) - 49)
    ids = start // 500
    got = suffixes.radix_groups(text, start, ids, ids)
    first = {}
    held = defaultdict(set)
    for p in start:
        held[text[p:p + 50].tobytes()].add(int(ids[p]))
    for p in start:
        h = held[text[p:p + 50].tobytes()]
        assert got[p] == (min(h) if len(h) > 1 else np.iinfo(np.int64).max)


def test_sharding(docs):
    got = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(ROWS)
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert sizes == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in PLAIN)


def test_a_new_shard_only_takes(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    got = sharding.shard_documents(df).collect()
    moved = [r for r in got if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 8 for r in moved) and abs(len(moved) - 20_000 / 9) < 300
    assert max(Counter(r["shard"] for r in got).values()) < 2800


def test_weights_move_documents_only_into_the_heavier_subtree(spark):
    tree = lambda w: sharding.Node("root", (sharding.Node("a", (sharding.Node("a0", (), 0, 1.0), sharding.Node("a1", (), 1, w))), sharding.Node("b", (sharding.Node("b0", (), 2, 1.0),))))
    df = spark.range(9000).selectExpr("id as doc_id", "'x' as text")
    got = sharding.place(df, tree(1.0), tree(3.0)).collect()
    assert all(r["grown_shard"] in (0, 1) for r in got if r["shard"] != r["grown_shard"])
    share = Counter(r["grown_shard"] for r in got)
    assert abs(share[1] / 9000 - 0.6) < 0.03
