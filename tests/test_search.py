"""Stored postings against plain scans of the texts."""
import random
import re

import pytest
from pyspark.sql import functions as F

from civicledger import fixed_values as fv
from civicledger.operators import analyzers as A, postings as P, search as S

STEMS = {"consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consistency": "consist", "consistently": "consist", "consolation": "consol",
         "knightly": "knight", "knots": "knot", "kneeled": "kneel", "knives": "knive", "generally": "general", "generous": "generous", "communities": "communiti", "hopping": "hop", "hoping": "hope",
         "agreed": "agre", "skies": "sky", "dying": "die", "news": "news", "proceed": "proceed", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "ties": "tie",
         "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "boyish": "boyish", "sayings": "say", "yearly": "year", "happy": "happi", "by": "by", "say": "say", "controlling": "control",
         "hopefulness": "hope", "electricity": "electr", "formative": "format", "adoption": "adopt", "controll": "control", "bed": "bed", "bing": "bing", "disbursements": "disburs", "y": "y"}

TEXTS = ["the works of the state", "work of state", "states, works!", "WORKING states of work", "roads and roads and bridges", "roads bridges", "", "the of and", None, "bridge over the road", "x y x y z", "x x y z y x"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    more = [" ".join(r.choice(["road", "roads", "the", "of", "bridge", "work", "works", "state", "x", "y"]) for _ in range(r.randint(1, 30))) for _ in range(200)]
    return spark.createDataFrame(list(enumerate(TEXTS + more)), "id long, body string")


@pytest.fixture(scope="module", params=["light", "english"])
def index(spark, docs, request, tmp_path_factory):
    """Built in two steps, the second one adding documents."""
    path = str(tmp_path_factory.mktemp("words"))
    i = P.build_words(docs.filter("id < 150"), "id", F.col("body"), path, request.param, 16)
    return P.add_words(i, docs.filter("id >= 150"), "id", F.col("body"))


def plain_words(text, kind):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    if kind == "light":
        return dict(enumerate(S._stem(w) for w in words if w not in fv.STOP_WORDS))
    return {p: A.stem(w) for p, w in enumerate(words) if w not in fv.ENGLISH_STOP_WORDS}


def plain_match(text, kind, q):
    held = plain_words(text, kind)
    alternatives, own = [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', q):
        if not minus and word.lower() == "or":
            alternatives, own = [*alternatives, own], []
            continue
        asked = plain_words(phrase or word, kind)
        if asked:
            first = min(asked)
            own.append(bool(minus) != any(all(held.get(p + d - first) == w for d, w in asked.items()) for p in held))
    return any(all(alt) for alt in [*alternatives, own] if alt)


def test_published_stems(spark):
    assert {w: A.stem(w) for w in STEMS} == STEMS
    got = spark.createDataFrame([(w,) for w in STEMS] * 2, "w string").select("w", A.stems("w").alias("s")).distinct().collect()
    assert {r["w"]: r["s"] for r in got} == STEMS


@pytest.mark.parametrize("q", ["road", "roads bridge", '"works of the state"', '"work state"', '"roads and roads"', '"x y x"', "road -bridge", "-road", '-road -"x y"', "road or x", "-x OR bridge",
                               "the", '"the of"', "", "missing", '"x x" -"y x"', "the -road", "road OR or x"])
def test_match_equals_a_scan(spark, docs, index, q):
    got = {r["key"] for r in P.match(spark, index, q).collect()}
    assert got == {r["id"] for r in docs.collect() if plain_match(r["body"], index.kind, q)}


def test_rank_equals_a_scan(spark, docs, index):
    got = {r["key"]: r["relevance"] for r in P.rank(spark, index, 'roads "x y" -state').collect()}
    if index.kind == "light":
        want = {r["id"]: r["relevance"] for r in S.search_rank(docs, "id", F.col("body"), 'roads "x y" -state').collect()}
        assert got == want
    assert len(got) > 50


def test_only_the_buckets_of_the_query_are_read(spark, index):
    p = P.match(spark, index, "road bridge")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in p and "In(term" in p and "CartesianProduct" not in p and "Python" not in p
    files = spark.read.parquet(index.path + "/postings").select("bucket").distinct().count()
    read = {r["bucket"] for r in P.read_postings(spark, index, ["road", "bridg"]).select("bucket").distinct().collect()}
    assert len(read) <= 2 < files


NAMES = ["small widget", "smal wigdet", "Small  Widgets", "large widget", "gadget", "", None, "ab", "a", "wi dg et", "naïve Ünïcode", "𐐨𐐩𐐪 deseret", "target", "getget", "small-widget!"]


@pytest.mark.parametrize("q,threshold", [("smal wigdet", 0.3), ("small widget", 0.99), ("get", 0.5), ("et", 0.2), ("", 0.3), ("ünïcode", 0.0), ("𐐨𐐩", 0.1), ("widget!", 0.3), ("l w", 0.4)])
def test_fuzzy_search_equals_a_scan(spark, tmp_path, q, threshold):
    r = random.Random(2)
    df = spark.createDataFrame(list(enumerate(NAMES + ["".join(r.choice("smalwidget ") for _ in range(r.randint(1, 20))) for _ in range(300)])), "id long, name string")
    index = P.build_trigrams(df, "id", F.col("name"), str(tmp_path), 8)
    rows = lambda d: {tuple(x) for x in d.collect()}
    assert rows(P.fuzzy_search(index, df, "id", "name", q, threshold)) == rows(S.fuzzy_search(df, "name", q, threshold))


def plain_grams(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return {f"  {w} "[i:i + 3] for w in words for i in range(len(w) + 1)}


def test_trigrams(spark):
    df = spark.createDataFrame([(n,) for n in NAMES if n is not None], "n string").select("n", S.trigrams(F.col("n")).alias("g"))
    assert all(sorted(r["g"]) == sorted(plain_grams(r["n"])) for r in df.collect())


def test_fuzzy_search_reads_postings_of_its_grams(spark, tmp_path):
    df = spark.createDataFrame([(k, f"name {k}") for k in range(50)], "id long, name string")
    index = P.build_trigrams(df, "id", F.col("name"), str(tmp_path), 8)
    p = P.similar(spark, index, "name 7", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in p and "GreaterThanOrEqual(size,3)" in p and "LessThanOr" in p
