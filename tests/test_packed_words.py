"""Words packed by runs of documents against the analyzers' rows."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from civicledger.operators import analyzers as A, postings as P
from civicledger.plans.q_search import STEM

ODD = ["", None, "  -- ", "the of and", "x²³s x²³es Ⅷabcs abcs ab3s ab3ings", "İSTANBULS ΣΑΣ ΟΔΟΣ straßes ÄPFELS", "𐐨𐐩𐐪s 𐐀𐐁𐐂ed 日本語s naïveings", "\n\ttabs spaces ends ",
       "sings strings needs bees ies edly skedly s es ings", "étés cafés", "the works of the works the", "a\x00bs words"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    more = [" ".join(r.choice(["Works", "the", "working", "of", "states", "Äpfels", "x1s", "3"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate(ODD + more)), "id long, body string").repartition(2)


@pytest.mark.parametrize("kind", ["light", "english"])
@pytest.mark.parametrize("run", [1, 50, 1 << 20])
def test_packed_words_are_the_analyzers_words(docs, kind, run, monkeypatch):
    monkeypatch.setattr(A, "RUN", run)
    packed = A.packed_words(docs, "id", F.col("body"), kind)
    got = [(r["term"], k, p) for r in packed.collect() for k, p in zip(r["keys"], r["at"], strict=True)]
    want = {(r["term"], r["key"], r["pos"]) for r in A.ANALYZERS[kind](docs, "id", F.col("body")).collect()}
    assert len(got) == len(set(got)) and {g for g in got if g[0]} == want
    assert sorted(g[1] for g in got if not g[0]) == list(range(docs.count()))


def test_light_stems_are_those_of_the_sql():
    """Endings after letters beyond the basic plane were left on."""
    words = sorted({w for t in ODD if t for w in t.lower().replace("\x00", " ").split()})
    want = dict(duckdb.connect().execute(f"SELECT w, {STEM} FROM (SELECT unnest(?) AS w)", [words]).fetchall())
    assert {w: A.light_stem(w) for w in words} == want


def test_a_table_of_one_split_is_many_tasks_work(spark, docs):
    one = docs.coalesce(1)
    plan = A.packed_words(one, "id", F.col("body"), "light")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("RepartitionByExpression [key")


@pytest.mark.parametrize("kind", ["light", "english"])
def test_an_index_has_a_row_for_a_term_of_a_run(spark, docs, kind, tmp_path):
    """A row for every place of a word was moved, sorted and written before."""
    index = P.build_words(docs, "id", F.col("body"), str(tmp_path), kind, 8)
    places = A.ANALYZERS[kind](docs, "id", F.col("body"))
    stored = spark.read.parquet(str(tmp_path) + "/postings")
    assert stored.count() <= 2 * (places.select("term").distinct().count() + 1) < places.count() / 10
    assert {r["key"] for r in P.match(spark, index, "-works").collect()} == set(range(docs.count())) - {r["key"] for r in places.filter("term = 'work'").collect()}


@pytest.mark.parametrize("kind", ["light", "english"])
def test_texts_without_a_word(spark, kind, tmp_path):
    """Such an index had no postings to read."""
    index = P.build_words(spark.createDataFrame([(1, None), (2, "--")], "id long, body string"), "id", F.col("body"), str(tmp_path), kind, 4)
    assert {r["key"] for r in P.match(spark, index, "-road").collect()} == {1, 2}
    assert P.match(spark, index, "road").isEmpty() and P.rank(spark, index, "road").isEmpty()


def test_places_are_counted_not_collected(spark, docs, tmp_path):
    """Positions of all words were collected for each document, in aggregates that sort."""
    index = P.build_words(docs, "id", F.col("body"), str(tmp_path), "light", 4)
    for q, hit in (('"works states works" OR 3', lambda w: "3" in w or "work stat work" in " ".join(w)), ('-"works states" OR "3 3"', lambda w: "work stat" not in " ".join(w) or "3 3" in " ".join(w))):
        found = P.match(spark, index, q)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "ObjectHashAggregate" not in plan and plan.count("Scan parquet") <= 2
        words = {r["id"]: [] for r in docs.collect()}
        for r in A.ANALYZERS["light"](docs, "id", F.col("body")).orderBy("pos").collect():
            words[r["key"]].append(r["term"])
        assert sorted(r["key"] for r in found.collect()) == sorted(k for k, w in words.items() if hit(w))
