import pytest

import __spark_entry__ as entry
import corpus_pipeline
from civicledger.llm.queries import ORACLE_SQL, QUERIES
from conftest import SF
from oracle import compare, duck


def test_each_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES and set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name]) is None


def test_pipeline_against_plain_versions(spark):
    """Line, near-dup and PII stages against brute force on each one's own input; packing covers every token."""
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__))))
    import brute
    from civicledger.llm import pii
    from civicledger.llm.common import documents, staged

    docs, seen = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        after = staged(stage(spark, docs, SF), name)
        seen.append(name)
        if name != "packing":
            assert after.columns == docs.columns
            got = {r["doc_id"]: r["text"] for r in after.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.select("text", "n_chars").collect())
        if name == "quality_classifier":
            assert set(got.items()) <= set(before) and len(got) > 0.6 * len(before)
        elif name == "line_dedup":
            assert {i: brute.sha(t) for i, t in got.items()} == {i: s for i, _, _, s in brute.lines(before)}
        elif name == "near_dedup":
            assert set(got) == {i for i, _, c in brute.near(before, 80) if i == c}
        elif name == "pii":
            assert set(got) == {i for i, _ in before} and not any(brute.personal(t) for t in got.values())
            assert all(got[i] == t for i, t in before if not pii.base_spans(t) and not pii.further_spans(t, []))
        docs = after
    rows = docs.selectExpr("sum(length) as n", "count(distinct sequence_id) as s").first()
    assert rows["s"] * 1024 - rows["n"] < 0.1 * rows["n"] + 1024 * 8 and seen == [n for n, _ in corpus_pipeline.STAGES]
