"""One large JSON array read in byte ranges, against the whole-file parser."""
import json
import random

import pytest

from civicledger.sources import readers as R

SCHEMA = "id bigint, s string, o struct<x: array<struct<y: string>>>"


def records(n: int) -> list[dict]:
    g, bits = random.Random(4), ['}', '{', ']', '[', '"', '\\', ',', 'é', '€', '\n', 'word', '},{"id":1', '\\"}', ' ']
    text = lambda: "".join(g.choice(bits) for _ in range(g.randint(0, 40)))
    rows = [{"id": i, "s": text(), "o": {"x": [{"y": text()} for _ in range(g.randint(0, 3))]}} for i in range(n)]
    rows[n // 2]["s"] = "}{" * 3000              # a record over several ranges
    return rows


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_equal_the_whole(spark, tmp_path, indent):
    rows = records(300)
    (tmp_path / "a.json").write_text(json.dumps(rows[:200], indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(" " + json.dumps(rows[200:], indent=indent) + "\n", encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {r.id: r.asDict(recursive=True) for r in R.read_json_array(spark, str(tmp_path), SCHEMA).collect()}
        want = {r.id: r.asDict(recursive=True) for r in spark.read.option("multiLine", True).schema(SCHEMA).json(str(tmp_path)).collect() if r.id is not None}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want == {r["id"]: r for r in rows}


def test_open_array_is_an_error_and_other_elements_are_skipped(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text('[{"id": 1, "s": "b"}, {"id": 2, "s": "c')
    with pytest.raises(ValueError, match="not closed"):
        R.read_json_array(spark, str(tmp_path / "x"), SCHEMA)
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.json").write_text('[null, {"id": 1}, 7, {"id": "no"}, {"id": 3, "s": null}]')
    got = [(r.id, r.s) for r in R.read_json_array(spark, str(tmp_path / "y"), SCHEMA).collect()]
    assert sorted(got, key=str) == [(1, None), (3, None), (None, None)]
