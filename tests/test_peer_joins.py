"""Peer statistics must not gather a group: only the join by group and value may shuffle."""
from civicledger.operators import engines as R


def test_joins_by_group_do_not_shuffle(spark, tables):
    key = "spark.sql.autoBroadcastJoinThreshold"
    signals = R.staged(R.cost_signals(tables["projects"], tables["financials"]), "signals")
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        plan = R.cost_peers(signals)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") >= 2
