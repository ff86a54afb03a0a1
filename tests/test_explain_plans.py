"""Explanation queries: one join of money per project, no aggregate of its five rows, no text method too large for the JVM."""
from civicledger.operators import explain as J
from civicledger.plans import catalog, q_explain as Q  # noqa: F401  (the catalogue loads the queries in order)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_money_joins_projects_before_their_five_rows(tables):
    p = plan(Q.engine_rows(tables))
    assert p.index("Generate explode") < p.index("Join [project_id")       # the plan is printed from its end
    assert "c_custkey" not in p and "s_suppkey" not in p


def test_overall_needs_no_aggregate(tables):
    p = plan(Q.overall(tables))
    assert "Aggregate" not in p and "Exchange" not in p
    want = {r[0]: round(r[1], 2) for r in tables["risk_factors"].selectExpr("project_id", "round(score * 0.2, 2) as c").groupBy("project_id").sum("c").collect()}
    assert {r["project_id"]: r["overall_risk_score"] for r in Q.overall(tables).collect()} == want


def test_texts_stay_out_of_the_whole_stage(spark):
    """A starred plan node is part of a whole stage, which makes one method of it."""
    rows = spark.range(10).selectExpr("id as project_id", "if(id % 2 = 0, 'delay_detection', 'cost_anomaly') as engine", "50.0D as score", "10.0D as contribution", "'{}' as details")
    for df in (J.evidence_rows(rows), J.cautious_reason(rows)):
        assert plan(df).startswith("Project ")
