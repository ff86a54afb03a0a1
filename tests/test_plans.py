"""Plan checks: no Python row functions, no Cartesian products, pushed filters and pruned columns."""
import pytest

import __spark_entry__ as entry
from conftest import SF
from civicledger.operators import search

PURE = ["e3_project_overview", "e7_sector_financial_summary", "f2_portfolio_summary", "f17_delay_histogram", "g5_full_text_search", "h3_delay_days", "i14_delay_evaluation",
        "i18_mismatch_scores", "j3_cautious_reasons", "k2_field_changes"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_jvm_only(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "Python" not in p and "InPandas" not in p


def test_point_lookup_pushes_down(spark, tables):
    p = plan(search.by_id(tables, 77).select("project_id", "state_name"))
    assert "EqualTo(o_orderkey,77)" in p and "o_totalprice" not in p


def test_latest_row_is_limited_before_the_shuffle(spark, tables):
    from civicledger.operators.views import latest_progress
    assert "WindowGroupLimit" in plan(latest_progress(tables["progress"]))
