"""A cross-section of the catalogue against its reference SQL (tests/oracle.py runs all of it)."""
import pytest

import __spark_entry__ as entry
from conftest import SF
from oracle import compare, duck

NAMES = """a3_nested_map_rows a4_metric_tiles a10_written_files a11_changed_files a13_feature_contract c7_feature_report g5_english_phrases g6_english_rank i11_vector_best_match j12_evidence_statements j14_structured_explanations k3_change_summaries a5_embedded_json_items a7_upsert b4_parse_currency b6_iso_dates b7_safe_dates b20_type_sanitizing c3_column_profile c6_quality_tags
d6_primary_key d8_orphans d17_chronology d21_completeness e2_last_non_null_progress e5_high_risk_projects e6_missing_information e7_sector_financial_summary e9_state_efficiency
e12_constraint_rejects f7_kpis f13_overview_filtered f15_states_by_cost_anomaly f17_delay_histogram f19_cost_deviation_histogram f21_monthly_trend g3_page g5_document_search
g7_trigram_search h14_feature_pipeline i5_leave_one_out_stats i6_cost_scores i14_delay_evaluation i18_mismatch_scores i22_agency_scores i26_delay_v1 i30_aggregate_renormalize i33_stored_scores
j3_cautious_reasons j4_risk_summary j10_project_explanations k2_field_changes k6_snapshot_chain k13_transactions l1_stream_snapshots l4_stream_progress""".split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_listed_once():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180 and sum(n not in o and not n.startswith("op") and n != "pipeline" for n in q) <= 3


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in NAMES and not n.startswith("op") and n != "pipeline"])
def test_every_other_query_can_be_planned(spark, name):
    """A query that no longer fits the operators it calls fails here."""
    assert entry.queries()[name](spark, SF).columns


def test_comparison_notices_differences(spark, con):
    df = spark.sql("select 1L as a, 'x' as b")
    assert compare(df, con, "select 1 as a, 'y' as b") is not None
    assert compare(df, con, "select 1 as a, 'x' as b union all select 1, 'x'") is not None
    assert compare(df, con, "select 1 as a, 'x' as b") is None
