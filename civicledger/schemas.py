"""Table declarations: column types, keys, required and updatable columns, and row checks."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F, types as T

from civicledger import fixed_values as fv


class TableSpec(NamedTuple):
    file: str
    ddl: str
    pk: tuple[str, ...]
    required: tuple[str, ...] = ()
    generated: tuple[str, ...] = ()
    checks: dict[str, Column] = {}

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def updates(self) -> list[str]:
        """Columns an upsert may change: everything but keys and generated columns."""
        return [f.name for f in self.schema.fields if f.name not in (*self.pk, *self.generated)]


def _c(expr: str) -> Column:
    return F.expr(expr)


def _in(col: str, allowed: list[str]) -> Column:
    return F.col(col).isin(allowed)


def build_tables() -> dict[str, TableSpec]:
    pct = lambda c: _c(f"{c} between 0 and 100")
    nonneg = lambda *cs: {f"{c}_non_negative": _c(f"{c} >= 0") for c in cs}
    return {
        "states": TableSpec(
            "clean_esakshi_states.csv", "state_id int, state_name string, category string, canonical_state_key string",
            ("state_id",), ("state_id", "state_name", "category", "canonical_state_key"),
            checks={"category": _in("category", ["State", "Union Territory"])}),
        "constituencies": TableSpec(
            "clean_esakshi_constituencies.csv",
            "constituency_id int, state_id int, state_name string, constituency_name string, raw_caption string, "
            "reservation_category string, canonical_state_key string", ("constituency_id",),
            ("constituency_id", "state_id", "constituency_name", "reservation_category"),
            checks={"reservation": _in("reservation_category", ["General", "SC", "ST"])}),
        "national_summary": TableSpec(
            "clean_esakshi_national_summary.csv",
            "metric_key string, metric_description string, count_works double, amount_inr decimal(16,2), amount_crores decimal(12,2)",
            ("metric_key",), ("metric_key", "amount_inr"), checks=nonneg("amount_inr", "amount_crores")),
        "calamity_relief": TableSpec(
            "clean_esakshi_calamity_relief.csv",
            "s_no int, honorific string, mp_name string, house_of_parliament string, tenure string, calamity_name string, "
            "calamity_type string, consented_amount_inr decimal(14,2), consented_amount_lakhs decimal(10,2), "
            "consent_date_iso date, tenure_start_date_iso date, tenure_end_date_iso date", ("s_no",),
            ("s_no", "mp_name", "consented_amount_inr"),
            checks={"house": _in("house_of_parliament", fv.HOUSES), "cap": _c("consented_amount_lakhs between 0 and 100")}),
        "union_budget": TableSpec(
            "clean_union_budget_mplads_1993_2025.csv",
            "financial_year string, start_year int, end_year int, scheme_entitlement_per_mp_cr decimal(6,2), "
            "budget_estimate_cr decimal(10,2), revised_estimate_cr decimal(10,2), actual_expenditure_cr decimal(10,2), "
            "be_vs_actual_variance_cr decimal(10,2), major_head int, status_notes string", ("financial_year",),
            ("financial_year", "start_year", "budget_estimate_cr"),
            checks={"fy": _c(r"financial_year rlike '^\\d{4}-\\d{2}$'"), "start": _c("start_year >= 1993"),
                    "order": _c("end_year > start_year"), **nonneg("budget_estimate_cr")}),
        "parliament_qa_state_expenditure": TableSpec(
            "clean_parliament_qa_state_expenditure.csv",
            "state_id int, state_name string, canonical_state_key string, entitlement_cr decimal(12,2), released_cr decimal(12,2), "
            "expenditure_cr decimal(12,2), unspent_balance_cr decimal(12,2), utilization_rate_pct decimal(6,2), works_recommended int, "
            "works_sanctioned int, works_completed int, sanction_rate_pct decimal(6,2), completion_rate_pct decimal(6,2), "
            "is_utilization_valid boolean, is_workflow_valid boolean", ("state_id",), ("state_id", "released_cr", "expenditure_cr"),
            checks={**nonneg("released_cr", "expenditure_cr", "unspent_balance_cr"),
                    **{c: pct(c) for c in ("utilization_rate_pct", "sanction_rate_pct", "completion_rate_pct")},
                    "workflow": _c("works_completed <= works_sanctioned and works_sanctioned <= works_recommended")}),
        "master_dim_states_constituencies": TableSpec(
            "clean_master_dim_states_constituencies.csv",
            "state_id int, state_name string, canonical_state_key string, category string, total_lok_sabha_seats int, general_seats int, "
            "sc_reserved_seats int, st_reserved_seats int, sc_seat_share_pct decimal(6,2), st_seat_share_pct decimal(6,2), "
            "statutory_sc_allocation_pct decimal(5,2), statutory_st_allocation_pct decimal(5,2), cumulative_released_cr decimal(12,2), "
            "cumulative_expenditure_cr decimal(12,2), unspent_balance_cr decimal(12,2), utilization_pct decimal(6,2), works_completed_count int",
            ("state_id",), ("state_id", "total_lok_sabha_seats"),
            checks={"seat_sum": _c("general_seats + sc_reserved_seats + st_reserved_seats = total_lok_sabha_seats")}),
        "projects": TableSpec(
            "clean_projects.csv",
            "project_id string, project_code string, project_title string, project_description string, sector string, sub_sector string, "
            "state_id int, constituency_id int, district_name string, block_name string, implementing_agency string, mp_name string, "
            "house_of_parliament string, financial_year string, current_status string, recommendation_date date, sanction_date date, "
            "work_order_date date, expected_completion_date date, actual_completion_date date", ("project_id",),
            ("project_id", "project_code", "project_title", "sector", "state_id", "constituency_id", "district_name",
             "implementing_agency", "mp_name", "house_of_parliament", "financial_year", "current_status", "recommendation_date"),
            checks={"house": _in("house_of_parliament", fv.HOUSES), "status": _in("current_status", fv.PROJECT_STATUSES),
                    "financial_year": _c(r"financial_year rlike '^\\d{4}-\\d{2}$'"),
                    "chk_proj_sanction_date": _c("sanction_date >= recommendation_date"),
                    "chk_proj_work_order_date": _c("work_order_date >= sanction_date"),
                    "chk_proj_completion_date": _c("actual_completion_date >= work_order_date")}),
        "financials": TableSpec(
            "clean_financials.csv",
            "project_id string, currency string, recommended_amount decimal(14,2), sanctioned_amount decimal(14,2), released_amount decimal(14,2), "
            "expenditure_amount decimal(14,2), unspent_balance decimal(14,2), utilization_rate_pct decimal(6,2), cost_overrun_amount decimal(14,2), "
            "cost_overrun_pct decimal(6,2), last_disbursement_date date", ("project_id",),
            ("project_id", "recommended_amount", "released_amount", "expenditure_amount"), ("unspent_balance",),
            {**nonneg("recommended_amount", "sanctioned_amount", "released_amount", "expenditure_amount", "cost_overrun_amount"),
             "utilization": pct("utilization_rate_pct")}),
        "progress": TableSpec(
            "clean_progress.csv",
            "project_id string, reported_date date, physical_progress_pct decimal(5,2), financial_progress_pct decimal(5,2), current_stage string, "
            "days_delayed int, milestone_status string, inspected_by string, inspection_date date, inspection_remarks string, "
            "geo_latitude decimal(10,7), geo_longitude decimal(10,7), photo_evidence_url string", ("project_id", "reported_date"),
            ("project_id", "reported_date", "physical_progress_pct", "financial_progress_pct", "current_stage", "days_delayed", "milestone_status"),
            checks={"physical": pct("physical_progress_pct"), "financial": pct("financial_progress_pct"),
                    "stage": _in("current_stage", fv.STAGES), "milestone": _in("milestone_status", fv.MILESTONES),
                    **nonneg("days_delayed"), "latitude": _c("geo_latitude between 6 and 38"), "longitude": _c("geo_longitude between 68 and 98")}),
        "project_features": TableSpec(
            "clean_project_features.csv",
            "project_id string, delay_days int, is_delayed boolean, utilization_ratio decimal(6,4), utilization_ratio_released decimal(6,4), "
            "utilization_ratio_sanctioned decimal(6,4), cost_per_category decimal(14,2), cost_relative_to_category decimal(6,4), "
            "cost_category_zscore decimal(6,4), progress_gap decimal(6,2), progress_gap_schedule decimal(6,2), progress_gap_fin_phy decimal(6,2), "
            "cost_deviation decimal(14,2), cost_deviation_sanction decimal(14,2), cost_deviation_sanction_pct decimal(6,2), "
            "cost_deviation_expenditure decimal(14,2), cost_deviation_expenditure_pct decimal(6,2), project_duration int, project_duration_days int, "
            "planned_duration_days int, actual_duration_days int, elapsed_duration_days int, admin_sanction_duration_days int, "
            "sanction_sla_delay_days int, unreleased_allocation decimal(14,2), is_schedule_lagging boolean, is_disbursement_skewed boolean, "
            "has_cost_overrun boolean", ("project_id",), ("project_id", "delay_days", "utilization_ratio", "cost_per_category", "progress_gap",
                                                          "cost_deviation", "project_duration")),
        "risk_scores": TableSpec(
            "clean_risk_scores.csv",
            "risk_score_id bigint, project_id string, overall_risk_score decimal(5,2), delay_risk_score decimal(5,2), cost_overrun_risk_score decimal(5,2), "
            "non_completion_risk_score decimal(5,2), leakage_risk_score decimal(5,2), risk_level string, confidence_score decimal(4,3), "
            "assessment_date date, model_version string", ("project_id",), ("project_id", "overall_risk_score", "risk_level"),
            checks={**{c: pct(c) for c in ("overall_risk_score", "delay_risk_score", "cost_overrun_risk_score", "non_completion_risk_score", "leakage_risk_score")},
                    "tier": _in("risk_level", fv.STORED_TIERS), "confidence": _c("confidence_score between 0 and 1")}),
        "risk_factors": TableSpec(
            "clean_risk_factors.csv",
            "risk_score_id bigint, project_id string, factor_category string, factor_name string, factor_weight decimal(4,3), factor_impact string, "
            "mitigation_recommendation string, is_mitigated boolean", ("risk_score_id", "factor_name"),
            ("risk_score_id", "project_id", "factor_category", "factor_name", "factor_weight", "factor_impact", "mitigation_recommendation"),
            checks={"category": _in("factor_category", fv.FACTOR_CATEGORIES), "weight": _c("factor_weight between 0 and 1")}),
        "project_history": TableSpec(
            "clean_project_history.csv",
            "project_id string, event_type string, previous_status string, new_status string, event_timestamp timestamp, performed_by string, "
            "event_description string, metadata_json string", ("project_id", "event_type", "event_timestamp"),
            ("project_id", "event_type", "new_status", "event_timestamp", "performed_by", "event_description"),
            checks={"event": _in("event_type", fv.HISTORY_EVENTS)}),
        "project_snapshots": TableSpec(
            "project_snapshots.csv",
            "snapshot_id bigint, project_id string, snapshot_datetime timestamp, project_status string, recommended_amount decimal(14,2), "
            "sanctioned_amount decimal(14,2), released_amount decimal(14,2), expenditure_amount decimal(14,2), unspent_balance decimal(14,2), "
            "utilization_rate_pct decimal(6,2), cost_overrun_amount decimal(14,2), physical_progress_pct decimal(5,2), financial_progress_pct decimal(5,2), "
            "expected_completion_date date, actual_completion_date date, days_delayed int, milestone_status string, overall_risk_score decimal(5,2), "
            "risk_level string, change_summary string", ("snapshot_id",), ("snapshot_id", "project_id", "snapshot_datetime"),
            checks={"physical": pct("physical_progress_pct"), "tier": _in("risk_level", [*fv.STORED_TIERS, "Medium"])}),
        "risk_history": TableSpec(
            "risk_history.csv",
            "history_id bigint, project_id string, snapshot_id bigint, overall_risk_score decimal(5,2), risk_level string, delay_risk_score decimal(5,2), "
            "cost_overrun_risk_score decimal(5,2), non_completion_risk_score decimal(5,2), leakage_risk_score decimal(5,2), calculated_at timestamp",
            ("snapshot_id",), ("project_id", "overall_risk_score"), checks={"overall": pct("overall_risk_score")}),
    }


class _Lazy(dict):
    """Built on first use, because column expressions need a running session."""

    def __missing__(self, name):
        self.update(build_tables())
        return self[name]


TABLES: dict[str, TableSpec] = _Lazy()

# Load order: parents before children.
LOAD_ORDER = ["states", "constituencies", "national_summary", "calamity_relief", "union_budget",
              "parliament_qa_state_expenditure", "master_dim_states_constituencies", "projects", "financials",
              "progress", "project_features", "risk_scores", "risk_factors", "project_history"]

# Foreign keys: child, columns, parent.
FOREIGN_KEYS = [("constituencies", ["state_id"], "states"), ("parliament_qa_state_expenditure", ["state_id"], "states"),
                ("master_dim_states_constituencies", ["state_id"], "states"), ("projects", ["state_id"], "states"),
                ("projects", ["constituency_id"], "constituencies"), ("financials", ["project_id"], "projects"),
                ("progress", ["project_id"], "projects"), ("risk_scores", ["project_id"], "projects"),
                ("risk_factors", ["project_id"], "projects"), ("project_history", ["project_id"], "projects")]
