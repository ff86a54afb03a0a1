"""The same bindings as SQL common table expressions, composed into each reference query."""
from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "states": ((), """
        SELECT n_nationkey AS state_id, n_name AS state_name,
               CASE WHEN r_name = 'ASIA' THEN 'Union Territory' ELSE 'State' END AS category,
               lower(n_name) AS canonical_state_key
        FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"""),
    "constituencies": (("states",), """
        SELECT state_id * 100 + seat AS constituency_id, state_id, state_name,
               'Seat ' || state_id || '-' || seat AS constituency_name,
               'SEAT ' || state_id || '-' || seat || CASE seat WHEN 5 THEN ' (SC)' WHEN 6 THEN ' (ST)' ELSE '' END AS raw_caption,
               CASE seat WHEN 5 THEN 'SC' WHEN 6 THEN 'ST' ELSE 'General' END AS reservation_category,
               canonical_state_key
        FROM (SELECT DISTINCT c_nationkey AS state_id, c_custkey % 7 AS seat FROM customer) JOIN states USING (state_id)"""),
    "projects0": ((), """
        SELECT o_orderkey AS project_id, o_custkey AS custkey, o_custkey // 15 AS agency_key,
               substr(o_orderpriority, 3) AS sector, CAST(o_orderdate AS DATE) AS recommendation_date,
               CAST(o_totalprice AS DECIMAL(14,2)) AS price,
               CASE WHEN o_orderstatus = 'F' THEN 'Completed'
                    WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'Work Order Issued' WHEN 1 THEN 'Sanctioned' ELSE 'In Progress' END
                    ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Stalled' WHEN 1 THEN 'Recommended' WHEN 2 THEN 'Cancelled' ELSE 'In Progress' END
               END AS current_status
        FROM orders"""),
    "projects": (("projects0",), """
        SELECT project_id, 'W-' || project_id AS project_code,
               'Construction of ' || lower(c_mktsegment) || ' works for ' || c_name AS project_title,
               CASE WHEN project_id % 13 <> 0 THEN 'Public works in ' || lower(sector) || ' block ' || (project_id % 9) || ' under scheme' END AS project_description,
               sector, CASE WHEN project_id % 6 <> 0 THEN 'S' || (custkey % 4) END AS sub_sector,
               c_nationkey AS state_id, c_nationkey * 100 + custkey % 7 AS constituency_id, c_mktsegment AS district_name,
               CASE WHEN custkey % 11 <> 0 THEN 'Block ' || (custkey % 9) END AS block_name,
               CASE WHEN custkey % 41 <> 0 THEN s_name END AS implementing_agency, c_name AS mp_name,
               CASE WHEN project_id % 3 < 2 THEN 'Lok Sabha' ELSE 'Rajya Sabha' END AS house_of_parliament,
               CAST(fy AS VARCHAR) || '-' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') AS financial_year,
               current_status, recommendation_date,
               CASE WHEN current_status = 'Recommended' OR project_id % 17 = 0 THEN NULL
                    WHEN project_id % 97 = 0 THEN recommendation_date - 5
                    ELSE recommendation_date + CAST(20 + custkey % 120 AS INTEGER) END AS sanction_date,
               CASE WHEN current_status NOT IN ('Recommended','Sanctioned') AND project_id % 37 <> 0
                    THEN recommendation_date + CAST(140 + project_id % 40 AS INTEGER) END AS work_order_date,
               CASE WHEN project_id % 23 <> 0 THEN recommendation_date + CAST(240 + project_id % 180 AS INTEGER) END AS expected_completion_date,
               CASE WHEN current_status = 'Completed' AND project_id % 29 <> 0
                    THEN recommendation_date + CAST(200 + custkey % 340 AS INTEGER) END AS actual_completion_date,
               price, custkey
        FROM (SELECT *, year(recommendation_date) - CASE WHEN month(recommendation_date) < 4 THEN 1 ELSE 0 END AS fy FROM projects0)
        LEFT JOIN customer ON c_custkey = custkey LEFT JOIN supplier ON s_suppkey = agency_key"""),
    "paid": ((), """
        SELECT l_orderkey AS project_id,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(14,2)) AS paid,
               CAST(max(l_shipdate) AS DATE) AS last_disbursement_date
        FROM lineitem GROUP BY 1"""),
    "financials0": (("projects0", "paid"), """
        SELECT project_id, current_status, CAST(price * CAST(1.05 AS DECIMAL(3,2)) AS DECIMAL(14,2)) AS recommended_amount,
               CASE WHEN current_status <> 'Recommended' THEN price END AS sanctioned_amount,
               coalesce(paid, CAST(0 AS DECIMAL(14,2))) AS released_amount,
               CASE WHEN current_status = 'Recommended' THEN CAST(0 AS DECIMAL(14,2))
                    ELSE CAST(coalesce(paid, CAST(0 AS DECIMAL(14,2))) * CAST(30 + (project_id * 7) % 81 AS DECIMAL(5,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) END AS expenditure_amount,
               last_disbursement_date
        FROM projects0 LEFT JOIN paid USING (project_id)"""),
    "financials": (("financials0",), """
        SELECT project_id, 'INR' AS currency, recommended_amount, sanctioned_amount, released_amount, expenditure_amount,
               released_amount - expenditure_amount AS unspent_balance,
               CASE WHEN released_amount > 0 THEN least(round(expenditure_amount::DOUBLE / released_amount::DOUBLE * 100, 2), 100.0) END AS utilization_rate_pct,
               CAST(CASE WHEN sanctioned_amount IS NOT NULL THEN greatest(expenditure_amount - sanctioned_amount, 0) ELSE 0 END AS DECIMAL(14,2)) AS cost_overrun_amount,
               CASE WHEN sanctioned_amount > 0 THEN round(greatest(expenditure_amount - sanctioned_amount, 0)::DOUBLE / sanctioned_amount::DOUBLE * 100, 2) ELSE 0.0 END::DOUBLE AS cost_overrun_pct,
               last_disbursement_date
        FROM financials0"""),
    "progress": ((), """
        SELECT l_orderkey AS project_id, l_partkey * 10 + l_linenumber AS progress_id, CAST(l_shipdate AS DATE) AS reported_date,
               least(l_quantity * 2, 100.0)::DOUBLE AS physical_progress_pct,
               round(least(greatest(l_quantity * 2 + round((l_discount - 0.05::DOUBLE) * 600, 2), 0.0), 100.0), 2)::DOUBLE AS financial_progress_pct,
               CASE WHEN l_quantity * 2 >= 100 THEN 'Completed' WHEN l_quantity * 2 >= 80 THEN 'Finishing'
                    WHEN l_quantity * 2 >= 30 THEN 'Structure' ELSE 'Foundation' END AS current_stage,
               CASE WHEN l_returnflag = 'R' THEN l_partkey % 120 ELSE 0 END AS days_delayed,
               CASE WHEN l_returnflag = 'R' AND l_partkey % 120 > 90 THEN 'Critical' WHEN l_returnflag = 'R' AND l_partkey % 120 > 0 THEN 'Delayed' ELSE 'On Track' END AS milestone_status,
               CASE WHEN l_tax >= 0.02 THEN CAST(l_shipdate AS DATE) + 3 END AS inspection_date,
               CASE WHEN l_tax >= 0.02 THEN 'Inspector ' || (l_suppkey % 20) END AS inspected_by,
               CASE WHEN l_suppkey % 9 <> 0 THEN (6 + l_suppkey % 33)::DOUBLE END AS geo_latitude,
               CASE WHEN l_suppkey % 9 <> 0 THEN (66 + l_partkey % 33)::DOUBLE END AS geo_longitude,
               CASE WHEN l_partkey % 7 <> 0 THEN 'photo/' || l_partkey END AS photo_evidence_url
        FROM lineitem"""),
    "latest_progress": (("progress",), """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY reported_date DESC, progress_id DESC) AS rn FROM progress) WHERE rn = 1"""),
    "risk_scores0": (("projects0",), """
        SELECT project_id, ((project_id * 37 + custkey * 11) % 1001) / 10.0::DOUBLE AS overall_risk_score,
               ((project_id * 13 + custkey) % 101)::DOUBLE AS delay_risk_score, ((project_id * 17 + custkey) % 101)::DOUBLE AS cost_overrun_risk_score,
               ((project_id * 19 + custkey) % 101)::DOUBLE AS non_completion_risk_score, ((project_id * 23 + custkey) % 101)::DOUBLE AS leakage_risk_score,
               (60 + project_id % 40) / 100.0::DOUBLE AS confidence_score, DATE '2000-01-01' AS assessment_date
        FROM projects0 WHERE project_id % 31 <> 0"""),
    "risk_scores": (("risk_scores0",), """
        SELECT *, project_id AS risk_score_id, CASE WHEN project_id % 19 = 0 THEN 'High' WHEN overall_risk_score < 30 THEN 'Low' WHEN overall_risk_score < 60 THEN 'Moderate'
               WHEN overall_risk_score < 80 THEN 'High' ELSE 'Critical' END AS risk_level FROM risk_scores0"""),
    "risk_factors0": (("risk_scores",), """
        SELECT risk_score_id, project_id, engine_name, factor_name, factor_category, ((project_id * (7 + eno * 4)) % 101)::DOUBLE AS score, ((project_id * 11) % 2600) / 10.0::DOUBLE - 60 AS dev
        FROM risk_scores, (VALUES (0, 'cost_anomaly', 'Cost Anomaly Detection', 'Budget Gap'), (1, 'duplicate_detection', 'Duplicate Project Detection', 'Other'),
             (2, 'delay_detection', 'Project Delay Detection', 'Delay in Tendering'), (3, 'progress_mismatch', 'Progress Mismatch Detection', 'Slow Physical Pace'),
             (4, 'agency_pattern', 'Agency Pattern Analysis', 'Agency Past Performance')) AS e(eno, engine_name, factor_name, factor_category)"""),
    "risk_factors": (("risk_factors0",), """
        SELECT risk_score_id, project_id, engine_name, factor_name, factor_category, score, 0.2::DOUBLE AS factor_weight,
               CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 30 THEN 'Medium' ELSE 'Low' END AS factor_impact,
               'Review ' || engine_name AS mitigation_recommendation, 'Score ' || score::INTEGER AS reason, (50 + project_id % 50) / 100.0::DOUBLE AS confidence,
               CASE WHEN engine_name = 'delay_detection' AND project_id % 4 <> 0 THEN (project_id * 3) % 500 END AS overdue_days,
               CASE WHEN engine_name = 'cost_anomaly' THEN dev END AS deviation_percentage,
               CASE WHEN engine_name = 'cost_anomaly' THEN ((project_id * 3) % 70) / 10.0::DOUBLE END AS robust_z_score,
               CASE WHEN engine_name = 'cost_anomaly' THEN CASE WHEN dev > 50 THEN 'HIGH_COST_OUTLIER' ELSE 'NORMAL' END END AS anomaly_type
        FROM risk_factors0"""),
    "project_features0": (("projects", "financials"), """
        SELECT project_id, CASE WHEN actual_completion_date IS NOT NULL AND expected_completion_date IS NOT NULL THEN actual_completion_date - expected_completion_date
               WHEN expected_completion_date IS NOT NULL THEN greatest(0, DATE '2000-01-01' - expected_completion_date) ELSE 0 END AS delay_days,
               round(coalesce(expenditure_amount, 0)::DOUBLE - coalesce(sanctioned_amount, 0)::DOUBLE, 2) AS cost_deviation
        FROM projects LEFT JOIN financials USING (project_id)"""),
    "project_features": (("project_features0",), "SELECT *, delay_days > 0 AS is_delayed FROM project_features0"),
    "overview": (("projects", "states", "constituencies", "financials", "latest_progress", "risk_scores"), """
        SELECT p.project_id, project_code, project_title, sector, sub_sector, p.state_id, s.state_name, s.canonical_state_key, p.constituency_id, constituency_name, reservation_category,
               district_name, block_name, implementing_agency, mp_name, house_of_parliament, financial_year, current_status, recommendation_date,
               sanction_date, work_order_date, expected_completion_date, actual_completion_date, currency,
               recommended_amount::DOUBLE AS recommended_amount, sanctioned_amount::DOUBLE AS sanctioned_amount, released_amount::DOUBLE AS released_amount,
               expenditure_amount::DOUBLE AS expenditure_amount, unspent_balance::DOUBLE AS unspent_balance, utilization_rate_pct,
               cost_overrun_amount::DOUBLE AS cost_overrun_amount, cost_overrun_pct, last_disbursement_date, reported_date AS progress_reported_date,
               physical_progress_pct, financial_progress_pct, current_stage, days_delayed, milestone_status, inspected_by, inspection_date, geo_latitude, geo_longitude,
               photo_evidence_url, overall_risk_score, delay_risk_score, cost_overrun_risk_score, non_completion_risk_score, leakage_risk_score, risk_level, confidence_score,
               assessment_date AS risk_assessment_date,
               coalesce(days_delayed > 0 OR milestone_status IN ('Delayed','Critical'), false) AS is_delayed,
               coalesce(cost_overrun_amount > 0, false) AS has_cost_overrun,
               CASE WHEN inspection_date IS NOT NULL THEN 'Audited' ELSE 'Pending Inspection' END AS audit_status
        FROM projects p JOIN states s ON p.state_id = s.state_id JOIN constituencies c ON p.constituency_id = c.constituency_id
        LEFT JOIN financials f ON p.project_id = f.project_id LEFT JOIN latest_progress g ON p.project_id = g.project_id
        LEFT JOIN risk_scores r ON p.project_id = r.project_id"""),
    "union_budget0": ((), """
        SELECT year(o_orderdate) AS start_year, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS be,
               CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(14,2)) END) AS DECIMAL(18,2)) AS ac FROM orders GROUP BY 1"""),
    "union_budget": (("union_budget0",), """
        SELECT CAST(start_year AS VARCHAR) || '-' || lpad(CAST((start_year + 1) % 100 AS VARCHAR), 2, '0') AS financial_year, start_year, 5.0::DOUBLE AS scheme_entitlement_per_mp_cr,
               CAST(be * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(14,2)) AS budget_estimate_cr,
               CASE WHEN start_year < 2001 THEN CAST(be * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(14,2)) END AS revised_estimate_cr,
               CASE WHEN start_year < 2001 THEN CAST(ac * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(14,2)) END AS actual_expenditure_cr,
               CASE WHEN start_year < 2001 THEN CAST(ac * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(14,2)) - CAST(be * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(14,2)) END AS be_vs_actual_variance_cr,
               CASE WHEN start_year < 2001 THEN 'Closed' ELSE 'Open' END AS status_notes FROM union_budget0"""),
    "qa_raw": (("projects", "financials", "states"), """
        SELECT p.state_id, state_name, canonical_state_key,
               CAST(CAST(sum(released_amount) AS DECIMAL(18,2)) * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(14,2)) AS released_cr,
               CAST(CAST(sum(expenditure_amount) AS DECIMAL(18,2)) * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(14,2)) AS expenditure_cr,
               count(*) AS works_recommended, count(sanction_date) AS works_sanctioned, count(*) FILTER (current_status = 'Completed') AS works_completed
        FROM projects p JOIN financials USING (project_id) JOIN states s ON p.state_id = s.state_id GROUP BY ALL"""),
    "parliament_qa": (("qa_raw",), """
        SELECT *, released_cr - expenditure_cr AS unspent_balance_cr,
               CASE WHEN released_cr > 0 THEN round(expenditure_cr::DOUBLE / released_cr::DOUBLE * 100, 2) ELSE 0.0 END::DOUBLE AS utilization_rate_pct,
               CASE WHEN works_recommended > 0 THEN round(works_sanctioned::DOUBLE / works_recommended::DOUBLE * 100, 2) ELSE 0.0 END::DOUBLE AS sanction_rate_pct,
               CASE WHEN works_sanctioned > 0 THEN round(works_completed::DOUBLE / works_sanctioned::DOUBLE * 100, 2) ELSE 0.0 END::DOUBLE AS completion_rate_pct
        FROM qa_raw"""),
    "seats": (("constituencies",), """
        SELECT canonical_state_key, count(*) AS total_lok_sabha_seats, count(*) FILTER (reservation_category = 'General') AS general_seats,
               count(*) FILTER (reservation_category = 'SC') AS sc_reserved_seats, count(*) FILTER (reservation_category = 'ST') AS st_reserved_seats
        FROM constituencies GROUP BY 1"""),
    "master_dim": (("states", "seats", "parliament_qa"), """
        SELECT s.state_id, s.state_name, s.canonical_state_key, s.category, total_lok_sabha_seats, general_seats, sc_reserved_seats, st_reserved_seats,
               round(sc_reserved_seats::DOUBLE / total_lok_sabha_seats * 100, 2) AS sc_seat_share_pct, round(st_reserved_seats::DOUBLE / total_lok_sabha_seats * 100, 2) AS st_seat_share_pct,
               15.0::DOUBLE AS statutory_sc_allocation_pct, 7.5::DOUBLE AS statutory_st_allocation_pct, released_cr AS cumulative_released_cr,
               expenditure_cr AS cumulative_expenditure_cr, unspent_balance_cr, utilization_rate_pct AS utilization_pct, works_completed AS works_completed_count
        FROM states s LEFT JOIN seats USING (canonical_state_key) LEFT JOIN parliament_qa q USING (canonical_state_key)"""),
    "calamity": ((), """
        SELECT c_custkey AS s_no, CASE c_custkey % 4 WHEN 0 THEN 'Shri ' WHEN 1 THEN 'Smt ' WHEN 2 THEN 'DR ' ELSE '' END || lower(c_name) AS raw_name,
               c_custkey % 3 + 1 AS house_code, abs(round(c_acctbal * 1500, 2)) AS consented_amount_inr,
               DATE '2019-06-01' + CAST(c_custkey % 2100 AS INTEGER) AS consent_date, DATE '2019-06-01' AS tenure_start_date, DATE '2019-06-01' + 1826 AS tenure_end_date FROM customer"""),
    "history": ((), """
        SELECT event_id AS history_id, user_id AS project_id, CASE event_type WHEN 'error' THEN 'Delay Flagged' WHEN 'purchase' THEN 'Fund Disbursed' ELSE 'Status Changed' END AS event_type,
               ts AS event_timestamp, CASE event_type WHEN 'view' THEN 'Recommended' WHEN 'click' THEN 'Sanctioned' WHEN 'signup' THEN 'Work Order Issued' WHEN 'error' THEN 'Stalled' ELSE 'In Progress' END AS new_status,
               'user ' || (event_id % 17) AS performed_by FROM events"""),
    "snapshots0": ((), """
        SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ((event_id * 7) % 1001) / 10.0::DOUBLE AS score FROM events"""),
    "snapshots": (("snapshots0",), """
        SELECT event_id AS snapshot_id, user_id AS project_id, ts AS snapshot_datetime, CASE event_type WHEN 'error' THEN 'Stalled' WHEN 'signup' THEN 'Sanctioned' ELSE 'In Progress' END AS project_status,
               CAST(100000 AS DECIMAL(14,2)) AS sanctioned_amount, CAST(CAST(value AS DECIMAL(14,2)) * 1000 AS DECIMAL(14,2)) AS released_amount,
               CAST(CAST(value AS DECIMAL(14,2)) * 900 AS DECIMAL(14,2)) AS expenditure_amount, CAST(least(value, 100.0) AS DECIMAL(5,2)) AS physical_progress_pct,
               CASE WHEN event_id % 5 <> 0 THEN CAST(least(CAST(value AS DECIMAL(14,4)) * 0.5, 100.0) AS DECIMAL(5,2)) END AS financial_progress_pct,
               DATE '2025-01-01' + CAST(k % 3 AS INTEGER) AS expected_completion_date, CASE WHEN k > 90 THEN DATE '2025-06-01' END AS actual_completion_date,
               k AS days_delayed, CASE WHEN k > 60 THEN 'Delayed' ELSE 'On Track' END AS milestone_status, CAST(score AS DECIMAL(5,2)) AS overall_risk_score,
               CASE WHEN score < 30 THEN 'Low' WHEN score < 60 THEN CASE WHEN event_id % 2 = 0 THEN 'Moderate' ELSE 'Medium' END WHEN score < 80 THEN 'High' ELSE 'Critical' END AS risk_level
        FROM snapshots0"""),
    "readings": ((), """
        SELECT user_id AS project_id, ts AS event_ts, event_id AS update_id, least(value, 100.0)::DOUBLE AS physical_progress_pct, round(value * 1000, 2) AS expenditure_amount,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS days_delayed FROM events"""),
}


def sql(body: str, *tables: str, recursive: bool = False) -> str:
    """``body`` prefixed by the CTEs it names and those they need."""
    done: dict[str, str] = {}

    def need(name: str):
        deps, text = CTES[name]
        for d in deps:
            need(d)
        done.setdefault(name, text)

    for t in tables:
        need(t)
    if not done:
        return body
    extra = body.lstrip()
    parts = [f"{n} AS ({t})" for n, t in done.items()]
    if extra[:5].upper() == "WITH ":
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + ",\n" + extra[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
