"""Profiling and data-quality queries."""
from pyspark.sql import functions as F

from civicledger import fixed_values as fv
from civicledger.operators import clean as B, features as H, profile as C, quality as D, views as V
from civicledger.operators.ranks import group_quantiles
from civicledger.plans import q_features as QF
from civicledger.plans.oracle_tables import sql
from civicledger.plans.registry import query

# ---- C: profiles -------------------------------------------------------------------------------
COLS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::VARCHAR AS raw FROM supplier" for c in COLS) + \
    " UNION ALL SELECT 'o_day', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'o_gap', CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE (o_custkey - 500)::VARCHAR END FROM orders"
LONG = f"l AS (SELECT col AS \"column\", raw, CASE WHEN trim(raw) <> '' THEN trim(raw) END AS value FROM ({LONG}))"


def _sup(t):
    return t["supplier"].select(*COLS)


def _ord(t):
    return t["orders"].select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"),
                              F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise((F.col("o_custkey") - 500).cast("string")).alias("o_gap"))


def _two(t, fn):
    return fn(_sup(t)).unionByName(fn(_ord(t)))


KIND = """CASE WHEN count(value) = 0 THEN 'EMPTY' WHEN count(*) FILTER (NOT regexp_full_match(value, '-?\\d+')) = 0 THEN 'INTEGER' WHEN count(*) FILTER (value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL) = 0 THEN 'FLOAT'
  WHEN count(*) FILTER (NOT regexp_full_match(value, '\\d{4}-\\d{2}-\\d{2}')) = 0 THEN 'DATE' ELSE 'STRING' END"""


@query("c1_infer_types", sql(f'WITH {LONG} SELECT "column", {KIND} AS inferred_type FROM l GROUP BY 1'))
def _(t):
    return _two(t, C.infer_types)


@query("c2_percentiles", sql("""SELECT sector, count(*) AS n, quantile_cont(sanctioned_amount::DOUBLE, 0.25) AS q1, quantile_cont(sanctioned_amount::DOUBLE, 0.5) AS median, round(quantile_cont(sanctioned_amount::DOUBLE, 0.9), 4) AS p90
  FROM projects JOIN financials USING (project_id) WHERE sanctioned_amount IS NOT NULL GROUP BY 1""", "projects", "financials"))
def _(t):
    d = t["projects"].select("project_id", "sector").join(t["financials"].select("project_id", "sanctioned_amount"), "project_id")
    return group_quantiles(d, ["sector"], "sanctioned_amount", {"q1": 0.25, "median": 0.5, "p90": 0.9}).withColumn("p90", F.round("p90", 4))


@query("c3_column_profile", sql(f"""WITH {LONG}, k AS (SELECT "column", {KIND} AS inferred_type FROM l GROUP BY 1),
  x AS (SELECT l.*, CASE WHEN inferred_type IN ('INTEGER','FLOAT') THEN try_cast(value AS DOUBLE) END AS v, inferred_type FROM l JOIN k USING ("column"))
  SELECT "column", inferred_type, count(*) AS total, count(value) AS non_null, count(*) - count(value) AS null_count, round((count(*) - count(value)) / count(*) * 100, 2) AS null_pct, count(DISTINCT value) AS unique_values,
    count(value) - count(DISTINCT value) AS duplicate_count, min(v) AS min_value, max(v) AS max_value, round(avg(v), 2) AS mean_value, round(stddev_pop(v), 2) AS std_value, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
    quantile_cont(v, 0.75) AS q3 FROM x GROUP BY 1, 2"""))
def _(t):
    return _two(t, C.profile).select("column", "inferred_type", "total", "non_null", "null_count", "null_pct", "unique_values", "duplicate_count", "min_value",
                                     "max_value", "mean_value", "std_value", "q1", "median", "q3")


@query("c4_top_values", sql(f"""WITH {LONG}, c AS (SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY "column") AS tot, count(*) OVER (PARTITION BY "column") AS u FROM c)
  SELECT "column", value, n, rank, round(n / tot * 100, 1) AS share_pct, greatest(u - 4, 0) AS other_values FROM r WHERE rank <= 4"""))
def _(t):
    return _two(t, lambda d: C.top_values(C.long_values(d))).select("column", "value", "n", "rank", "share_pct", "other_values")


@query("c5_string_extremes", sql(f"""WITH {LONG}, r AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY length(value), value) AS a, row_number() OVER (PARTITION BY "column" ORDER BY length(value) DESC, value DESC) AS z FROM l WHERE value IS NOT NULL)
  SELECT "column", max(value) FILTER (a = 1) AS min_text, max(value) FILTER (z = 1) AS max_text FROM r GROUP BY 1"""))
def _(t):
    return _two(t, lambda d: C.string_extremes(C.long_values(d)))


@query("c6_quality_tags", sql(f"""WITH {LONG}, k AS (SELECT "column", {KIND} AS kind, count(*) AS total, count(value) AS nn, count(DISTINCT value) AS u, min(try_cast(value AS DOUBLE)) AS lo, max(try_cast(value AS DOUBLE)) AS hi,
    round((count(*) - count(value)) / count(*) * 100, 2) AS np, count(*) FILTER (raw LIKE ' %' OR raw LIKE '% ') AS pad FROM l GROUP BY 1),
  g AS (SELECT "column", list_filter([CASE WHEN kind IN ('INTEGER','FLOAT') AND lo < 0 THEN 'Negative values present in non-variance metric' END, CASE WHEN kind IN ('INTEGER','FLOAT') AND lo = hi AND nn > 1 THEN 'Constant column (zero variance)' END,
    CASE WHEN np > 50 THEN 'Critical missingness (>50% null: ' || np || '%)' WHEN np > 15 THEN 'Moderate missingness (' || np || '% null)' END, CASE WHEN u = 1 AND nn > 1 THEN 'Single unique value across all rows' END,
    CASE WHEN u = total AND nn = total THEN 'Candidate Primary Key (100% unique, 0% null)' END, CASE WHEN pad > 0 THEN 'Leading/trailing whitespace detected in raw values' END], lambda x: x IS NOT NULL) AS tags FROM k)
  SELECT "column", CASE WHEN len(tags) = 0 THEN 'No quality anomalies detected (Clean)' ELSE array_to_string(tags, '; ') END AS quality_tags FROM g"""))
def _(t):
    return _two(t, lambda d: C.quality_tags(C.profile(d)))


@query("c7_feature_report", sql(f"""WITH f AS (SELECT 'delay_days' AS feature, ({QF.DELAY})::DOUBLE AS x, true AS signed FROM joined UNION ALL SELECT 'is_delayed', CASE WHEN {QF.DELAY} > 0 THEN 1 ELSE 0 END, false FROM joined
    UNION ALL SELECT 'cost_deviation', round_even({QF.E} - {QF.S}, 2), true FROM joined UNION ALL SELECT 'planned_duration_days', {QF._pos('expected_completion_date', QF.START)}, false FROM joined)
  SELECT feature, min(x) AS minimum, max(x) AS maximum, round(avg(x), 4) AS mean, count(*) - count(x) AS missing_count, count(*) FILTER (NOT signed AND x < 0) AS invalid_count, quantile_cont(x, 0.5) AS median FROM f GROUP BY 1""", "joined"))
def _(t):
    df = H.load_joined(t)
    for step in (H.delay_days, H.durations, H.cost_deviation):
        df = step(df, QF.CFG)
    return C.feature_report(df, ["delay_days", "is_delayed", "cost_deviation", "planned_duration_days"]).drop("example_values")


# ---- D: checks ------------------------------------------------------------------------------------
def slim(df):
    return df.select("check_performed", "status", "affected_records")


def one(name: str, affected: str, frm: str, bad: str = "FAIL") -> str:
    n = name.replace("'", "''")
    return f"SELECT '{n}' AS check_performed, CASE WHEN {affected} = 0 THEN 'PASS' ELSE '{bad}' END AS status, coalesce({affected}, 0)::BIGINT AS affected_records FROM {frm}"


def many(*parts: str) -> str:
    return " UNION ALL ".join(parts)


@query("d1_row_counts", sql(one("Row count reconciliation (Raw vs Clean)", "count(*) - count(DISTINCT (text, lang))", "documents", "WARNING")))
def _(t):
    raw = t["documents"].select("text", "lang")
    return slim(D.check_row_counts({"documents": (raw, B.dedupe_exact(raw)[0])}))


@query("d2_duplicates", sql(one("Exact duplicate rows check", "count(*) - count(DISTINCT text)", "documents")))
def _(t):
    return slim(D.check_duplicates(t["documents"].select("text"), "documents"))


@query("d3_missing", sql(many(*[one(f"Missingness in column '{c}'", f"CASE WHEN count(*) - count({c}) > {a} THEN count(*) - count({c}) ELSE 0 END", "projects", "WARNING")
                                for c, a in (("sector", 0), ("block_name", 0), ("sanction_date", 10**9), ("actual_completion_date", 0))]), "projects"))
def _(t):
    return slim(D.check_missing(t["projects"].select("sector", "block_name", "sanction_date", "actual_completion_date"), "projects", {"sanction_date": 10**9}))


@query("d4_blank_strings", sql(many(*[one(f"Empty string check in '{c}'", f"count(*) FILTER (trim({c}) = '')", frm, "WARNING") for c, frm in (("text", "documents"), ("lang", "documents"))])))
def _(t):
    return slim(D.check_blank(t["documents"].select("text", "lang"), "documents"))


@query("d5_data_types", sql(many(one("Data type of column 'o_custkey'", "0", "(SELECT 1)"), one("Data type of column 'o_totalprice'", "count(*)", "orders"), one("Data type of column 'o_orderstatus'", "0", "(SELECT 1)"))))
def _(t):
    return slim(D.check_types(t["orders"], "orders", {"o_custkey": "int", "o_totalprice": "str", "o_orderstatus": "str"}))


@query("d6_primary_key", sql(many(one("Primary key non-null check for 'l_orderkey, l_linenumber'", "0", "(SELECT 1)"),
                                  one("Primary key uniqueness check for 'l_orderkey, l_linenumber'", "count(*) - count(DISTINCT (l_orderkey, l_linenumber))", "lineitem"))))
def _(t):
    return slim(D.check_pk(t["lineitem"], "lineitem", ["l_orderkey", "l_linenumber"]))


@query("d7_foreign_key_population", sql("SELECT 'projects' AS dataset, 'implementing_agency' AS key_column, count(*) - count(implementing_agency) AS affected_records, count(DISTINCT implementing_agency) AS distinct_parents, CASE WHEN count(*) = count(implementing_agency) THEN 'PASS' ELSE 'FAIL' END AS status FROM projects", "projects"))
def _(t):
    return D.check_fk_population(t["projects"], "projects", "implementing_agency")


@query("d8_orphans", sql(many(one("Orphan check progress->projects", "count(*)", "lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"), one("Orphan check history->projects", "count(*)", "events WHERE user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)"))))
def _(t):
    p = t["projects"].select("project_id")
    return slim(D.union_results([D.check_orphans(t["progress"], p, ["project_id"], "progress->projects"),
                                 D.check_orphans(t["project_history"], p.filter("project_id % 2 = 0"), ["project_id"], "history->projects")]))


@query("d9_iso_dates", sql(many(one("ISO-8601 regex check on 'good'", "0", "(SELECT 1)"), one("ISO-8601 regex check on 'bad'", "count(*) FILTER (o_orderkey % 3 = 0)", "orders"))))
def _(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    d = t["orders"].select(iso.alias("good"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(iso).alias("bad"))
    return slim(D.check_iso_dates(d, "orders", ["good", "bad"]))


@query("d10_financials", sql(many(one("Numeric type check on 'c_acctbal'", "0", "(SELECT 1)"), one("Non-negative bound check on 'c_acctbal'", "count(*) FILTER (c_acctbal < 0)", "customer"),
                                  one("Numeric type check on 'mixed'", "count(*) FILTER (c_custkey % 9 = 0)", "customer"), one("Sign check on 'mixed' (Variance allowed < 0)", "count(*) FILTER (c_acctbal < 0 AND c_custkey % 9 <> 0)", "customer", "PASS"))))
def _(t):
    d = t["customer"].select("c_acctbal", F.when(F.col("c_custkey") % 9 == 0, "x").otherwise(F.col("c_acctbal").cast("string")).alias("mixed"))
    return slim(D.check_financials(d, "customer", ["c_acctbal", "mixed"], ["mixed"]))


@query("d11_categories", sql("SELECT current_status, count(*) AS affected_records FROM projects WHERE current_status NOT IN ('Completed','In Progress','Sanctioned') GROUP BY 1", "projects"))
def _(t):
    return D.unexpected_categories(t["projects"], "current_status", ["Completed", "In Progress", "Sanctioned"])


@query("d11_category_check", sql(one("Allowed categories in 'current_status'", "count(*) FILTER (current_status NOT IN ('Completed','In Progress','Sanctioned'))", "projects", "WARNING"), "projects"))
def _(t):
    return slim(D.check_categories(t["projects"], "projects", {"current_status": ["Completed", "In Progress", "Sanctioned"]}))


@query("d12_seat_identity", sql(many(one("Seat partition identity: Total == Gen + SC + ST", "count(*) FILTER (total_lok_sabha_seats <> general_seats + sc_reserved_seats + st_reserved_seats)", "master_dim"),
                                     one("Total National Lok Sabha Seats Sum", "abs(sum(total_lok_sabha_seats) - 543)", "master_dim")), "master_dim"))
def _(t):
    return slim(D.check_partition_identity(t["master_dim"], "master_dim", "total_lok_sabha_seats", ["general_seats", "sc_reserved_seats", "st_reserved_seats"], 543))


@query("d13_progression", sql(one("Progression: works_recommended >= works_sanctioned >= works_completed", "count(*) FILTER (works_sanctioned > works_recommended OR works_completed > works_sanctioned)", "parliament_qa"), "parliament_qa"))
def _(t):
    return slim(D.check_progression(t["parliament_qa"], "parliament_qa", ["works_recommended", "works_sanctioned", "works_completed"]))


@query("d14_rate_bounds", sql(one("Bounds of cost_overrun_pct", "count(*) FILTER (cost_overrun_pct NOT BETWEEN 0 AND 100)", "financials"), "financials"))
def _(t):
    return slim(D.check_bounds(t["financials"], "financials", "cost_overrun_pct", 0, 100))


@query("d15_statutory_cap", sql(one("Statutory cap on consented_amount_lakhs", "count(*) FILTER (round(consented_amount_inr / 1e5, 2) > 100)", "calamity"), "calamity"))
def _(t):
    return slim(D.check_cap(B.clean_consents(t["calamity"]), "calamity_relief", "consented_amount_lakhs", 100.0))


@query("d16_interval", sql(one("consent_date within [tenure_start_date, tenure_end_date]", "count(*) FILTER (consent_date < tenure_start_date OR consent_date > tenure_end_date)", "calamity", "WARNING"), "calamity"))
def _(t):
    return slim(D.check_interval(t["calamity"], "calamity_relief", "consent_date", "tenure_start_date", "tenure_end_date"))


CHRONO = many(one("Sanction Date >= Recommendation Date", "count(*) FILTER (sanction_date < recommendation_date)", "projects"), one("Work Order Date >= Sanction Date", "count(*) FILTER (work_order_date < sanction_date)", "projects"),
              one("Actual Completion Date >= Work Order Date", "count(*) FILTER (actual_completion_date < work_order_date)", "projects"),
              one("Expected Completion Date >= Work Order Date", "count(*) FILTER (expected_completion_date < work_order_date)", "projects"),
              one("Inspection Date >= Project Recommendation Date", "count(*) FILTER (inspection_date < recommendation_date)", "progress JOIN projects USING (project_id)"))


@query("d17_chronology", sql(CHRONO, "projects", "progress"))
def _(t):
    return slim(D.check_chronology(t["projects"], t["progress"]))


@query("d18_derived_values", sql(many(one("Unspent Balance Calculation (Released - Expenditure)", "count(*) FILTER (unspent_balance <> released_amount - expenditure_amount)", "financials"),
                                      one("Utilization Rate Percentage Formula Match", "count(*) FILTER (released_amount > 0 AND abs(utilization_rate_pct - round(expenditure_amount::DOUBLE / released_amount::DOUBLE * 100, 2)) > 0.05)", "financials"),
                                      one("Cost Overrun Flagged when Expenditure > Sanctioned", "count(*) FILTER (expenditure_amount > sanctioned_amount AND cost_overrun_amount <= 0)", "financials")), "financials"))
def _(t):
    return slim(D.check_derived(t["financials"]))


@query("d19_domain_bounds", sql(many(one("latitude", "count(*) FILTER (geo_latitude NOT BETWEEN 6 AND 38)", "progress"), one("longitude", "count(*) FILTER (geo_longitude NOT BETWEEN 68 AND 98)", "progress"),
                                     one("milestone", "0", "(SELECT 1)"), one("physical", "0", "(SELECT 1)"), one("delay", "count(*) FILTER (days_delayed < 0)", "progress")), "progress"))
def _(t):
    return slim(D.check_domain(t["progress"], "progress", {
        "latitude": F.col("geo_latitude").between(6, 38), "longitude": F.col("geo_longitude").between(68, 98),
        "milestone": F.col("milestone_status").isin(fv.MILESTONES), "physical": F.col("physical_progress_pct").between(0, 100), "delay": F.col("days_delayed") >= 0}))


@query("d20_required_columns", sql(one("Required columns non-null in projects", "count(*) FILTER (sector IS NULL OR implementing_agency IS NULL OR block_name IS NULL)", "projects"), "projects"))
def _(t):
    return slim(D.check_required(t["projects"], "projects", ["sector", "implementing_agency", "block_name"]))


@query("d21_completeness", sql(many(one("Source ids missing from store", "count(*)", "customer WHERE c_custkey % 10 = 0"), one("Stored ids not in source", "0", "(SELECT 1)"),
                                    one("Code matches source", "count(*) FILTER (c_custkey % 7 = 0)", "customer WHERE c_custkey % 10 <> 0"))))
def _(t):
    src = t["customer"].select("c_custkey", "c_name")
    stored = src.filter("c_custkey % 10 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "?").otherwise(F.col("c_name")))
    return slim(D.check_completeness(stored, src, "c_custkey", "customer", "c_name"))


@query("d22_null_preservation", sql(many(one("NULL count of actual_expenditure_cr", "abs(count(*) - count(actual_expenditure_cr) - 1)", "union_budget"), one("NULL count of revised_estimate_cr", "abs(count(*) - count(revised_estimate_cr) - 3)", "union_budget")), "union_budget"))
def _(t):
    return slim(D.check_null_counts(t["union_budget"], "union_budget", {"actual_expenditure_cr": 1, "revised_estimate_cr": 3}))


@query("d23_negative_outlays", sql("""SELECT 'financials' AS dataset, count(*) FILTER (unspent_balance < 0 OR released_amount < 0) AS affected_records FROM financials UNION ALL SELECT 'customer', count(*) FILTER (c_acctbal < 0) FROM customer
  UNION ALL SELECT 'supplier', count(*) FILTER (s_acctbal < 0) FROM supplier""", "financials"))
def _(t):
    return D.check_non_negative_all({"financials": (t["financials"], ["unspent_balance", "released_amount"]), "customer": (t["customer"], ["c_acctbal"]),
                                     "supplier": (t["supplier"], ["s_acctbal"])}).select("dataset", "affected_records")


@query("d24_text_hygiene", sql(many(one("Padding in 'text'", "count(*) FILTER (text <> trim(text))", "documents", "WARNING"), one("Double spaces in 'text'", "count(*) FILTER (text LIKE '%  %')", "documents", "WARNING"))))
def _(t):
    return slim(D.check_text_hygiene(t["documents"].select("text"), "documents"))


@query("d25_view_smoke_checks", sql("""SELECT 'sector' AS view, count(DISTINCT sector) AS row_count, count(*)::DOUBLE AS column_sum, 'PASS' AS status FROM projects UNION ALL
  SELECT 'delayed', count(*), round(sum(days_delayed), 2)::DOUBLE, 'PASS' FROM overview WHERE days_delayed > 0 OR milestone_status IN ('Delayed','Critical') OR current_status = 'Stalled'""", "overview"))
def _(t):
    return D.check_views({"sector": V.sector_financial_summary(t), "delayed": V.delayed_projects(t)}, {"sector": "total_projects", "delayed": "days_delayed"})


@query("d26_quality_report", sql(f"SELECT count(*) AS checks, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARNING') AS warning, count(*) FILTER (status = 'FAIL') AS fail, sum(affected_records)::BIGINT AS affected_records, round(count(*) FILTER (status = 'PASS') / count(*) * 100, 2) AS pass_rate_pct FROM ({CHRONO})", "projects", "progress"))
def _(t):
    return D.quality_report(D.check_chronology(t["projects"], t["progress"]))


@query("d27_cleaning_audit", sql(many(*[one(n, "0", "(SELECT 1)") for n in ("Constituency Reservation Extraction", "Reservation marker removed from name", "Constituency Raw Caption Preservation", "Canonical State Slug Generation", "Honorific Extraction in Calamity Relief")])))
def _(t):
    return slim(D.audit_cleaning(t["constituencies"], B.clean_consents(t["calamity"])))
