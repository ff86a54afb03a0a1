"""Data-quality checks. Each check is an aggregate expression counting offending rows; all checks of
one table are evaluated in a single pass and come back as one result row each."""
from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from civicledger.functions import columns as X


class Check(NamedTuple):
    category: str
    name: str
    expected: str
    affected: Column            # aggregate: number of offending rows
    bad_status: str = "FAIL"
    details: str = ""


RESULT = ["dataset", "check_category", "check_performed", "expected_condition", "actual_result", "status", "affected_records", "details"]


def run_checks(df: DataFrame, dataset: str, checks: list[Check]) -> DataFrame:
    one = df.agg(*[c.affected.cast("bigint").alias(f"__c{i}") for i, c in enumerate(checks)])
    rows = F.explode(F.array(*[F.struct(
        F.lit(dataset).alias("dataset"), F.lit(c.category).alias("check_category"), F.lit(c.name).alias("check_performed"),
        F.lit(c.expected).alias("expected_condition"), F.coalesce(F.col(f"__c{i}"), F.lit(0)).alias("affected_records"),
        F.lit(c.bad_status).alias("bad"), F.lit(c.details).alias("note")) for i, c in enumerate(checks)])).alias("r")
    n = F.col("affected_records")
    return one.select(rows).select("r.*").select(
        "dataset", "check_category", "check_performed", "expected_condition",
        F.when(n == 0, "0 offending records").otherwise(F.concat(n.cast("string"), F.lit(" offending records"))).alias("actual_result"),
        F.when(n == 0, "PASS").otherwise(F.col("bad")).alias("status"), "affected_records",
        F.when(n > 0, F.col("note")).otherwise("").alias("details"))


def union_results(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_row_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Raw against clean row counts."""
    out = []
    for name, (raw, clean) in pairs.items():
        both = raw.agg(F.count(F.lit(1)).alias("__raw")).join(clean.agg(F.count(F.lit(1)).alias("__clean")))
        out.append(run_checks(both, name, [Check("Row Count", "Row count reconciliation (Raw vs Clean)", "Clean rows == Raw records",
                                                 F.max(F.abs(F.col("__raw") - F.col("__clean"))), "WARNING", "Count mismatch between raw and clean")]))
    return union_results(out)


def _extra_copies(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("__n"))


def check_duplicates(df: DataFrame, name: str) -> DataFrame:
    return run_checks(_extra_copies(df, df.columns), name, [
        Check("Duplicates", "Exact duplicate rows check", "0 duplicate rows", F.sum(F.col("__n") - 1), "FAIL", "Identical records found")])


def check_missing(df: DataFrame, name: str, allowed: dict[str, int] | None = None) -> DataFrame:
    """Missing values per column; a documented number of them still passes."""
    allowed = allowed or {}
    checks = []
    for c in df.columns:
        n = F.count_if(F.col(c).isNull())
        over = F.when(n > allowed.get(c, 0), n).otherwise(0)
        checks.append(Check("Missing Values", f"Missingness in column '{c}'", f"<= {allowed.get(c, 0)} missing values", over, "WARNING",
                            f"Unplanned missing values in column {c}"))
    return run_checks(df, name, checks)


def _strings(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def check_blank(df: DataFrame, name: str) -> DataFrame:
    return run_checks(df, name, [Check("Whitespace & Empty Strings", f"Empty string check in '{c}'", "Zero whitespace-only or empty strings",
                                       F.count_if(F.length(F.trim(F.col(c))) == 0), "WARNING") for c in _strings(df)])


FAMILY = {"int": ("int", "bigint", "smallint", "tinyint"), "float": ("double", "float", "decimal"), "str": ("string",),
          "bool": ("boolean",), "date": ("date", "timestamp", "timestamp_ntz")}


def check_types(df: DataFrame, name: str, expected: dict[str, str]) -> DataFrame:
    """Declared type family per column; a wrong family affects every row."""
    actual = dict(df.dtypes)
    rows = F.count(F.lit(1))
    return run_checks(df, name, [
        Check("Data Types", f"Data type of column '{c}'", f"Expected type '{k}'",
              F.lit(0) if actual[c].split("(")[0] in FAMILY[k] else rows, "FAIL", f"Column {c} has type {actual[c]}")
        for c, k in expected.items() if c in actual])


def check_pk(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    null = X.any_of([F.col(f"`{c}`").isNull() for c in cols])
    keys, label = _extra_copies(df, cols), ", ".join(cols)
    return run_checks(keys, name, [
        Check("ID Integrity", f"Primary key non-null check for '{label}'", "0 missing IDs", F.sum(F.when(null, F.col("__n")).otherwise(0))),
        Check("ID Integrity", f"Primary key uniqueness check for '{label}'", "100% unique IDs", F.sum(F.col("__n") - 1))])


def check_fk_population(df: DataFrame, name: str, col: str) -> DataFrame:
    """Missing foreign keys, and the number of distinct parents in the actual result."""
    g = df.groupBy(F.col(col).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    res = g.agg(F.coalesce(F.sum(F.when(F.col("__k").isNull(), F.col("__n"))), F.lit(0)).alias("affected_records"),
                F.count("__k").alias("distinct_parents"))
    return res.select(F.lit(name).alias("dataset"), F.lit(col).alias("key_column"), "affected_records", "distinct_parents",
                      F.when(F.col("affected_records") == 0, "PASS").otherwise("FAIL").alias("status"))


def check_orphans(child: DataFrame, parent: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Child rows without a parent. Child keys are counted first, so a hot key is one row."""
    have = X.all_of([F.col(k).isNotNull() for k in keys])
    orphans = child.filter(have).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(parent.select(*keys), keys, "left_anti")
    return run_checks(orphans, label, [Check("Referential Integrity", f"Orphan check {label}", "0 orphan rows", F.sum("__n"))])


def check_iso_dates(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    return run_checks(df, name, [Check("Date Format", f"ISO-8601 regex check on '{c}'", "All dates conform to YYYY-MM-DD",
                                       F.count_if(~F.col(c).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"))) for c in cols])


def check_financials(df: DataFrame, name: str, cols: list[str], allow_negative: list[str] = ()) -> DataFrame:
    checks = []
    for c in cols:
        num = F.col(c).cast("string").try_cast("double")
        checks.append(Check("Financial Values", f"Numeric type check on '{c}'", "All values numeric float", F.count_if(num.isNull() & F.col(c).isNotNull())))
        if c in allow_negative:
            checks.append(Check("Financial Values", f"Sign check on '{c}' (Variance allowed < 0)", "Both signs expected", F.count_if(num < 0), "PASS",
                                "Legitimate negative values"))
        else:
            checks.append(Check("Financial Values", f"Non-negative bound check on '{c}'", f"{c} >= 0.0", F.count_if(num < 0)))
    return run_checks(df, name, checks)


def check_categories(df: DataFrame, name: str, rules: dict[str, list[str]]) -> DataFrame:
    return run_checks(df, name, [Check("Categorical Values", f"Allowed categories in '{c}'", "Subset of " + ", ".join(allowed),
                                       F.count_if(~F.col(c).isin(allowed)), "WARNING") for c, allowed in rules.items()])


def unexpected_categories(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    return df.filter(~F.col(col).isin(allowed)).groupBy(col).agg(F.count(F.lit(1)).alias("affected_records"))


def check_partition_identity(df: DataFrame, name: str, total: str, parts: list[str], expected_sum: int | None = None) -> DataFrame:
    whole = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    checks = [Check("Domain Logic", "Seat partition identity: Total == Gen + SC + ST", "Total equals sum of partitions", F.count_if(F.col(total) != whole))]
    if expected_sum is not None:
        checks.append(Check("Domain Logic", "Total National Lok Sabha Seats Sum", f"Exactly {expected_sum} seats", F.abs(F.sum(total) - expected_sum)))
    return run_checks(df, name, checks)


def check_progression(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """Columns listed from largest to smallest."""
    bad = X.any_of([F.col(b) > F.col(a) for a, b in zip(cols, cols[1:])])
    return run_checks(df, name, [Check("Domain Logic", "Progression: " + " >= ".join(cols), "Counts never rise along the workflow", F.count_if(bad))])


def check_bounds(df: DataFrame, name: str, col: str, lo: float, hi: float) -> DataFrame:
    return run_checks(df, name, [Check("Domain Logic", f"Bounds of {col}", f"{lo} <= {col} <= {hi}", F.count_if(~F.col(col).between(lo, hi)))])


def check_cap(df: DataFrame, name: str, col: str, cap: float) -> DataFrame:
    return run_checks(df, name, [Check("Domain Logic", f"Statutory cap on {col}", f"{col} <= {cap}", F.count_if(F.col(col) > cap))])


def check_interval(df: DataFrame, name: str, d: str, lo: str, hi: str) -> DataFrame:
    return run_checks(df, name, [Check("Domain Logic", f"{d} within [{lo}, {hi}]", f"{lo} <= {d} <= {hi}",
                                       F.count_if((F.col(d) < F.col(lo)) | (F.col(d) > F.col(hi))), "WARNING")])


def check_chronology(projects: DataFrame, progress: DataFrame) -> DataFrame:
    before = lambda a, b: F.count_if(F.col(a) < F.col(b))
    mk = lambda n, a, b: Check("Temporal Chronology", n, "0 chronological violations", before(a, b))
    own = run_checks(projects, "projects", [
        mk("Sanction Date >= Recommendation Date", "sanction_date", "recommendation_date"),
        mk("Work Order Date >= Sanction Date", "work_order_date", "sanction_date"),
        mk("Actual Completion Date >= Work Order Date", "actual_completion_date", "work_order_date"),
        mk("Expected Completion Date >= Work Order Date", "expected_completion_date", "work_order_date")])
    insp = progress.filter("inspection_date is not null").select("project_id", "inspection_date").join(
        projects.select("project_id", "recommendation_date"), "project_id")
    return own.unionByName(run_checks(insp, "progress", [
        mk("Inspection Date >= Project Recommendation Date", "inspection_date", "recommendation_date")]))


def check_derived(fin: DataFrame) -> DataFrame:
    r, e, s = F.col("released_amount"), F.col("expenditure_amount"), F.col("sanctioned_amount")
    util = F.round(F.try_divide(e.cast("double"), r.cast("double")) * 100, 2)
    mk = lambda n, exp, c: Check("Financial Consistency", n, exp, F.count_if(c))
    return run_checks(fin, "financials", [
        mk("Unspent Balance Calculation (Released - Expenditure)", "0 calculation mismatches", F.col("unspent_balance") != r - e),
        mk("Utilization Rate Percentage Formula Match", "0 formula discrepancies", (r > 0) & (F.abs(F.col("utilization_rate_pct") - util) > 0.05)),
        mk("Cost Overrun Flagged when Expenditure > Sanctioned", "0 unflagged overruns", (e > s) & (F.col("cost_overrun_amount") <= 0))])


def check_domain(df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """Row rules that must hold; NULL counts as holding."""
    return run_checks(df, name, [Check("Boundary Values", n, "0 violations", F.count_if(~c)) for n, c in rules.items()])


def check_required(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    return run_checks(df, name, [Check("Required Fields", f"Required columns non-null in {name}", "0 rows with a missing required value",
                                       F.count_if(X.any_of([F.col(c).isNull() for c in cols])))])


def check_completeness(stored: DataFrame, source: DataFrame, key: str, name: str, code: str | None = None) -> DataFrame:
    """Keys missing from or extra to the stored table, and codes that differ."""
    tag = lambda d, side: d.select(key, *([F.col(code).alias(f"__c{side}")] if code else []), F.lit(1).alias(side))
    both = tag(stored, "__db").join(tag(source, "__src"), key, "full")
    checks = [Check("Completeness", "Source ids missing from store", "0 missing", F.count_if(F.col("__db").isNull())),
              Check("Completeness", "Stored ids not in source", "0 extra", F.count_if(F.col("__src").isNull()))]
    if code:
        checks.append(Check("Completeness", "Code matches source", "0 mismatches", F.count_if(F.col("__c__db") != F.col("__c__src"))))
    return run_checks(both, name, checks)


def check_null_counts(df: DataFrame, name: str, expected: dict[str, int]) -> DataFrame:
    return run_checks(df, name, [Check("Data Preservation", f"NULL count of {c}", f"{n} records NULL",
                                       F.abs(F.count_if(F.col(c).isNull()) - n)) for c, n in expected.items()])


def check_non_negative_all(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Negative amounts over several tables in one result row per table."""
    return union_results([run_checks(df, n, [Check("Financial Domain", "Non-negative outlays", "0 negative amounts",
                                                   F.count_if(X.any_of([F.coalesce(F.col(c) < 0, F.lit(False)) for c in cols])))])
                          for n, (df, cols) in tables.items()])


def check_text_hygiene(df: DataFrame, name: str) -> DataFrame:
    out = []
    for c in _strings(df):
        out += [Check("Text Hygiene", f"Padding in '{c}'", "No leading/trailing spaces", F.count_if(F.col(c) != F.trim(F.col(c))), "WARNING"),
                Check("Text Hygiene", f"Double spaces in '{c}'", "No double spaces", F.count_if(F.col(c).contains("  ")), "WARNING")]
    return run_checks(df, name, out)


def check_views(views: dict[str, DataFrame], sums: dict[str, str]) -> DataFrame:
    """Row count of each view and the sum of one of its columns."""
    return union_results([v.agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum(sums[n]).cast("double"), 2).alias("column_sum"))
                          .select(F.lit(n).alias("view"), "row_count", "column_sum",
                                  F.when(F.col("row_count") > 0, "PASS").otherwise("FAIL").alias("status"))
                          for n, v in views.items()])


def quality_report(results: DataFrame) -> DataFrame:
    """Pass, warning and fail counts with the pass rate."""
    st = F.col("status")
    return results.agg(F.count(F.lit(1)).alias("checks"), *[F.count_if(st == s).alias(s.lower()) for s in ("PASS", "WARNING", "FAIL")],
                       F.sum("affected_records").alias("affected_records")).withColumn("pass_rate_pct", X.safe_pct("pass", "checks"))


def audit_cleaning(const: DataFrame, relief: DataFrame) -> DataFrame:
    """Effects of cleaning, actually tested on the cleaned tables."""
    cap, key = F.upper("raw_caption"), F.col("canonical_state_key")
    marked = X.reservation_category("raw_caption")
    seats = run_checks(const, "constituencies", [
        Check("Applied Cleaning", "Constituency Reservation Extraction", "category equals caption marker", F.count_if(marked != F.col("reservation_category"))),
        Check("Applied Cleaning", "Reservation marker removed from name", "no marker left", F.count_if(F.col("constituency_name").rlike(r"\((SC|ST)\)"))),
        Check("Applied Cleaning", "Constituency Raw Caption Preservation", "caption kept", F.count_if(cap.isNull() | (cap == ""))),
        Check("Applied Cleaning", "Canonical State Slug Generation", "key is canonical", F.count_if(key != X.canonical_key(key)))])
    people = run_checks(relief, "calamity_relief", [
        Check("Applied Cleaning", "Honorific Extraction in Calamity Relief", "no honorific left in name",
              F.count_if(F.col("mp_name").rlike(r"(?i)^(shri|smt|dr)\s")))])
    return seats.unionByName(people)
