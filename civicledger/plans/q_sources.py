"""Scan, sink, provenance and cleaning queries."""
import pandas as pd
from pyspark.sql import functions as F, types as T

from civicledger.functions import columns as X
from civicledger.operators import clean as B, features as H
from civicledger.plans import q_features as QF
from civicledger.plans.oracle_tables import sql
from civicledger.plans.registry import query
from civicledger.schemas import TABLES
from civicledger.sources import provenance as P, readers as R, sinks as S


# ---- A: scans and sinks ---------------------------------------------------------------------

@query("a1_typed_csv_scan", sql("SELECT constituency_id, state_id, state_name, constituency_name, raw_caption, reservation_category, canonical_state_key FROM constituencies", "constituencies"))
def _(t):
    root = S.work_dir(t.spark, "csv")
    t["constituencies"].write.option("header", True).csv(f"{root}/{TABLES['constituencies'].file}")
    return R.read_table(t.spark, "constituencies", [root + "/missing", root])


@query("a2_json_records", sql("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS amount FROM orders UNION ALL SELECT -o_orderkey - 1, 'copy', NULL FROM orders"))
def _(t):
    path = S.work_dir(t.spark, "json")
    rec = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    twin = F.struct((-F.col("o_orderkey") - 1).alias("id"), F.lit("copy").alias("status"), F.lit(None).cast("double").alias("amount"))
    t["orders"].select(F.to_json(F.array(rec, twin))).write.text(path)
    return R.read_json_records(t.spark, path, "id bigint, status string, amount double", multi_line=False)


def array_files(d):
    """Lines that make each partition's file one JSON array."""
    def lines(batches):
        lead = "["
        for pdf in batches:
            yield pd.DataFrame({"value": [("," if k else lead) + v for k, v in enumerate(pdf["value"])]})
            lead = "," if len(pdf) else lead
        yield pd.DataFrame({"value": ["[]" if lead == "[" else "]"]})
    return d.select("value").mapInPandas(lines, "value string")


@query("a2_large_array", sql("""SELECT doc_id AS id, md5(text || chr(92)) AS digest, '}],"' AS tag, n_chars AS chars FROM documents"""))
def _(t):
    path = S.work_dir(t.spark, "json-array")
    rec = F.struct(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.struct(F.lit('}],"').alias("tag"), F.col("n_chars").alias("chars")).alias("meta"))
    array_files(t["documents"].select(F.to_json(rec).alias("value"))).write.text(path)
    d = R.read_json_array(t.spark, path, "id bigint, body string, meta struct<tag: string, chars: bigint>")
    return d.select("id", F.md5(F.concat("body", F.lit("\\"))).alias("digest"), "meta.tag", "meta.chars")


@query("a3_nested_map_rows", sql("SELECT state_id, upper(state_name[1]) || lower(state_name[2:]) AS state_name, constituency_id, raw_caption FROM constituencies", "constituencies"))
def _(t):
    seats = t["constituencies"].groupBy("state_name", "state_id").agg(
        F.collect_list(F.struct(F.col("constituency_id").alias("ID"), F.col("raw_caption").alias("CAPTION"))).alias("constituencies"))
    doc = F.create_map(F.lower("state_name"), F.struct("state_id", "constituencies"))
    return R.flatten_nested_map(seats.select(F.to_json(doc).alias("j")), "j")


@query("a4_metric_tiles", sql("""SELECT 'Balance' AS metric_key, NULL::DOUBLE AS count_works, c_acctbal AS amount_inr, round(c_acctbal + 1, 2) AS amount_crores FROM customer
  UNION ALL SELECT 'Works', c_nationkey::DOUBLE, c_acctbal, round(c_acctbal + 1, 2) FROM customer"""))
def _(t):
    inr = F.concat(F.lit(" "), F.format_string("%,.2f", "c_acctbal"))
    cr = F.concat(F.lit(" "), F.format_string("%,.2f", F.col("c_acctbal") + 1), F.lit(" Crore"))
    doc = F.create_map(F.lit("Balance"), F.array(inr, cr), F.lit("Works"), F.array(F.col("c_nationkey").cast("string"), inr, cr),
                       F.lit("Current Tenure"), F.array(F.lit("x")))
    out = R.flatten_metric_tiles(t["customer"].select(F.to_json(doc).alias("j")), "j")
    return out.withColumns({"amount_inr": F.round("amount_inr", 2), "amount_crores": F.round("amount_crores", 2)})


def _relief(t):
    """One embedded JSON string per order: an item and a footer."""
    rows = F.array(F.struct(F.col("o_orderkey").alias("Sno"), F.col("o_totalprice").alias("Amt"), F.lit(None).cast("double").alias("Total_Amt")),
                   F.struct(F.lit(None).cast("bigint").alias("Sno"), F.lit(None).cast("double").alias("Amt"), F.col("o_totalprice").alias("Total_Amt")))
    doc = t["orders"].select(F.to_json(F.struct(F.to_json(rows).alias("payload"))).alias("j"))
    inner = doc.select(F.get_json_object("j", "$.payload").alias("payload"))
    return R.parse_embedded_json(inner, "payload", "struct<Sno:bigint,Amt:double,Total_Amt:double>")


@query("a5_embedded_json_items", sql('SELECT o_orderkey AS "Sno", o_totalprice AS "Amt" FROM orders'))
def _(t):
    return _relief(t)[0].select("Sno", "Amt")


@query("a5_embedded_json_footers", sql('SELECT count(*) AS footers, round(sum(o_totalprice), 2) AS total FROM orders'))
def _(t):
    return _relief(t)[1].agg(F.count(F.lit(1)).alias("footers"), F.round(F.sum(F.col("Total_Amt").cast("decimal(14,2)")), 2).alias("total"))


@query("a6_dual_write_features", sql(f"SELECT project_id, {QF.DEV}, round_even({QF.E} - {QF.S}, 2) AS cost_deviation FROM financials", "financials"))
def _(t):
    path = S.work_dir(t.spark, "features")
    fin = t["financials"]
    S.write_table(S.derived_only(H.cost_deviation(fin, QF.CFG), fin), path)
    return t.spark.read.parquet(path + "/parquet")


UPSERT_SQL = """WITH i AS (SELECT s_suppkey * 20 AS k, s_acctbal AS bal, s_name AS nm FROM supplier)
  SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN nm ELSE c_name END AS c_name, c_nationkey, CASE WHEN k IS NULL THEN c_acctbal ELSE bal END AS c_acctbal, c_mktsegment
  FROM customer FULL JOIN i ON c_custkey = k"""


@query("a7_upsert", sql(UPSERT_SQL))
def _(t):
    inc = t["supplier"].select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.col("s_name").alias("c_name"))
    return S.upsert(t["customer"], inc, ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@query("a7_upsert_do_nothing", sql("""SELECT coalesce(c_custkey, s_suppkey * 20) AS c_custkey, CASE WHEN c_custkey IS NULL THEN s_acctbal ELSE c_acctbal END AS c_acctbal
  FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20"""))
def _(t):
    inc = t["supplier"].select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return S.upsert(t["customer"].select("c_custkey", "c_acctbal"), inc, ["c_custkey"], [])


@query("a8_load_in_order", sql("""SELECT 'constituencies' AS table_name, count(*) AS stored_rows FROM constituencies UNION ALL SELECT 'financials', count(*) FROM financials UNION ALL SELECT 'projects', count(*) FROM projects
  UNION ALL SELECT 'states', count(*) FROM states""", "constituencies", "financials", "projects"))
def _(t):
    root, names = S.work_dir(t.spark, "load"), ["financials", "projects", "constituencies", "states"]
    half = {n: t[n].filter(F.pmod(F.hash(F.col(TABLES[n].pk[0])), F.lit(2)) == 0) for n in names}
    S.load_all(t.spark, half, root, "v1")
    S.load_all(t.spark, {n: t[n] for n in names}, root, "v2")
    out = None
    for n in names:
        c = t.spark.read.parquet(f"{root}/{n}/v2").agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("stored_rows"))
        out = c if out is None else out.unionByName(c)
    return out


@query("a9_full_refresh", sql("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"))
def _(t):
    path = S.work_dir(t.spark, "refresh")
    S.overwrite_table(t["supplier"], path, t["supplier"].count())
    return t.spark.read.parquet(path)


@query("a10_provenance_manifest")
def _(t):
    return P.provenance_manifest(t.spark, t.sf_dir, "test data", "*.parquet").drop("recorded_at", "path")


@query("a11_immutability_audit")
def _(t):
    now = P.provenance_manifest(t.spark, t.sf_dir, "test data", "*.parquet").drop("path")
    log = now.withColumn("sha256", F.when(F.col("file_name") == "orders.parquet", F.reverse("sha256")).otherwise(F.col("sha256")))
    return P.audit_hashes(now, log)


def written_files(t):
    """One text file for each order priority, a line per order, and their manifest."""
    root = S.work_dir(t.spark, "feeds")
    o = t["orders"].select(F.col("o_orderpriority").alias("feed"), F.concat_ws(";", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"), "o_orderkey")
    o.repartition("feed").sortWithinPartitions("feed", "o_orderkey").select("feed", "value").write.partitionBy("feed").text(root)
    return P.provenance_manifest(t.spark, root, "orders", "*.txt").withColumn("feed", F.url_decode(F.regexp_extract("path", "feed=([^/]+)/", 1)))


FEED = """SELECT o_orderpriority AS feed, sum(length(line)) + count(*) AS size_bytes, sha256(string_agg(line, chr(10) ORDER BY o_orderkey) || chr(10)) AS sha256
  FROM (SELECT *, o_orderkey || ';' || o_custkey || ';' || o_orderstatus AS line FROM orders) GROUP BY 1"""


@query("a10_written_files", sql(f"SELECT feed, size_bytes::BIGINT AS size_bytes, sha256, 'orders' AS source FROM ({FEED})"))
def _(t):
    return written_files(t).select("feed", "size_bytes", "sha256", "source")


@query("a11_changed_files", sql(f"SELECT feed, sha256, CASE WHEN feed LIKE '%HIGH' THEN 'FAIL' ELSE 'PASS' END AS status FROM ({FEED})"))
def _(t):
    now = written_files(t).select(F.col("feed").alias("file_name"), "sha256")
    log = now.withColumn("sha256", F.when(F.col("file_name").endswith("HIGH"), F.reverse("sha256")).otherwise(F.col("sha256")))
    return P.audit_hashes(now, log).withColumnRenamed("file_name", "feed")


@query("a12_shape_audit", sql("""SELECT 'customer' AS dataset, 1500 AS expected_rows, count(*) AS actual_rows, 5 AS expected_columns, 5 AS actual_columns, CASE WHEN count(*) = 1500 THEN 'PASS' ELSE 'FAIL' END AS status FROM customer
  UNION ALL SELECT 'supplier', 100, count(*), 3, 4, 'FAIL' FROM supplier"""))
def _(t):
    return P.audit_shapes({"customer": t["customer"], "supplier": t["supplier"]}, {"customer": (1500, 5), "supplier": (100, 3)})


@query("a13_feature_contract", sql(f"""WITH {QF.BENCH}, f AS (SELECT {QF.DELAY} AS delay_days, (CASE WHEN {QF.R} > 0 THEN {QF.UR} ELSE {QF.US} END)::DOUBLE AS utilization_ratio, round_even(m, 2) AS cost_per_category,
    round_even({QF.PLAN} - {QF.PHY}, 2)::DOUBLE AS progress_gap, round_even({QF.E} - {QF.S}, 2) AS cost_deviation, coalesce({QF._pos(f'coalesce(actual_completion_date, {QF.REF})', QF.START)}, 0) AS project_duration,
    {QF._pos('expected_completion_date', QF.START)} AS planned_duration_days FROM joined JOIN b USING (project_id) JOIN s ON b.sector = s.sector)
  SELECT 'delay_days' AS feature, count(*) FILTER (delay_days NOT BETWEEN -365 AND 1825) AS out_of_range, count(*) - count(delay_days) AS missing FROM f
  UNION ALL SELECT 'utilization_ratio', count(*) FILTER (utilization_ratio NOT BETWEEN 0 AND 2), count(*) - count(utilization_ratio) FROM f
  UNION ALL SELECT 'cost_per_category', count(*) FILTER (cost_per_category NOT BETWEEN 10000 AND 50000000), 0 FROM f UNION ALL SELECT 'progress_gap', count(*) FILTER (progress_gap NOT BETWEEN -100 AND 100), 0 FROM f
  UNION ALL SELECT 'cost_deviation', count(*) FILTER (cost_deviation NOT BETWEEN -50000000 AND 50000000), 0 FROM f UNION ALL SELECT 'project_duration', count(*) FILTER (project_duration NOT BETWEEN 1 AND 3650), 0 FROM f
  UNION ALL SELECT 'planned_duration_days', count(*) FILTER (planned_duration_days NOT BETWEEN 15 AND 1825), count(*) - count(planned_duration_days) FROM f""", "joined"))
def _(t):
    names = ["delay_days", "utilization_ratio", "cost_per_category", "progress_gap", "cost_deviation", "project_duration", "planned_duration_days"]
    df = H.feature_pipeline(H.load_joined(t), QF.CFG).select(*names)
    return P.check_feature_contract(df).select("feature", "out_of_range", "missing")


# ---- B: cleaning ------------------------------------------------------------------------------

@query("b1_exact_duplicates", sql("SELECT count(*) - count(DISTINCT (text, lang)) AS n_removed, count(DISTINCT (text, lang)) AS n_kept FROM documents"))
def _(t):
    return B.dedupe_exact(t["documents"].select("text", "lang"))[1]


WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("b2_clean_text", sql(f"SELECT doc_id, md5(c) AS digest, length(c) AS chars FROM (SELECT doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS c FROM documents)"))
def _(t):
    c = X.clean_text("text")
    return t["documents"].select("doc_id", F.md5(c).alias("digest"), F.length(c).alias("chars"))


@query("b3_title_case", sql("SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name || ' o''neil x-y', ' ')], ' ') AS title FROM part"))
def _(t):
    return t["part"].select("p_partkey", X.title_case(F.concat(F.lit("  "), F.upper("p_name"), F.lit("   O'NEIL  x-Y "))).alias("title"))


def _amount_text():
    k = F.col("o_orderkey")
    lead = F.element_at(F.array(*[F.lit(x) for x in (" ₹ ", "Rs. ", "INR ", " ", "-")]), (k % 5 + 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(x) for x in (" Crore", " lakhs", "")]), (k % 3 + 1).cast("int"))
    return F.when(k % 29 == 0, F.lit("-")).when(k % 31 == 0, F.lit("")).otherwise(F.concat(lead, F.format_string("%,.2f", "o_totalprice"), tail))


@query("b4_parse_currency", sql("SELECT o_orderkey, CASE WHEN o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0 THEN CASE WHEN o_orderkey % 5 = 4 THEN -o_totalprice WHEN o_orderkey % 5 = 1 THEN o_totalprice ELSE o_totalprice END END AS amount FROM orders"))
def _(t):
    return t["orders"].select("o_orderkey", X.parse_currency(_amount_text()).alias("amount"))


@query("b5_parse_currency_unsigned", sql("SELECT o_orderkey, (CASE WHEN o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0 THEN o_totalprice ELSE 0 END)::DOUBLE AS amount FROM orders"))
def _(t):
    return t["orders"].select("o_orderkey", X.parse_currency(_amount_text(), blank_as_zero=True).alias("amount"))


@query("b6_iso_dates", sql("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN 'sometime' WHEN 4 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders"""))
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (F.when(k % 5 == 0, F.date_format(d, "dd-MMM-yyyy")).when(k % 5 == 1, F.date_format(d, "MMM d, yyyy hh:mm:ss a"))
            .when(k % 5 == 2, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 3, "sometime").otherwise("  "))
    return t["orders"].select(k, X.to_iso_date(text).alias("iso"))


@query("b7_safe_dates", sql("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN strftime((date_trunc('second', ts) + INTERVAL 330 MINUTE), '%Y-%m-%d') WHEN 5 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events"""))
def _(t):
    k, ts = F.col("event_id"), F.col("ts")
    f = lambda p: F.date_format(ts, p)
    text = (F.when(k % 7 == 0, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k % 7 == 1, f("dd/MM/yyyy")).when(k % 7 == 2, f("yyyy-MM-dd HH:mm:ss"))
            .when(k % 7 == 3, f("dd-MMM-yyyy")).when(k % 7 == 4, f("yyyy/MM/dd")).when(k % 7 == 5, "N/A").otherwise(f("dd-MM-yyyy")))
    return t["events"].select(k, X.parse_date_safe(text).alias("day"))


@query("b8_canonical_keys", sql("SELECT p_partkey, lower(p_name) || ' and co' AS key FROM part"))
def _(t):
    return t["part"].select("p_partkey", X.canonical_key(F.concat(F.lit(" The  "), F.upper("p_name"), F.lit("  & Co "))).alias("key"))


@query("b9_keyword_class", sql("SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%widget%' THEN 'yes' ELSE 'no' END AS label FROM part"))
def _(t):
    return t["part"].select("p_partkey", X.classify_by_keywords(F.upper("p_name"), ["ring", "widget"], "yes", "no").alias("label"))


@query("b10_reservation", sql("SELECT constituency_id, reservation_category, constituency_name FROM constituencies", "constituencies"))
def _(t):
    return t["constituencies"].select("constituency_id", X.reservation_category("raw_caption").alias("reservation_category"), X.seat_name("raw_caption").alias("constituency_name"))


@query("b11_honorific", sql("""SELECT s_no, CASE s_no % 4 WHEN 0 THEN 'Shri' WHEN 1 THEN 'Smt' WHEN 2 THEN 'Dr' ELSE '' END AS honorific, c_name AS mp_name FROM calamity JOIN customer ON c_custkey = s_no""", "calamity"))
def _(t):
    return t["calamity"].withColumn("n", X.split_honorific("raw_name")).select("s_no", "n.honorific", "n.mp_name")


@query("b12_house_label", sql("SELECT s_no, CASE WHEN house_code = 2 THEN 'Lok Sabha' ELSE 'Rajya Sabha' END AS house FROM calamity", "calamity"))
def _(t):
    return t["calamity"].select("s_no", X.map_house("house_code").alias("house"))


@query("b13_unit_scaling", sql("SELECT project_id, round(released_amount::DOUBLE / 1e5, 2) AS lakh, round(released_amount::DOUBLE / 1e7, 2) AS crore FROM financials", "financials"))
def _(t):
    return t["financials"].select("project_id", X.to_lakh("released_amount").alias("lakh"), X.to_crore("released_amount").alias("crore"))


@query("b14_fiscal_year_split", sql("SELECT project_id, CAST(financial_year[:4] AS BIGINT) AS start_year, CAST(financial_year[:4] AS BIGINT) + 1 AS end_year FROM projects", "projects"))
def _(t):
    return t["projects"].withColumn("f", X.fiscal_year_part("financial_year")).select("project_id", "f.start_year", "f.end_year")


@query("b15_budget_variance", sql("SELECT financial_year, be_vs_actual_variance_cr::DOUBLE AS variance FROM union_budget", "union_budget"))
def _(t):
    return t["union_budget"].select("financial_year", X.variance("actual_expenditure_cr", "budget_estimate_cr").alias("variance"))


@query("b16_safe_rates", sql("SELECT project_id, CASE WHEN released_amount > 0 THEN round(expenditure_amount::DOUBLE / released_amount::DOUBLE * 100, 2) ELSE 0.0 END::DOUBLE AS utilization FROM financials", "financials"))
def _(t):
    return t["financials"].select("project_id", X.safe_pct("expenditure_amount", "released_amount").alias("utilization"))


@query("b17_logic_flags", sql("""SELECT state_id, utilization_rate_pct, sanction_rate_pct, completion_rate_pct, utilization_rate_pct BETWEEN 0 AND 100 AS is_utilization_valid,
  works_completed <= works_sanctioned AND works_sanctioned <= works_recommended AS is_workflow_valid FROM parliament_qa""", "parliament_qa"))
def _(t):
    return B.add_rates(t["qa_raw"]).select("state_id", "utilization_rate_pct", "sanction_rate_pct", "completion_rate_pct", "is_utilization_valid", "is_workflow_valid")


@query("b18_footer_reconciliation", sql("SELECT count(*) AS n_items, round(sum(o_totalprice), 2) AS computed_total, round(sum(o_totalprice), 2) AS reported_total, true AS reconciled FROM orders"))
def _(t):
    items, footer = _relief(t)
    money = lambda d, c: d.withColumn(c, F.col(c).cast("decimal(14,2)"))
    return B.reconcile_total(money(items, "Amt"), money(footer, "Total_Amt"), "Amt", "Total_Amt")


@query("b19_master_dimension", sql("""SELECT state_id, state_name, category, total_lok_sabha_seats, general_seats, sc_reserved_seats, st_reserved_seats, sc_seat_share_pct, st_seat_share_pct,
  cumulative_released_cr::DOUBLE AS cumulative_released_cr, cumulative_expenditure_cr::DOUBLE AS cumulative_expenditure_cr, utilization_pct, works_completed_count FROM master_dim""", "master_dim"))
def _(t):
    return B.build_master_dim(t["states"], t["constituencies"], t["parliament_qa"]).drop(
        "canonical_state_key", "statutory_sc_allocation_pct", "statutory_st_allocation_pct", "unspent_balance_cr")


@query("b20_type_sanitizing", sql("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 3475 ELSE o_orderkey END AS major_head,
  CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 2 = 0 AS flag FROM orders"""))
def _(t):
    k = F.col("o_orderkey")
    text = t["orders"].select(
        k.cast("string").alias("id"), F.when(k % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        F.when(k % 3 == 0, " ").otherwise(k.cast("string")).alias("major_head"),
        F.when(k % 5 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), (k % 2 == 0).cast("string").alias("flag"))
    schema = T.StructType.fromDDL("id bigint, amount double, major_head bigint, day date, flag boolean")
    return B.sanitize_types(text, schema, {"major_head": 3475})


@query("b21_expectations", sql("""SELECT 'nations' AS rule, 25.0::DOUBLE AS expected, count(*)::DOUBLE AS actual, count(*) = 25 AS passed FROM nation UNION ALL
  SELECT 'asian', 8.0, count(*) FILTER (n_regionkey = 2), count(*) FILTER (n_regionkey = 2) = 8 FROM nation"""))
def _(t):
    return B.expectation_report(t["nation"], {"nations": (F.count(F.lit(1)), 25), "asian": (F.count_if(F.col("n_regionkey") == 2), 8)})
