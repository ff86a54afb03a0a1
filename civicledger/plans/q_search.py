"""Listing, search and lookup queries."""
from pyspark.sql import functions as F

from civicledger import fixed_values as fv
from civicledger.operators import analyzers as A, postings as P, search as S
from civicledger.plans.oracle_tables import CTES, sql
from civicledger.plans.q_views import MISSING_SQL
from civicledger.plans.registry import query

LIST = """SELECT p.project_id, project_code, project_title, sector, s.state_name, district_name, mp_name, current_status, financial_year, sanctioned_amount::DOUBLE AS sanctioned_amount, expenditure_amount::DOUBLE AS expenditure_amount,
  physical_progress_pct, coalesce(days_delayed, 0) AS days_delayed, overall_risk_score, risk_level, recommendation_date FROM projects p JOIN states s ON p.state_id = s.state_id LEFT JOIN financials f ON p.project_id = f.project_id
  LEFT JOIN latest_progress g ON p.project_id = g.project_id LEFT JOIN risk_scores r ON p.project_id = r.project_id"""
LT = ("projects", "states", "financials", "latest_progress", "risk_scores")
COLS = "project_id project_code project_title sector state_name district_name mp_name current_status financial_year sanctioned_amount expenditure_amount physical_progress_pct days_delayed overall_risk_score risk_level".split()
FILTERS = dict(district="build", house="Lok Sabha", agency="supplier", min_sanctioned=50000, max_sanctioned=400000, delayed_only=True, min_risk=20.0)
WHERE = """district_name ILIKE '%build%' AND house_of_parliament = 'Lok Sabha' AND implementing_agency ILIKE '%supplier%' AND sanctioned_amount BETWEEN 50000 AND 400000
  AND (days_delayed > 0 OR milestone_status IN ('Delayed','Critical') OR current_status = 'Stalled') AND overall_risk_score >= 20"""


@query("g1_project_list", sql(f"SELECT * EXCLUDE (recommendation_date) FROM ({LIST} WHERE {WHERE})", *LT))
def _(t):
    return S.list_projects(t, **FILTERS).select(*COLS)


@query("g2_sorted_list", sql(f"SELECT * EXCLUDE (recommendation_date) FROM ({LIST} WHERE sector = 'HIGH') ORDER BY overall_risk_score ASC NULLS LAST, project_id LIMIT 40", *LT))
def _(t):
    return S.list_projects(t, sector="HIGH").select(*COLS).orderBy(*S.sort_order("overall_risk_score", "asc")).limit(40)


@query("g3_page", sql(f"SELECT project_id, project_title, n AS total, ceil(n / 25)::BIGINT AS pages FROM ({LIST} WHERE financial_year = '1997-98'), (SELECT count(*) AS n FROM projects JOIN states USING (state_id) WHERE financial_year = '1997-98') ORDER BY recommendation_date DESC, project_id LIMIT 25 OFFSET 50", *LT))
def _(t):
    d = S.list_projects(t, financial_year="1997-98").select(*COLS, "recommendation_date")
    return S.paginate(d, S.sort_order(), page=3, size=25).select("project_id", "project_title", "total", "pages")


STOP = ", ".join(f"'{w}'" for w in fv.STOP_WORDS)
STEM = ("CASE WHEN regexp_matches(w, '\\pL{3}ings$') THEN w[:-5] WHEN regexp_matches(w, '\\pL{3}edly$') THEN w[:-5] WHEN regexp_matches(w, '\\pL{3}ing$') THEN w[:-4] "
        "WHEN regexp_matches(w, '\\pL{3}ed$') THEN w[:-3] WHEN regexp_matches(w, '\\pL{3}es$') THEN w[:-3] WHEN regexp_matches(w, '\\pL{3}s$') THEN w[:-2] ELSE w END")
TOK = f"[{STEM} FOR w IN string_split_regex(lower(%s), '[^\\pL\\pN]+') IF w <> '' AND w NOT IN ({STOP})]"
DOC = "coalesce(project_title,'') || ' ' || coalesce(project_description,'') || ' ' || coalesce(sector,'') || ' ' || coalesce(sub_sector,'') || ' ' || coalesce(district_name,'') || ' ' || coalesce(implementing_agency,'') || ' ' || coalesce(mp_name,'')"
CTES["dtok"] = ((), f"SELECT doc_id, {TOK % 'text'} AS tk FROM documents")


@query("g4_search_tokens", sql("SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS digest FROM dtok", "dtok"))
def _(t):
    tk = S.search_tokens(F.col("text"))
    return t["documents"].select("doc_id", F.size(tk).alias("n_tokens"), F.md5(F.array_join(tk, " ")).alias("digest"))


def _choose(rules: dict[str, list]) -> str:
    """CASE expression over column w for one step."""
    whens = []
    for suffix, ways in sorted(rules.items(), key=lambda r: -len(r[0])):
        stem, inner = f"left(w, length(w) - {len(suffix)})", ""
        for region, pattern, new in ways:
            conds = [f"length(w) - {len(suffix)} >= r{region}"] if region else []
            if pattern:
                conds.append(("NOT " if pattern[0] == "!" else "") + f"regexp_matches({stem}, '{pattern.lstrip('!')}')")
            inner += f" WHEN {' AND '.join(conds) or 'TRUE'} THEN {stem} || '{new}'"
        whens.append(f"WHEN w LIKE '%{suffix}' THEN " + (f"CASE{inner} ELSE w END" if inner else "w"))
    return f"CASE {' '.join(whens)} ELSE w END"


def stem_steps() -> list[dict[str, str]]:
    """The English stemmer as steps of column assignments; w is the word, ``was`` its unchanged form."""
    vc = "^.*?[aeiouy][^aeiouy]"
    whole = " ".join(f"WHEN was = '{a}' THEN '{b}'" for a, b in fv.ENGLISH_WHOLE_WORDS.items())
    left = ", ".join(f"'{w}'" for w in fv.ENGLISH_LEFT_AFTER_PLURALS)
    long = " ".join(f"WHEN w LIKE '{p}%' THEN {len(p)}" for p in fv.ENGLISH_LONG_PREFIXES)
    keep_left = lambda x: f"CASE WHEN held THEN w ELSE {x} END"
    cut = " OR ".join(f"was1 LIKE '%{s}'" for s in ("ed", "edly", "ing", "ingly"))
    match = lambda s: f"length(regexp_extract({s}, '{vc}', 0))"
    return [
        {"w": "regexp_replace(regexp_replace(was, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"},
        {"r1": f"CASE {long} WHEN {match('w')} > 0 THEN {match('w')} ELSE length(w) END"},
        {"r2": f"CASE WHEN {match('substr(w, r1 + 1)')} > 0 THEN r1 + {match('substr(w, r1 + 1)')} ELSE length(w) END"},
        {"w": _choose(fv.ENGLISH_PLURALS)},
        {"held": f"w IN ({left})", "was1": "w"},
        {"w": keep_left(_choose(fv.ENGLISH_PAST))},
        # only a removed ending is repaired: eed and eedly are other suffixes
        {"w": f"CASE WHEN held OR w = was1 OR NOT ({cut}) OR was1 LIKE '%eed' OR was1 LIKE '%eedly' THEN w "
              f"WHEN regexp_matches(w, '(at|bl|iz|bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {_choose(fv.ENGLISH_AFTER_PAST)} "
              f"WHEN r1 >= length(w) AND regexp_matches(w, '{fv.ENGLISH_SHORT_SYLLABLE}') THEN w || 'e' ELSE w END"},
        {"w": keep_left(_choose(fv.ENGLISH_FINAL_Y))},
        {"w": keep_left(_choose(fv.ENGLISH_DERIVED))},
        {"w": keep_left(_choose(fv.ENGLISH_SECOND_DERIVED))},
        {"w": keep_left(_choose(fv.ENGLISH_REMOVED))},
        {"w": keep_left(_choose(fv.ENGLISH_FINAL_E))},
        {"w": f"CASE WHEN length(was) <= 2 THEN was {whole} ELSE replace(w, 'Y', 'y') END"},
    ]


def stem_sql(words: str) -> str:
    """CTEs that stem column ``was`` of relation ``words``; the last one is ``stemmed``, its stem column w."""
    have, ctes, last = set(), [], words
    for k, assign in enumerate(stem_steps()):
        old = ", ".join(c for c in assign if c in have)
        ctes.append(f"stem{k} AS MATERIALIZED (SELECT * {f'EXCLUDE ({old})' if old else ''}, {', '.join(f'{e} AS {c}' for c, e in assign.items())} FROM {last})")
        have |= set(assign)
        last = f"stem{k}"
    return ", ".join([*ctes, f"stemmed AS (SELECT * FROM {last})"])


ENGLISH_STOP = ", ".join(f"'{w}'" for w in fv.ENGLISH_STOP_WORDS)
def english_sql(key: str, text: str, table: str) -> str:
    """CTEs with the English words of a table: stemmed(key, pos, was, w)."""
    return f"""split AS (SELECT {key} AS key, [w FOR w IN string_split_regex(lower({text}), '[^\\pL\\pN]+') IF w <> ''] AS ws FROM {table}),
  ew AS (SELECT key, unnest(ws) AS was, unnest(range(len(ws))) AS pos FROM split), kept AS (SELECT * FROM ew WHERE was NOT IN ({ENGLISH_STOP})), {stem_sql('kept')}"""


@query("g4_english_words", sql(f"""WITH {english_sql('doc_id', 'text', 'documents')}
  SELECT key AS doc_id, count(*) AS n_words, md5(string_agg(pos || ':' || w, ' ' ORDER BY pos)) AS digest FROM stemmed GROUP BY 1"""))
def _(t):
    words = A.english_words(t["documents"], "doc_id", F.col("text"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: F.concat(x.pos, F.lit(":"), x.term)), " ")
    return words.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n_words"), F.md5(line).alias("digest"))


def project_words(t, analyzer="light"):
    return t.stored(f"project-words-{analyzer}", lambda path: P.build_words(t["projects"], "project_id", S.search_document(), path, analyzer))


def document_words(t, analyzer="light"):
    return t.stored(f"document-words-{analyzer}", lambda path: P.build_words(t["documents"], "doc_id", F.col("text"), path, analyzer))


@query("g5_full_text_search", sql(f"""WITH x AS (SELECT project_id, project_title, implementing_agency, mp_name, ' ' || array_to_string({TOK % ('(' + DOC + ')')}, ' ') || ' ' AS line FROM projects)
  SELECT project_id FROM x WHERE (contains(line, ' furniture ') AND contains(line, ' public work ') AND NOT contains(line, ' low ')) OR contains(line, ' block 3 ')""", "projects"))
def _(t):
    grams = t.stored("project-blocks", lambda path: P.build_blocks(t["projects"], "project_id", P.identifying_text(), path))
    return P.search_projects(project_words(t), grams, t["projects"], 'furniture "public works" -low OR "block 3"')


@query("g5_substring_search", sql("""SELECT project_id FROM projects WHERE project_title ILIKE '%ery works for customer#00000001%' OR project_code ILIKE '%ery works for customer#00000001%'""", "projects"))
def _(t):
    grams = t.stored("project-blocks", lambda path: P.build_blocks(t["projects"], "project_id", P.identifying_text(), path))
    return P.search_projects(project_words(t), grams, t["projects"], "ery works for Customer#00000001")


@query("g5_document_search", sql("""WITH x AS (SELECT doc_id, ' ' || array_to_string(tk, ' ') || ' ' AS line FROM dtok)
  SELECT doc_id FROM x WHERE contains(line, ' their ') OR (contains(line, ' then ') AND NOT contains(line, ' thea '))""", "dtok"))
def _(t):
    return P.match(t.spark, document_words(t), "their OR then -thea").select(F.col("key").alias("doc_id"))


@query("g5_excluded_only", sql("""WITH x AS (SELECT doc_id, ' ' || array_to_string(tk, ' ') || ' ' AS line FROM dtok)
  SELECT doc_id FROM x WHERE NOT (contains(line, ' then ') OR contains(line, ' que la ')) OR contains(line, ' einheit ')""", "dtok"))
def _(t):
    return P.match(t.spark, document_words(t), '-then -"que la" OR einheit').select(F.col("key").alias("doc_id"))


# every word of a phrase must stand at its own distance; 'of the' between them counts
@query("g5_english_phrases", sql(f"""WITH {english_sql('project_id', DOC, 'projects')}, p AS (SELECT DISTINCT a.key FROM stemmed a JOIN stemmed b ON a.key = b.key AND b.pos = a.pos + 2 WHERE a.w = 'work' AND b.w = 'custom'),
  c AS (SELECT DISTINCT key FROM stemmed WHERE w = 'construct'), n AS (SELECT DISTINCT key FROM stemmed WHERE w = 'furnitur'), s AS (SELECT DISTINCT a.key FROM stemmed a JOIN stemmed b ON a.key = b.key AND b.pos = a.pos + 1 WHERE a.w = 'block' AND b.w = '3')
  SELECT key AS project_id FROM p WHERE key IN (SELECT key FROM c) AND key NOT IN (SELECT key FROM n) UNION SELECT key FROM s""", "projects"))
def _(t):
    return P.match(t.spark, project_words(t, "english"), '"works for customers" constructing -furnitures OR "blocks 3"').select(F.col("key").alias("project_id"))


RANK = """p AS (SELECT doc_id, w, count(*) AS tf FROM (%s) WHERE w IN (%s) GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM p GROUP BY 1)
  SELECT doc_id, round(sum(ln(1 + tf) * ln(1 + (SELECT count(*) FROM documents) / df)), 6) AS relevance FROM p JOIN d USING (w) GROUP BY 1"""


@query("g6_search_rank", sql("WITH " + RANK % ("SELECT doc_id, unnest(tk) AS w FROM dtok", "'then', 'erenth', 'que'"), "dtok"))
def _(t):
    return P.rank(t.spark, document_words(t), "then erenth que").select(F.col("key").alias("doc_id"), "relevance")


@query("g6_english_rank", sql("WITH " + english_sql("doc_id", "text", "documents") + ", " + RANK % ("SELECT key AS doc_id, w FROM stemmed", "'worthless', 'disgust', 'que'")))
def _(t):
    return P.rank(t.spark, document_words(t, "english"), "the worthless and disgusting que").select(F.col("key").alias("doc_id"), "relevance")


TRI = "list_distinct(flatten([[('  ' || w || ' ')[i:i+2] FOR i IN range(1, length(w) + 2)] FOR w IN string_split_regex(lower(%s), '[^\\pL\\pN]+') IF w <> '']))"
FUZZY = f"""WITH x AS (SELECT p_partkey, p_name, {TRI % 'p_name'} AS a, {TRI % "'%s'"} AS b FROM part), y AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(a || b)) AS s FROM x)
  SELECT p_partkey, p_name, round(s, 4) AS similarity FROM y WHERE s > %s OR contains(lower(p_name), '%s')"""


def part_grams(t):
    return t.stored("part-grams", lambda path: P.build_trigrams(t["part"], "p_partkey", F.col("p_name"), path))


@query("g7_trigram_search", sql(FUZZY % ("smal wigdet", "0.3", "smal wigdet")))
def _(t):
    return P.fuzzy_search(part_grams(t), t["part"].select("p_partkey", "p_name"), "p_partkey", "p_name", "smal wigdet")


# a short substring that is far from similar to most names that hold it
@query("g7_substring_matches", sql(FUZZY % ("get", "0.5", "get")))
def _(t):
    return P.fuzzy_search(part_grams(t), t["part"].select("p_partkey", "p_name"), "p_partkey", "p_name", "get", 0.5)


@query("g8_point_lookup", sql("SELECT project_id, project_title, state_name, current_status FROM projects JOIN states USING (state_id) WHERE project_id = 77", "projects", "states"))
def _(t):
    return S.by_id(t, 77).select("project_id", "project_title", "state_name", "current_status")


@query("g8_state_district", sql("SELECT project_id, project_title, sanctioned_amount::DOUBLE AS sanctioned_amount FROM projects JOIN states USING (state_id) LEFT JOIN financials USING (project_id) WHERE state_name = 'NATION_7' AND district_name = 'MACHINERY'", "projects", "states", "financials"))
def _(t):
    return S.by_geo(t, "NATION_7", "MACHINERY").select("project_id", "project_title", "sanctioned_amount")


@query("g8_status_sector", sql("SELECT project_id, sanctioned_amount::DOUBLE AS sanctioned_amount, expenditure_amount::DOUBLE AS expenditure_amount FROM projects LEFT JOIN financials USING (project_id) WHERE current_status = 'Stalled' AND sector = 'URGENT'", "projects", "financials"))
def _(t):
    return S.by_status_sector(t, "Stalled", "URGENT").select("project_id", "sanctioned_amount", "expenditure_amount")


@query("g9_high_expenditure", sql("SELECT project_id, project_title, sector, sanctioned_amount::DOUBLE AS sanctioned_amount, expenditure_amount::DOUBLE AS expenditure_amount, cost_overrun_amount::DOUBLE AS cost_overrun_amount, cost_overrun_pct FROM financials JOIN projects USING (project_id) WHERE expenditure_amount >= 300000 OR cost_overrun_amount > 0", "financials", "projects"))
def _(t):
    return S.high_expenditure(t, 300000).orderBy(F.col("expenditure_amount").desc(), "project_id")


@query("g10_missing_info_text", sql(f"WITH m AS (SELECT project_id, current_status, {MISSING_SQL} AS mf FROM overview) SELECT project_id, current_status, array_to_string(mf, '; ') AS missing_fields_text FROM m WHERE len(mf) > 0", "overview"))
def _(t):
    return S.missing_info_text(t)


@query("g11_lateral_latest", sql("SELECT project_id, project_title, current_status, strftime(reported_date, '%Y-%m-%d') AS reported_date, physical_progress_pct, current_stage FROM projects LEFT JOIN latest_progress USING (project_id)", "projects", "latest_progress"))
def _(t):
    return S.lateral_latest(t["projects"], t["progress"])


@query("g12_high_risk_factors", sql("SELECT project_id, overall_risk_score, r.risk_level, factor_name, factor_weight, factor_impact FROM risk_scores r LEFT JOIN risk_factors f USING (project_id) WHERE overall_risk_score >= 40", "risk_scores", "risk_factors"))
def _(t):
    return S.high_risk_factors(t).orderBy(F.col("overall_risk_score").desc(), "project_id", "factor_name")


@query("g13_project_detail", sql("""SELECT section, count(*) AS records, count(DISTINCT project_id) AS projects FROM (SELECT project_id, '1 header' AS section FROM projects UNION ALL SELECT project_id, '2 finance' FROM financials
  UNION ALL SELECT l_orderkey, '3 progress' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) UNION ALL SELECT project_id, '4 risk' FROM risk_factors UNION ALL SELECT user_id, '5 event' FROM events WHERE user_id IN (SELECT o_orderkey FROM orders)) GROUP BY 1""", "projects", "financials", "risk_factors"))
def _(t):
    return S.project_detail(t).groupBy("section").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("project_id").alias("projects"))


@query("g14_pending_sanctions", sql("""SELECT project_id, project_title, sector, district_name, mp_name, strftime(recommendation_date, '%Y-%m-%d') AS recommendation_date, recommended_amount::DOUBLE AS recommended_amount FROM projects LEFT JOIN financials f USING (project_id)
  WHERE current_status = 'Recommended' ORDER BY projects.recommendation_date, project_id LIMIT 20""", "projects", "financials"))
def _(t):
    return S.pending_sanctions(t)


@query("g15_assigned_works", sql("""SELECT project_id, project_title, implementing_agency, sector, district_name, current_status, sanctioned_amount::DOUBLE AS sanctioned_amount, expenditure_amount::DOUBLE AS expenditure_amount, physical_progress_pct, current_stage, milestone_status
  FROM projects LEFT JOIN financials f USING (project_id) LEFT JOIN latest_progress USING (project_id) WHERE current_status IN ('Sanctioned','In Progress') AND implementing_agency ILIKE '%00000007%' ORDER BY project_id LIMIT 20""", "projects", "financials", "latest_progress"))
def _(t):
    return S.assigned_works(t, "00000007")


@query("g16_citizen_tracker", sql("""SELECT project_id, project_title, sector, district_name, mp_name, current_status, implementing_agency, sanctioned_amount::DOUBLE AS sanctioned_amount, expenditure_amount::DOUBLE AS expenditure_amount, physical_progress_pct
  FROM projects LEFT JOIN financials f USING (project_id) LEFT JOIN latest_progress USING (project_id) WHERE project_code = 'W-321'""", "projects", "financials", "latest_progress"))
def _(t):
    return S.track(t, "W-321")
