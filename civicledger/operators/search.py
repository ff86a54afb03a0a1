"""Project listing, full-text and fuzzy search, lookups and work queues."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from civicledger import fixed_values as fv
from civicledger.functions import columns as X
from civicledger.operators.views import latest_progress, missing_labels, project_overview

TEXT_FIELDS = ["project_title", "project_description", "sector", "sub_sector", "district_name", "implementing_agency", "mp_name"]
SUFFIX = r"(?<=\p{L}{3})(ings|ing|edly|ed|es|s)$"


# ---- list, sort, page ---------------------------------------------------------------------------

def list_projects(t, *, state_id=None, district=None, constituency_id=None, sector=None, status=None, mp_name=None, house=None, agency=None,
                  financial_year=None, min_sanctioned=None, max_sanctioned=None, delayed_only=False, min_risk=None, risk_level=None, q=None) -> DataFrame:
    """Project rows with finance, latest progress and risk under optional filters."""
    p = t["projects"]
    like = lambda c, v: F.contains(F.lower(c), F.lit(v.lower()))
    equal = {"state_id": state_id, "constituency_id": constituency_id, "sector": sector, "current_status": status, "house_of_parliament": house,
             "financial_year": financial_year}
    for col, val in equal.items():
        if val is not None:
            p = p.filter(F.col(col) == val)
    for col, val in (("district_name", district), ("mp_name", mp_name), ("implementing_agency", agency)):
        if val:
            p = p.filter(like(col, val))
    if q and q.strip():
        p = p.filter(search_predicate(q))
    f = t["financials"].select("project_id", "sanctioned_amount", "released_amount", "expenditure_amount")
    g = latest_progress(t["progress"]).select("project_id", "physical_progress_pct", "days_delayed", "milestone_status")
    r = t["risk_scores"].select("project_id", "overall_risk_score", "risk_level")
    df = (p.join(t["states"].select("state_id", "state_name"), "state_id").join(f, "project_id", "left").join(g, "project_id", "left").join(r, "project_id", "left"))
    if min_sanctioned is not None:
        df = df.filter(F.col("sanctioned_amount") >= min_sanctioned)
    if max_sanctioned is not None:
        df = df.filter(F.col("sanctioned_amount") <= max_sanctioned)
    if delayed_only:
        df = df.filter((F.col("days_delayed") > 0) | F.col("milestone_status").isin("Delayed", "Critical") | (F.col("current_status") == "Stalled"))
    if min_risk is not None:
        df = df.filter(F.col("overall_risk_score") >= min_risk)
    if risk_level:
        df = df.filter(F.col("risk_level") == risk_level)
    return df.withColumn("days_delayed", F.coalesce("days_delayed", F.lit(0)))


SORTABLE = {"project_id", "project_code", "project_title", "recommendation_date", "sanctioned_amount", "expenditure_amount", "days_delayed",
            "overall_risk_score", "current_status"}


def sort_order(by: str = "recommendation_date", order: str = "desc") -> list[Column]:
    c = F.col(by if by in SORTABLE else "recommendation_date")
    return [c.asc_nulls_last() if order.lower() == "asc" else c.desc_nulls_first(), F.col("project_id")]


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page with the total and page count; only the page itself is sorted out of the cluster."""
    size, page = max(1, min(100, size)), max(1, page)
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).join(total)


# ---- full text --------------------------------------------------------------------------------------

def _stem(word: str) -> str:
    return re.sub(r"(?<=[^\W\d_]{3})(ings|ing|edly|ed|es|s)$", "", word.lower())


def search_tokens(doc: Column) -> Column:
    """Lower-cased, stop-word free, lightly stemmed tokens of a text column."""
    words = F.filter(F.split(F.lower(doc), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(fv.STOP_WORDS))
    return F.transform(words, lambda w: F.regexp_replace(w, SUFFIX, ""))


def search_document(fields: list[str] = TEXT_FIELDS) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])


def query_terms(q: str) -> list[str]:
    """Positive stemmed words of a query."""
    out = []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', q):
        if not minus and word.lower() != "or":
            out += [_stem(w) for w in re.findall(r"[^\W_]+", phrase or word) if w.lower() not in fv.STOP_WORDS]
    return list(dict.fromkeys(out))


def text_match(tokens: Column, q: str) -> Column:
    """Web-style query: words are all required, OR separates alternatives, quotes keep word order, minus excludes."""
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    alternatives, current = [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', q):
        if not minus and word.lower() == "or":
            alternatives.append(current)
            current = []
            continue
        words = [_stem(w) for w in re.findall(r"[^\W_]+", phrase or word) if w.lower() not in fv.STOP_WORDS]
        if words:
            hit = F.contains(line, F.lit(" " + " ".join(words) + " "))
            current.append(~hit if minus else hit)
    alternatives.append(current)
    parts = [X.all_of(c) for c in alternatives if c]
    return X.any_of(parts) if parts else F.lit(False)


def search_predicate(q: str) -> Column:
    """Full-text match or plain substring in five identifying fields."""
    raw = q.strip().lower()
    sub = X.any_of([F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(raw)), F.lit(False))
                    for c in ("project_id", "project_code", "project_title", "mp_name", "implementing_agency")])
    return text_match(search_tokens(search_document()), q) | sub


def search_rank(df: DataFrame, key: str, text: Column, q: str) -> DataFrame:
    """Documents holding any query word, scored sum(log(1+tf) * idf). Only postings of query words are built."""
    terms = query_terms(q)
    hits = F.filter(search_tokens(text), lambda w: w.isin(terms))
    post = df.select(key, F.explode(hits).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    dfs = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return (post.join(dfs, "term").join(n).groupBy(key)
            .agg(F.round(F.sum(F.log1p("tf") * F.ln(1 + F.col("n") / F.col("df"))), 6).alias("relevance")))


# ---- trigrams ------------------------------------------------------------------------------------------

def trigrams(c: Column) -> Column:
    """Distinct letter trigrams of each word, padded with two blanks before and one after."""
    words = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "\x00")
    padded = F.regexp_replace(words, "([^\x00]+)", "  $1 ")
    # an empty match at every code point, looking at the three from there on; never inside a surrogate pair
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?![\uDC00-\uDFFF])(?=([^\x00]{3}))"), F.lit(1)))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def fuzzy_search(df: DataFrame, col: str, q: str, threshold: float = 0.3) -> DataFrame:
    s = trigram_similarity(F.col(col), F.lit(q))
    return df.withColumn("similarity", F.round(s, 4)).filter((s > threshold) | F.contains(F.lower(col), F.lit(q.lower())))


# ---- lookups -----------------------------------------------------------------------------------------------

def by_id(t, project_id) -> DataFrame:
    return t["projects"].filter(F.col("project_id") == project_id).join(t["states"].select("state_id", "state_name"), "state_id")


def by_geo(t, state: str, district: str | None = None) -> DataFrame:
    p = t["projects"] if district is None else t["projects"].filter(F.col("district_name") == district)
    s = t["states"].select("state_id", "state_name").filter(F.col("state_name") == state)
    return p.join(s, "state_id").join(t["financials"].select("project_id", "sanctioned_amount"), "project_id", "left")


def by_status_sector(t, status: str, sector: str) -> DataFrame:
    return (t["projects"].filter((F.col("current_status") == status) & (F.col("sector") == sector))
            .join(t["financials"].select("project_id", "sanctioned_amount", "expenditure_amount"), "project_id", "left"))


def high_expenditure(t, min_amount: float) -> DataFrame:
    f = t["financials"].filter((F.col("expenditure_amount") >= min_amount) | (F.col("cost_overrun_amount") > 0))
    return f.select("project_id", "sanctioned_amount", "expenditure_amount", "cost_overrun_amount", "cost_overrun_pct").join(
        t["projects"].select("project_id", "project_title", "sector"), "project_id")


def missing_info_text(t) -> DataFrame:
    v = project_overview(t).select("project_id", "current_status", missing_labels().alias("m"))
    return v.filter(F.size("m") > 0).select("project_id", "current_status", F.concat_ws("; ", "m").alias("missing_fields_text"))


def lateral_latest(projects: DataFrame, progress: DataFrame) -> DataFrame:
    """Each project with its newest report. A correlated top-1 is planned as one ranked pass."""
    g = latest_progress(progress).select("project_id", "reported_date", "physical_progress_pct", "current_stage")
    return projects.select("project_id", "project_title", "current_status").join(g, "project_id", "left")


def high_risk_factors(t, min_score: float = 40.0) -> DataFrame:
    s = t["risk_scores"].filter(F.col("overall_risk_score") >= min_score).select("project_id", "overall_risk_score", "risk_level")
    f = t["risk_factors"].select("project_id", "factor_name", "factor_weight", "factor_impact")
    return s.join(f, "project_id", "left")


def project_detail(t, projects: DataFrame | None = None) -> DataFrame:
    """Everything known about the given projects, one row per child record, so that a project with a
    very long history stays spread out. Sections sort as header, finance, progress, risk, event."""
    p = projects if projects is not None else t["projects"]
    ids = p.select("project_id")
    js = lambda *c: F.to_json(F.struct(*c))
    part = lambda df, sec, order, *c: df.join(ids, "project_id", "left_semi").select(
        "project_id", F.lit(sec).alias("section"), F.col(order).cast("string").alias("sort_key") if order else F.lit("").alias("sort_key"), js(*c).alias("record"))
    parts = [part(p, "1 header", None, "project_title", "sector", "current_status"),
             part(t["financials"], "2 finance", None, "sanctioned_amount", "released_amount", "expenditure_amount"),
             part(t["progress"], "3 progress", "reported_date", "physical_progress_pct", "current_stage"),
             part(t["risk_factors"], "4 risk", "factor_name", "score", "factor_impact"),
             part(t["project_history"], "5 event", "event_timestamp", "event_type", "new_status")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# ---- queues ----------------------------------------------------------------------------------------------------

def pending_sanctions(t, k: int = 20) -> DataFrame:
    p = (t["projects"].filter(F.col("current_status") == "Recommended").select("project_id", "project_title", "sector", "district_name", "mp_name", "recommendation_date")
         .orderBy("recommendation_date", "project_id").limit(k))
    return p.join(t["financials"].select("project_id", "recommended_amount"), "project_id", "left")


def _with_state_of_work(t, p: DataFrame) -> DataFrame:
    g = latest_progress(t["progress"]).select("project_id", "physical_progress_pct", "current_stage", "milestone_status")
    return p.join(t["financials"].select("project_id", "sanctioned_amount", "expenditure_amount"), "project_id", "left").join(g, "project_id", "left")


def assigned_works(t, agency: str | None = None, k: int = 20) -> DataFrame:
    p = t["projects"].filter(F.col("current_status").isin("Sanctioned", "In Progress"))
    if agency:
        p = p.filter(F.contains(F.lower("implementing_agency"), F.lit(agency.lower())))
    return _with_state_of_work(t, p.select("project_id", "project_title", "implementing_agency", "sector", "district_name", "current_status").orderBy("project_id").limit(k))


def track(t, q: str) -> DataFrame:
    """Citizen lookup by id, code or title part; the closest row first (id, code, then title)."""
    q = q.strip()
    exact = F.when(F.col("project_id").cast("string") == q, 0).when(F.col("project_code") == q, 1).when(F.contains(F.lower("project_title"), F.lit(q.lower())), 2)
    p = (t["projects"].withColumn("__m", exact).filter("__m is not null").orderBy("__m", "project_id").limit(1)
         .select("project_id", "project_title", "sector", "district_name", "mp_name", "current_status", "implementing_agency"))
    return _with_state_of_work(t, p).drop("current_stage", "milestone_status")
