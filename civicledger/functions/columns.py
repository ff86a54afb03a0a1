"""Column expressions: text, number and date cleaning, tiers, and Indian-style formatting."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from civicledger import fixed_values as fv


def lit_if(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text ----------------------------------------------------------------------------------

def clean_text(c) -> Column:
    """Trim, collapse white space, and blank out the usual null words."""
    s = F.trim(F.regexp_replace(lit_if(c).cast("string"), r"(?U)\s+", " "))
    return F.when(s.isNull() | s.isin("nan", "None", "<NA>"), F.lit("")).otherwise(s)


def title_case(c) -> Column:
    return F.initcap(clean_text(c))


def canonical_key(c) -> Column:
    s = F.regexp_replace(F.lower(clean_text(c)), r"^the\s+", "")
    return F.trim(F.regexp_replace(F.replace(s, F.lit("&"), F.lit("and")), r"\s+", " "))


def classify_by_keywords(c, words=fv.UNION_TERRITORY_WORDS, yes="Union Territory", no="State") -> Column:
    return F.when(F.lower(lit_if(c)).rlike("|".join(words)), F.lit(yes)).otherwise(F.lit(no))


def reservation_category(c) -> Column:
    c = F.upper(lit_if(c))
    return (F.when(c.contains("(SC)"), "SC").when(c.contains("(ST)"), "ST").otherwise("General"))


def seat_name(c) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.upper(clean_text(c)), r"\s*\((SC|ST)\)\s*", "")))


def split_honorific(c) -> Column:
    """Struct (honorific, name) for names led by Shri, Smt or Dr."""
    s = clean_text(c)
    pattern = r"(?i)^(shri|smt|dr)\s(.*)$"
    found = s.rlike(pattern)
    return F.struct(
        F.when(found, F.initcap(F.regexp_extract(s, pattern, 1))).otherwise("").alias("honorific"),
        F.initcap(F.trim(F.when(found, F.regexp_extract(s, pattern, 2)).otherwise(s))).alias("mp_name"))


def map_house(c) -> Column:
    return F.when(lit_if(c) == 2, fv.HOUSES[0]).otherwise(fv.HOUSES[1])


# ---- numbers ---------------------------------------------------------------------------------

def parse_currency(c, blank_as_zero: bool = False) -> Column:
    """Amount text to double. Unit words are dropped, not applied; blank and '-' give NULL."""
    s = F.regexp_replace(lit_if(c).cast("string"), " ", " ")
    s = F.regexp_replace(s, "(?i)(" + fv.CURRENCY_WORDS + ")", "")
    if blank_as_zero:
        return F.coalesce(F.regexp_replace(s, r"[^\d.]", "").try_cast("double"), F.lit(0.0))
    return F.regexp_replace(s, r"[^\d.\-]", "").try_cast("double")


def to_lakh(c) -> Column:
    return F.round(lit_if(c).cast("double") / 1e5, 2)


def to_crore(c) -> Column:
    return F.round(lit_if(c).cast("double") / 1e7, 2)


def variance(a, b) -> Column:
    return F.round(lit_if(a) - lit_if(b), 2)


def safe_pct(num, den, scale: int = 2) -> Column:
    num, den = lit_if(num).cast("double"), lit_if(den).cast("double")
    return F.when(den > 0, F.round(num / den * 100, scale)).otherwise(F.lit(0.0))


def clip(c, lo=None, hi=None) -> Column:
    """Clamp that keeps NULL (least/greatest would skip it)."""
    c = lit_if(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


# ---- dates -----------------------------------------------------------------------------------

def fiscal_year_part(c) -> Column:
    """Struct (start_year, end_year) of a label like 1993-94."""
    start = F.regexp_extract(F.trim(lit_if(c)), r"^(\d{4})-(\d{2})$", 1).try_cast("int")
    return F.struct(start.alias("start_year"), (start + 1).alias("end_year"))


def financial_year(d) -> Column:
    """April-to-March label of a date."""
    d = lit_if(d)
    y = F.year(d) - F.when(F.month(d) < 4, 1).otherwise(0)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


_ISO_FORMATS = ["dd-MMM-yyyy", "MMM d, yyyy hh:mm:ss a", "yyyy-MM-dd"]
_SAFE_FORMATS = [("^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"), ("^\\d{1,2}-\\d{1,2}-\\d{4}$", "d-M-yyyy"),
                 ("^\\d{1,2}/\\d{1,2}/\\d{4}$", "d/M/yyyy"), ("^\\d{4}/\\d{1,2}/\\d{1,2}$", "yyyy/M/d"),
                 ("^\\d{1,2}/\\d{1,2}/\\d{4}$", "M/d/yyyy"), ("^\\d{1,2}-[A-Za-z]{3}-\\d{4}$", "d-MMM-yyyy"),
                 ("^\\d{1,2}-[A-Za-z]{4,}-\\d{4}$", "d-MMMM-yyyy"),
                 ("^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}$", "yyyy-MM-dd HH:mm:ss"),
                 ("^\\d{1,2}/\\d{1,2}/\\d{4} \\d{2}:\\d{2}:\\d{2}$", "d/M/yyyy HH:mm:ss")]


def to_iso_date(c) -> Column:
    """ISO text of a date in one of three formats; other text comes back unchanged."""
    s = F.trim(lit_if(c).cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in _ISO_FORMATS])
    return F.when(s.isNull() | (s == ""), "").otherwise(
        F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), s))


def parse_date_safe(c, tz: str = "Asia/Kolkata") -> Column:
    """Date from loose text: null words, ISO with or without offset, then a closed format list."""
    s = F.trim(lit_if(c).cast("string"))
    offset = F.to_date(F.from_utc_timestamp(s.try_cast("timestamp"), tz))
    local = F.to_date(F.regexp_replace(s, "T", " ").try_cast("timestamp_ntz"))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T?.*(Z|[+-]\d{2}:?\d{2})$"), offset) \
           .when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), local)
    rest = [F.when(s.rlike(p), F.to_date(F.try_to_timestamp(s, F.lit(f)))) for p, f in _SAFE_FORMATS]
    return F.when((s != "") & ~F.lower(s).isin(fv.NULL_DATE_WORDS), F.coalesce(iso, *rest))


def days_between(later, earlier) -> Column:
    return F.datediff(lit_if(later), lit_if(earlier))


# ---- tiers -----------------------------------------------------------------------------------

def risk_level(score, bounds=None) -> Column:
    """Tier of a score. Bounds are upper-exclusive when the first is a positive LOW bound,
    else lower-inclusive."""
    score = lit_if(score)
    bounds = sorted(bounds or fv.TIER_BOUNDS, key=lambda b: b[0])
    upper = bounds[0][0] > 0 and bounds[0][1].upper() == "LOW"
    ordered = bounds if upper else bounds[::-1]
    tests = [(score < b if upper else score >= b, lab.upper()) for b, lab in ordered]
    chain = reduce(lambda acc, t: acc.when(*t), tests[1:], F.when(*tests[0]))
    return F.when(score.isNotNull(), chain.otherwise(ordered[-1][1].upper()))


def confidence_level(c) -> Column:
    c = lit_if(c)
    return (F.when(c >= 0.85, "HIGH").when(c >= 0.60, "MEDIUM").when(c >= 0.30, "LOW")
            .otherwise("VERY_LOW"))


def signal_ratio(available, total, default: float = 0.5) -> Column:
    a, t = lit_if(available).cast("double"), lit_if(total).cast("double")
    return F.when(t <= 0, F.lit(default)).otherwise(F.round(clip(a / t, 0.0, 1.0), 3))


def normalize_tier(c, style: str = "engine") -> Column:
    """Tier label in engine (LOW/MEDIUM/...), stored (Low/Moderate/...) or severity (low/medium) form."""
    u = F.upper(F.trim(lit_if(c).cast("string")))
    u = F.when(u == "MODERATE", "MEDIUM").when(u.isin(fv.ENGINE_TIERS), u).otherwise("LOW")
    if style == "engine":
        return u
    if style == "severity":
        return F.lower(u)
    return F.when(u == "MEDIUM", "Moderate").otherwise(F.initcap(u))


def history_tier(c) -> Column:
    """Tier label kept by history rows: Medium and Moderate are both legal, the rest is Low."""
    s = F.initcap(F.trim(lit_if(c).cast("string")))
    return F.when(s.isin("Low", "Moderate", "Medium", "High", "Critical"), s).otherwise("Low")


def severity_v1(score) -> Column:
    score = lit_if(score)
    return F.when(score >= 70, "high").when(score >= 30, "medium").otherwise("low")


def score_to_impact(score) -> Column:
    score = lit_if(score)
    return F.when(score >= 80, "Critical").when(score >= 60, "High").when(score >= 30, "Medium").otherwise("Low")


def tier_match(tier: str, level, score) -> Column:
    """True when the stored label or the score band says ``tier`` (a row may match two tiers)."""
    label, score = F.upper(lit_if(level)), lit_if(score)
    band = {"CRITICAL": score >= 80, "HIGH": (score >= 60) & (score < 80),
            "MEDIUM": (score >= 30) & (score < 60), "LOW": score < 30}[tier]
    names = ["MODERATE", "MEDIUM"] if tier == "MEDIUM" else [tier]
    return F.coalesce(label.isin(names), F.lit(False)) | F.coalesce(band, F.lit(False))


# ---- formatting --------------------------------------------------------------------------------

def trim_zeros(c, decimals: int = 2) -> Column:
    """Fixed-decimals text without trailing zeros."""
    s = F.format_string(f"%.{decimals}f", lit_if(c).cast("double"))
    return F.regexp_replace(s, r"\.?0+$", "") if decimals else s


def group_indian(c) -> Column:
    """Digits grouped 3 then 2, as in 2,56,00,000."""
    s = F.abs(lit_if(c)).cast("decimal(38,0)").cast("string")
    head = F.substring(s, F.lit(1), F.greatest(F.length(s) - 3, F.lit(0)))
    tail = F.right(s, F.lit(3))
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.when(F.length(s) <= 3, s).otherwise(F.concat(grouped, F.lit(","), tail))


def half_up(c, decimals: int) -> Column:
    """Half away from zero on 15 decimals of a double: a quotient that misses a half only in its 16th
    decimal (0.44999999999999996) is taken as the half. Numbers too large for that are rounded as they are."""
    c = lit_if(c).cast("double")
    return F.coalesce(F.round(c.try_cast("decimal(38,15)"), decimals).cast("double"), F.round(c, decimals))


def half_even(c, decimals: int) -> Column:
    """Half to even on the scaled double: 1.015 lies below its half and becomes 1.01, 0.545 lies above and becomes 0.55."""
    scale = 10.0 ** decimals
    return F.rint(lit_if(c).cast("double") * scale) / scale + 0.0


def fmt_inr(c, compact: bool = False, in_crores: bool = False) -> Column:
    c = lit_if(c).cast("double")
    a, sign = F.abs(c), F.when(c < 0, "-").otherwise("")
    if in_crores:
        return F.when(c.isNull(), "N/A").otherwise(F.concat(trim_zeros(c / 1e7), F.lit(" crore")))
    whole = F.floor(a)
    full = F.concat(sign, F.lit("₹"), group_indian(whole),
                    F.substring(F.format_string("%.2f", a - whole), 2, 3))
    out = F.when(c.isNull(), "N/A")
    if compact:
        for size, mark in ((1e7, "Cr"), (1e5, "L"), (1e3, "K")):
            out = out.when(a >= size, F.concat(sign, F.lit("₹"), trim_zeros(a / size), F.lit(" " + mark)))
    return out.otherwise(full)


def fmt_pct(c, decimals: int = 0, is_ratio: bool | None = None) -> Column:
    c = lit_if(c).cast("double")
    if is_ratio is None:
        pct = F.when((c != 0) & (F.abs(c) <= 1), c * 100).otherwise(c)
    else:
        pct = c * 100 if is_ratio else c
    return F.when(c.isNull(), "N/A").otherwise(
        F.concat(F.format_string(f"%.{decimals}f", half_even(pct, decimals)), F.lit("%")))


def fmt_points(c) -> Column:
    n = F.bround(F.abs(lit_if(c).cast("double")), 0).cast("int")
    return F.concat(n.cast("string"), F.when(n == 1, " percentage point").otherwise(" percentage points"))


def fmt_mult(c, decimals: int = 2) -> Column:
    c = lit_if(c)
    return F.when(c.isNull(), "N/A").otherwise(F.concat(trim_zeros(half_even(c, decimals), decimals), F.lit("×")))


def fmt_days(c) -> Column:
    n = F.bround(lit_if(c).cast("double"), 0).cast("int")
    return F.when(n.isNull(), "N/A").otherwise(
        F.concat(n.cast("string"), F.when(F.abs(n) == 1, " day").otherwise(" days")))


def fmt_ratio(num, den, style: str = "multiplier") -> Column:
    r = F.try_divide(lit_if(num).cast("double"), lit_if(den).cast("double"))
    if style == "multiplier":
        return fmt_mult(r)
    return F.when(r.isNull(), "N/A").otherwise(F.concat(trim_zeros(half_even(r, 2)), F.lit(":1")))


def oxford_join(arr) -> Column:
    """'a', 'a and b', 'a, b, and c' from an array of words."""
    arr = lit_if(arr)
    n = F.size(arr)
    return (F.when(n == 0, "").when(n == 1, F.element_at(arr, 1))
            .when(n == 2, F.concat_ws(" and ", arr))
            .otherwise(F.concat(F.concat_ws(", ", F.slice(arr, F.lit(1), n - 1)), F.lit(", and "),
                                F.element_at(arr, -1))))


def any_of(cols) -> Column:
    return reduce(lambda a, b: a | b, cols)


def all_of(cols) -> Column:
    return reduce(lambda a, b: a & b, cols)
