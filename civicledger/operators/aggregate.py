"""Weighted aggregate over the engines, breakdown, stored risk tables and whole-portfolio runs."""
from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from civicledger import fixed_values as fv
from civicledger.functions import columns as X
from civicledger.operators import engines as E, similarity as S
from civicledger.sources.sinks import upsert


def _add(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def usable(score: Column, failed: Column | None = None) -> Column:
    """The score clamped to 0-100, or NULL when missing, not finite or failed."""
    s = score.cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & ~s.isin(float("inf"), float("-inf"))
    if failed is not None:
        ok = ok & ~F.coalesce(failed, F.lit(False))
    return F.when(ok, F.least(F.greatest(s, F.lit(0.0)), F.lit(100.0)))


def widen(results: DataFrame, engines: list[str] = fv.ENGINES) -> DataFrame:
    """One row per project with a usable score column per engine (results: project_id, engine, score[, failed])."""
    failed = F.col("failed") if "failed" in results.columns else None
    e = F.when(F.col("engine") == "delay", "delay_detection").otherwise(F.col("engine"))
    return results.withColumn("engine", e).groupBy("project_id").agg(
        *[F.max(F.when(F.col("engine") == k, usable(F.col("score"), failed))).alias(k) for k in engines])


def aggregate_risk(wide: DataFrame, weights: dict[str, float] = fv.ENGINE_WEIGHTS, strategy: str = "RENORMALIZE", bounds=None) -> DataFrame:
    """Overall score, tier, effective weights, unavailable engines and confidence of wide engine scores."""
    names = list(weights)
    have = {k: F.col(k).isNotNull() for k in names}
    n = _add([F.when(have[k], 1).otherwise(0) for k in names])
    total = _add([F.when(have[k], F.lit(weights[k])).otherwise(0.0) for k in names])
    total = F.when(total > 0, total).otherwise(1.0)
    s = strategy.upper()
    if s == "RENORMALIZE":
        ew = {k: F.when(have[k], F.lit(weights[k]) / total).otherwise(0.0) for k in names}
    elif s in ("NEUTRAL_FALLBACK", "ZERO_FALLBACK"):
        ew = {k: F.lit(weights[k]) for k in names}
    else:
        ew = {k: F.when(have[k], F.lit(weights[k])).otherwise(0.0) for k in names}
    raw = _add([F.coalesce(F.col(k), F.lit(0.0)) * ew[k] for k in names])
    overall = F.when(n > 0, F.least(F.greatest(F.round(F.round(raw, 9), 2), F.lit(0.0)), F.lit(100.0))).otherwise(0.0)
    out = wide.withColumn("overall_risk_score", overall).withColumns({
        **{f"ew_{k}": F.when(n > 0, F.round(ew[k], 4)).otherwise(0.0) for k in names},
        "unavailable_engines": F.array_compact(F.array(*[F.when(~have[k], F.lit(k)) for k in names])),
        "confidence": risk_confidence(names)})
    return out.withColumn("risk_level", F.when(F.size("unavailable_engines") == len(names), "LOW").otherwise(X.risk_level("overall_risk_score", bounds)))


def risk_confidence(names: list[str] = fv.ENGINES) -> Column:
    return F.round(_add([F.when(F.col(k).isNotNull(), 1).otherwise(0) for k in names]) / float(len(names)), 3)


def sub_scores() -> dict[str, Column]:
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    return {"delay_risk_score": zero("delay_detection"), "cost_overrun_risk_score": zero("cost_anomaly"),
            "non_completion_risk_score": zero("progress_mismatch"), "leakage_risk_score": zero("agency_pattern")}


def breakdown(agg: DataFrame, results: DataFrame | None = None, weights: dict[str, float] = fv.ENGINE_WEIGHTS) -> DataFrame:
    """One row per project and engine: weight, effective weight, contribution and trigger."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("engine"), F.lit(fv.ENGINE_TITLE[k]).alias("detector_name"), F.coalesce(F.col(k), F.lit(0.0)).alias("score"),
                                        F.lit(round(w, 4)).alias("weight"), F.col(f"ew_{k}").alias("effective_weight")) for k, w in weights.items()])).alias("r")
    out = agg.select("project_id", "overall_risk_score", rows).select("project_id", "overall_risk_score", "r.*").withColumns({
        "contribution": F.round(F.col("score") * F.col("effective_weight"), 2), "triggered": F.col("score") >= 30, "severity": F.lower(X.risk_level("score"))})
    if results is not None:
        more = results.select("project_id", "engine", "reason", "details", F.col("confidence").alias("engine_confidence"))
        out = out.join(more, ["project_id", "engine"], "left").withColumn("reason", F.coalesce("reason", F.lit("Engine did not execute.")))
    return out


# ---- storage ------------------------------------------------------------------------------------

def _dec(c, p: int, s: int) -> Column:
    return F.round(X.lit_if(c).cast(f"decimal(20,{s + 6})"), s).cast(f"decimal({p},{s})")


def risk_score_rows(agg: DataFrame, as_of: dt.date, model_version: str = "v1.0") -> DataFrame:
    """Rows of the stored score table: half-up decimals and the stored tier names."""
    sub = sub_scores()
    return agg.select("project_id", _dec("overall_risk_score", 5, 2).alias("overall_risk_score"), *[_dec(c, 5, 2).alias(k) for k, c in sub.items()],
                      X.normalize_tier("risk_level", "stored").alias("risk_level"), _dec("confidence", 4, 3).alias("confidence_score"), F.lit(as_of).alias("assessment_date"),
                      F.lit(model_version).alias("model_version"))


def risk_factor_rows(rows: DataFrame, agg: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Six factor rows per project: the five engines and the explained total."""
    cat = F.create_map(*[F.lit(x) for kv in fv.ENGINE_CATEGORY.items() for x in kv])
    ew = F.when(F.col("effective_weight") > 0, F.col("effective_weight")).otherwise(F.col("weight"))
    reason = F.col("reason") if "reason" in rows.columns else F.lit("")
    five = rows.select("project_id", F.col("engine").alias("engine_name"), cat[F.col("engine")].alias("factor_category"), F.col("detector_name").alias("factor_name"),
                       _dec(ew, 4, 3).alias("factor_weight"), X.score_to_impact("score").alias("factor_impact"), _dec("score", 5, 2).alias("score"), reason.alias("reason"))
    a = agg.select("project_id", "overall_risk_score")
    a = a.join(summary.select("project_id", "summary"), "project_id", "left") if summary is not None else a.withColumn("summary", F.lit("Explained risk evaluation completed."))
    total = a.select("project_id", F.lit("explained_risk").alias("engine_name"), F.lit("Other").alias("factor_category"), F.lit(fv.ENGINE_TITLE["explained_risk"]).alias("factor_name"),
                     F.lit(0).cast("decimal(4,3)").alias("factor_weight"), X.score_to_impact("overall_risk_score").alias("factor_impact"),
                     _dec("overall_risk_score", 5, 2).alias("score"), F.col("summary").alias("reason"))
    return five.unionByName(total)


def write_risk(stored_scores: DataFrame, stored_factors: DataFrame, new_scores: DataFrame, new_factors: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Scores are upserted (created_at survives a recalculation); factors of recalculated projects are replaced."""
    fresh = new_scores.withColumns({"created_at": now, "updated_at": now})
    scores = upsert(stored_scores, fresh, ["project_id"], [c for c in fresh.columns if c != "created_at"])
    keep = stored_factors.join(new_scores.select("project_id"), "project_id", "left_anti")
    return scores, keep.unionByName(new_factors.select(*stored_factors.columns), allowMissingColumns=True)


# ---- whole portfolio ---------------------------------------------------------------------------------

def engine_results(t, as_of: dt.date, engines: list[str] = fv.ENGINES, matches: DataFrame | None = None,
                   texts: DataFrame | None = None) -> DataFrame:
    """Results of the chosen engines for all projects, one row per project and engine. ``texts`` are the
    projects with their wording where that is a table of its own: duplicates are searched for in all of it,
    and a project that it lacks has no result of that engine."""
    def duplicates() -> DataFrame:
        if texts is None:
            return S.duplicate_detection(t["projects"], matches)
        return S.duplicate_detection(texts, matches).join(t["projects"].select("project_id"), "project_id", "left_semi")

    build = {"cost_anomaly": lambda: E.cost_anomaly(t), "duplicate_detection": duplicates,
             "delay_detection": lambda: E.delay_detection(t, as_of), "progress_mismatch": lambda: E.progress_mismatch(t),
             "agency_pattern": lambda: E.agency_pattern(t, as_of)}
    return reduce(DataFrame.unionByName, [build[e]() for e in engines])


def risk_batch(t, as_of: dt.date, engines: list[str] = fv.ENGINES, only: DataFrame | None = None, matches: DataFrame | None = None,
               texts: DataFrame | None = None) -> DataFrame:
    """Overall risk of all projects, or of the ``only`` ids (peers and portfolios still use everyone)."""
    res = engine_results(t, as_of, engines, matches, texts)
    if only is not None:
        res = res.join(only.select("project_id"), "project_id", "left_semi")
    return aggregate_risk(widen(res))


def batch_summary(agg: DataFrame) -> DataFrame:
    tier, s = F.col("risk_level"), F.col("overall_risk_score")
    done = F.size("unavailable_engines") < len(fv.ENGINES)
    level = (F.when((tier == "CRITICAL") | (s >= 80), "critical").when((tier == "HIGH") | (s >= 60), "high").when((tier == "MEDIUM") | (s >= 30), "medium").otherwise("low"))
    return agg.agg(F.count(F.lit(1)).alias("projects_processed"), F.count_if(done).alias("successful"), F.count_if(~done).alias("failed"),
                   *[F.count_if(done & (level == k)).alias(k) for k in ("low", "medium", "high", "critical")],
                   F.coalesce(F.round(F.avg(F.when(done, s)), 2), F.lit(0.0)).alias("average_score"))


def most_recent(projects: DataFrame, limit: int) -> DataFrame:
    """Ids of the most recently recommended projects (a bounded top-k)."""
    return projects.select("project_id", "recommendation_date").orderBy(F.col("recommendation_date").desc(), "project_id").limit(limit).select("project_id")


def risk_or_compute(t, as_of: dt.date, stored: DataFrame, recalculate: bool = False, engines: list[str] = fv.ENGINES,
                    texts: DataFrame | None = None) -> DataFrame:
    """Stored overall scores where they exist, computed ones for the rest (or for all)."""
    ids = t["projects"].select("project_id")
    todo = ids if recalculate else ids.join(stored.select("project_id"), "project_id", "left_anti")
    new = risk_batch(t, as_of, engines, only=todo, texts=texts).select("project_id", F.col("overall_risk_score").cast("double").alias("overall_risk_score"), "risk_level", F.lit("computed").alias("origin"))
    if recalculate:
        return new
    old = stored.select("project_id", F.col("overall_risk_score").cast("double").alias("overall_risk_score"), X.normalize_tier("risk_level").alias("risk_level"), F.lit("stored").alias("origin"))
    return old.unionByName(new)
