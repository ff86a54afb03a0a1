"""Bindings: the governance tables expressed over the generic star-schema test tables.

Orders act as projects, line items as finance postings and progress reports, nations as states,
customers as seats and members, suppliers as agencies and events as the update feed. Each role is
a lazily built DataFrame, so a query only plans what it touches.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from civicledger import fixed_values as fv
from civicledger.functions import columns as X
from civicledger.sources.sinks import work_dir

STORED: dict[tuple[str, str, str], object] = {}
AS_OF = dt.date(2000, 1, 1)


def _days(base, n):
    return F.date_add(base, n.cast("int"))


class Tables(dict):
    """Role name -> DataFrame; raw parquet tables are reachable under their own names."""

    RAW = ("region nation customer supplier part orders lineitem events documents embeddings "
           "pages benchmark labels conversations").split()

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir, self.as_of = spark, sf_dir, AS_OF

    def __missing__(self, role: str) -> DataFrame:
        df = self._raw(role) if role in self.RAW else getattr(self, "_" + role)()
        self[role] = df
        return df

    def stored(self, name: str, build):
        """What ``build(path)`` returns, built once per application and input folder and kept in the shared folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in STORED:
            STORED[key] = build(work_dir(self.spark, name))
        return STORED[key]

    def _raw(self, role: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{role}.parquet")

    # ---- geography -------------------------------------------------------------------------
    def _states(self):
        return (self["nation"].join(self["region"], F.col("n_regionkey") == F.col("r_regionkey"), "left")
                .select(F.col("n_nationkey").alias("state_id"), F.col("n_name").alias("state_name"),
                        F.when(F.col("r_name") == "ASIA", "Union Territory").otherwise("State").alias("category"),
                        F.lower("n_name").alias("canonical_state_key")))

    def _constituencies(self):
        c, m = self["customer"], F.pmod(F.col("c_custkey"), F.lit(7))
        seats = c.select(F.col("c_nationkey").alias("state_id"), m.alias("seat")).distinct()
        tag = F.when(F.col("seat") == 5, " (SC)").when(F.col("seat") == 6, " (ST)").otherwise("")
        name = F.concat(F.lit("SEAT "), F.col("state_id"), F.lit("-"), F.col("seat"))
        return (seats.join(self["states"], "state_id")
                .select((F.col("state_id") * 100 + F.col("seat")).alias("constituency_id"), "state_id",
                        "state_name", X.seat_name(F.concat(name, tag)).alias("constituency_name"),
                        F.concat(name, tag).alias("raw_caption"),
                        X.reservation_category(F.concat(name, tag)).alias("reservation_category"),
                        "canonical_state_key"))

    # ---- projects ---------------------------------------------------------------------------
    def _works(self):
        """Projects without what they take from customers and suppliers, whose keys are unique: money and scores need no join."""
        k, ck, st = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
        rec = F.to_date("o_orderdate")
        status = (F.when(st == "F", "Completed")
                  .when(st == "O", F.when(k % 4 == 0, "Work Order Issued").when(k % 4 == 1, "Sanctioned")
                        .otherwise("In Progress"))
                  .otherwise(F.when(k % 5 == 0, "Stalled").when(k % 5 == 1, "Recommended")
                             .when(k % 5 == 2, "Cancelled").otherwise("In Progress")))
        return self["orders"].select(
            k.alias("project_id"), ck.alias("custkey"), F.floor(ck / 15).cast("bigint").alias("agency_key"),
            F.substring("o_orderpriority", 3, 20).alias("sector"), rec.alias("recommendation_date"),
            status.alias("current_status"), F.col("o_totalprice").cast("decimal(14,2)").alias("price"))

    def _projects(self):
        o = self["works"]
        c = self["customer"].select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("state_id"),
                                    F.col("c_mktsegment").alias("district_name"), F.col("c_name").alias("mp_name"))
        s = self["supplier"].select(F.col("s_suppkey").alias("agency_key"), F.col("s_name").alias("agency"))
        k, ck, rec, st = F.col("project_id"), F.col("custkey"), F.col("recommendation_date"), F.col("current_status")
        title = F.concat(F.lit("Construction of "), F.lower("district_name"), F.lit(" works for "), F.col("mp_name"))
        return (o.join(c, "custkey", "left").join(s, "agency_key", "left").select(
            k, F.concat(F.lit("W-"), k).alias("project_code"), title.alias("project_title"),
            F.when(k % 13 != 0, F.concat(F.lit("Public works in "), F.lower("sector"), F.lit(" block "),
                                         k % 9, F.lit(" under scheme"))).alias("project_description"),
            "sector", F.when(k % 6 != 0, F.concat(F.lit("S"), ck % 4)).alias("sub_sector"),
            "state_id", (F.col("state_id") * 100 + ck % 7).alias("constituency_id"), "district_name",
            F.when(ck % 11 != 0, F.concat(F.lit("Block "), ck % 9)).alias("block_name"),
            F.when(ck % 41 != 0, F.col("agency")).alias("implementing_agency"), "mp_name",
            F.when(k % 3 < 2, fv.HOUSES[0]).otherwise(fv.HOUSES[1]).alias("house_of_parliament"),
            X.financial_year(rec).alias("financial_year"), "current_status", "recommendation_date",
            F.when((st == "Recommended") | (k % 17 == 0), None).when(k % 97 == 0, F.date_sub(rec, 5))
             .otherwise(_days(rec, 20 + ck % 120)).alias("sanction_date"),
            F.when(~st.isin("Recommended", "Sanctioned") & (k % 37 != 0), _days(rec, 140 + k % 40)).alias("work_order_date"),
            F.when(k % 23 != 0, _days(rec, 240 + k % 180)).alias("expected_completion_date"),
            F.when((st == "Completed") & (k % 29 != 0), _days(rec, 200 + ck % 340)).alias("actual_completion_date"),
            "price", "custkey"))

    def _financials(self):
        # whole paise times whole percent: exact in a long, where wide decimals would go through objects
        paise, share = F.round(F.col("l_extendedprice") * 100).cast("bigint"), 100 - F.round(F.col("l_discount") * 100).cast("bigint")
        paid = (self["lineitem"].groupBy(F.col("l_orderkey").alias("project_id")).agg(
            (F.sum(paise * share).cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(14,2)").alias("paid"),
            F.to_date(F.max("l_shipdate")).alias("last_disbursement_date")))
        k, st = F.col("project_id"), F.col("current_status")
        p = self["works"].select("project_id", "current_status", "price").join(paid, "project_id", "left")
        released = F.coalesce("paid", F.lit(0).cast("decimal(14,2)"))
        spent = F.when(st == "Recommended", F.lit(0).cast("decimal(14,2)")).otherwise(
            (released * (30 + (k * 7) % 81).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(14,2)"))
        sanctioned = F.when(st != "Recommended", F.col("price"))
        p = p.select(k, (F.col("price") * F.lit("1.05").cast("decimal(3,2)")).cast("decimal(14,2)").alias("recommended_amount"),
                     sanctioned.alias("sanctioned_amount"), released.alias("released_amount"),
                     spent.alias("expenditure_amount"), "last_disbursement_date")
        s, r, e = (F.col(c + "_amount") for c in ("sanctioned", "released", "expenditure"))
        over = F.greatest(e - s, F.lit(0).cast("decimal(14,2)"))
        over = F.when(s.isNotNull(), over).otherwise(F.lit(0)).cast("decimal(14,2)")
        pct = lambda a, b: F.round(a.cast("double") / b.cast("double") * 100, 2)
        return p.select(
            "project_id", F.lit("INR").alias("currency"), "recommended_amount", "sanctioned_amount", "released_amount",
            "expenditure_amount", (r - e).cast("decimal(14,2)").alias("unspent_balance"),
            F.when(r > 0, F.least(pct(e, r), F.lit(100.0))).alias("utilization_rate_pct"),
            over.alias("cost_overrun_amount"),
            F.when(s > 0, pct(over, s)).otherwise(0.0).alias("cost_overrun_pct"), "last_disbursement_date")

    def _progress(self):
        q, pk, sk = F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")
        day = F.to_date("l_shipdate")
        phys = F.least(q * 2, F.lit(100.0))
        fin = X.clip(q * 2 + F.round((F.col("l_discount") - 0.05) * 600, 2), 0.0, 100.0)
        late = F.when(F.col("l_returnflag") == "R", (pk % 120).cast("int")).otherwise(0)
        return self["lineitem"].select(
            F.col("l_orderkey").alias("project_id"), (pk * 10 + F.col("l_linenumber")).alias("progress_id"),
            day.alias("reported_date"), phys.alias("physical_progress_pct"),
            F.round(fin, 2).alias("financial_progress_pct"),
            F.when(phys >= 100, "Completed").when(phys >= 80, "Finishing").when(phys >= 30, "Structure")
             .otherwise("Foundation").alias("current_stage"),
            late.alias("days_delayed"),
            F.when(late > 90, "Critical").when(late > 0, "Delayed").otherwise("On Track").alias("milestone_status"),
            F.when(F.col("l_tax") >= 0.02, F.date_add(day, 3)).alias("inspection_date"),
            F.when(F.col("l_tax") >= 0.02, F.concat(F.lit("Inspector "), sk % 20)).alias("inspected_by"),
            F.when(sk % 9 != 0, (6 + sk % 33).cast("double")).alias("geo_latitude"),
            F.when(sk % 9 != 0, (66 + pk % 33).cast("double")).alias("geo_longitude"),
            F.when(pk % 7 != 0, F.concat(F.lit("photo/"), pk)).alias("photo_evidence_url"))

    # ---- stored risk results (stand-ins for tables written by an earlier run) -----------------
    def _risk_scores(self):
        k, ck = F.col("project_id"), F.col("custkey")
        score = ((k * 37 + ck * 11) % 1001 / F.lit(10.0))
        p = self["works"].filter(k % 31 != 0).select(
            k, score.alias("overall_risk_score"), ((k * 13 + ck) % 101).cast("double").alias("delay_risk_score"),
            ((k * 17 + ck) % 101).cast("double").alias("cost_overrun_risk_score"),
            ((k * 19 + ck) % 101).cast("double").alias("non_completion_risk_score"),
            ((k * 23 + ck) % 101).cast("double").alias("leakage_risk_score"),
            ((60 + k % 40) / F.lit(100.0)).alias("confidence_score"), F.lit(AS_OF).alias("assessment_date"))
        s = F.col("overall_risk_score")
        return p.withColumn("risk_level", F.when(k % 19 == 0, "High").when(s < 30, "Low").when(s < 60, "Moderate")
                            .when(s < 80, "High").otherwise("Critical")).withColumn("risk_score_id", k)

    def _risk_factors(self):
        """Five engine rows per scored project, with JSON details."""
        return self.factors_of(self["risk_scores"])

    @staticmethod
    def factor_score(number) -> Column:
        """Score of the engine with this number."""
        return ((F.col("project_id") * (7 + number * 4)) % 101).cast("double")

    def factors_of(self, scores, *carry: str) -> DataFrame:
        """The engine rows of stored scores, next to ``carry`` columns of theirs."""
        k = F.col("project_id")
        base = scores.select("risk_score_id", k, *carry)
        rows = F.explode(F.array(*[F.struct(F.lit(e).alias("engine_name"), F.lit(i).alias("eno"))
                                   for i, e in enumerate(fv.ENGINES)])).alias("r")
        d = base.select("*", rows).select(*base.columns, "r.*")
        score = self.factor_score(F.col("eno"))
        titles = F.create_map(*[F.lit(x) for e in fv.ENGINES for x in (e, fv.ENGINE_TITLE[e])])
        cats = F.create_map(*[F.lit(x) for e in fv.ENGINES for x in (e, fv.ENGINE_CATEGORY[e])])
        dev = (k * 11) % 2600 / F.lit(10.0) - 60
        details = (F.when(F.col("engine_name") == "delay_detection",
                          F.when(k % 4 != 0, F.to_json(F.struct(((k * 3) % 500).alias("overdue_days"),
                                                                F.lit("in progress").alias("status")))).otherwise("{}"))
                   .when(F.col("engine_name") == "cost_anomaly",
                         F.to_json(F.struct(dev.alias("deviation_percentage"), ((k * 3) % 70 / F.lit(10.0)).alias("robust_z_score"),
                                            F.when(dev > 50, "HIGH_COST_OUTLIER").otherwise("NORMAL").alias("anomaly_type"))))
                   .otherwise("{}"))
        return d.select("risk_score_id", "project_id", "engine_name", titles[F.col("engine_name")].alias("factor_name"),
                        cats[F.col("engine_name")].alias("factor_category"), F.lit(0.2).alias("factor_weight"),
                        X.score_to_impact(score).alias("factor_impact"), score.alias("score"),
                        F.concat(F.lit("Review "), "engine_name").alias("mitigation_recommendation"),
                        F.concat(F.lit("Score "), score.cast("int")).alias("reason"), details.alias("details"),
                        ((50 + k % 50) / F.lit(100.0)).alias("confidence"), *carry)

    # ---- slim stored features ------------------------------------------------------------------
    def _project_features(self):
        exp, act = F.col("expected_completion_date"), F.col("actual_completion_date")
        delay = (F.when(act.isNotNull() & exp.isNotNull(), F.datediff(act, exp))
                 .when(exp.isNotNull(), F.greatest(F.lit(0), F.datediff(F.lit(AS_OF), exp))).otherwise(0))
        p = self["projects"].join(self["financials"], "project_id", "left")
        dev = (F.coalesce(F.col("expenditure_amount"), F.lit(0)).cast("double") -
               F.coalesce(F.col("sanctioned_amount"), F.lit(0)).cast("double"))
        return p.select("project_id", delay.alias("delay_days"), (delay > 0).alias("is_delayed"),
                        F.round(dev, 2).alias("cost_deviation"))

    # ---- update feed, snapshots and history -------------------------------------------------------
    def _project_history(self):
        et = F.col("event_type")
        new = (F.when(et == "view", "Recommended").when(et == "click", "Sanctioned")
               .when(et == "signup", "Work Order Issued").when(et == "error", "Stalled").otherwise("In Progress"))
        return self["events"].select(
            F.col("event_id").alias("history_id"), F.col("user_id").alias("project_id"),
            F.when(et == "error", "Delay Flagged").when(et == "purchase", "Fund Disbursed")
             .otherwise("Status Changed").alias("event_type"),
            F.col("ts").alias("event_timestamp"), new.alias("new_status"),
            F.concat(F.lit("user "), F.col("event_id") % 17).alias("performed_by"), "props")

    def _snapshots(self):
        """Stored project versions, one per event."""
        k = F.get_json_object("props", "$.k").cast("int")
        v, et = F.col("value"), F.col("event_type")
        score = (F.col("event_id") * 7) % 1001 / F.lit(10.0)
        return self["events"].select(
            F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("project_id"), F.col("ts").alias("snapshot_datetime"),
            F.when(et == "error", "Stalled").when(et == "signup", "Sanctioned").otherwise("In Progress").alias("project_status"),
            F.lit(100000).cast("decimal(14,2)").alias("sanctioned_amount"),
            (v.cast("decimal(14,2)") * 1000).cast("decimal(14,2)").alias("released_amount"),
            (v.cast("decimal(14,2)") * 900).cast("decimal(14,2)").alias("expenditure_amount"),
            F.least(v, F.lit(100.0)).cast("decimal(5,2)").alias("physical_progress_pct"),
            F.when(F.col("event_id") % 5 != 0, F.least(v * 0.5, F.lit(100.0)).cast("decimal(5,2)")).alias("financial_progress_pct"),
            F.date_add(F.to_date(F.lit("2025-01-01")), (k % 3).cast("int")).alias("expected_completion_date"),
            F.when(k > 90, F.to_date(F.lit("2025-06-01"))).alias("actual_completion_date"),
            k.alias("days_delayed"),
            F.when(k > 60, "Delayed").otherwise("On Track").alias("milestone_status"),
            score.cast("decimal(5,2)").alias("overall_risk_score"),
            F.when(score < 30, "Low").when(score < 60, F.when(F.col("event_id") % 2 == 0, "Moderate").otherwise("Medium"))
             .when(score < 80, "High").otherwise("Critical").alias("risk_level"))

    def _readings(self):
        """Full-state update feed used by the version fold: three monitored numbers per event."""
        return self["events"].select(
            F.col("user_id").alias("project_id"), F.col("ts").alias("event_ts"), F.col("event_id").alias("update_id"),
            F.least(F.col("value"), F.lit(100.0)).alias("physical_progress_pct"),
            F.round(F.col("value") * 1000, 2).alias("expenditure_amount"),
            F.get_json_object("props", "$.k").cast("double").alias("days_delayed"))

    # ---- yearly and state tables --------------------------------------------------------------------
    def _union_budget(self):
        cr = F.lit("0.0000001").cast("decimal(8,7)")
        y = F.year("o_orderdate")
        price = F.col("o_totalprice").cast("decimal(14,2)")
        g = self["orders"].groupBy(y.alias("start_year")).agg(
            F.sum(price).cast("decimal(18,2)").alias("be"),
            F.sum(F.when(F.col("o_orderstatus") == "F", price)).cast("decimal(18,2)").alias("ac"))
        sy = F.col("start_year")
        be = (F.col("be") * cr).cast("decimal(14,2)")
        ac = F.when(sy < 2001, (F.col("ac") * cr).cast("decimal(14,2)"))
        return g.select(
            F.concat(sy.cast("string"), F.lit("-"), F.lpad(F.pmod(sy + 1, F.lit(100)).cast("string"), 2, "0")).alias("financial_year"),
            sy, (sy + 1).alias("end_year"), F.lit(5.0).alias("scheme_entitlement_per_mp_cr"), be.alias("budget_estimate_cr"),
            F.when(sy < 2001, be).alias("revised_estimate_cr"), ac.alias("actual_expenditure_cr"),
            (ac - be).cast("decimal(14,2)").alias("be_vs_actual_variance_cr"), F.lit(3475).alias("major_head"),
            F.when(sy < 2001, "Closed").otherwise("Open").alias("status_notes"))

    def _qa_raw(self):
        """Per-state outlays and work counts before rates are derived."""
        cr = F.lit("0.0000001").cast("decimal(8,7)")
        money = lambda c: (F.sum(c).cast("decimal(18,2)") * cr).cast("decimal(14,2)")
        return (self["projects"].join(self["financials"], "project_id")
                .groupBy("state_id").agg(
                    money("released_amount").alias("released_cr"), money("expenditure_amount").alias("expenditure_cr"),
                    F.count(F.lit(1)).alias("works_recommended"), F.count("sanction_date").alias("works_sanctioned"),
                    F.count_if(F.col("current_status") == "Completed").alias("works_completed"))
                .join(self["states"].select("state_id", "state_name", "canonical_state_key"), "state_id")
                .withColumn("unspent_balance_cr", (F.col("released_cr") - F.col("expenditure_cr")).cast("decimal(14,2)")))

    def _parliament_qa(self):
        from civicledger.operators.clean import add_rates
        return add_rates(self["qa_raw"])

    def _master_dim(self):
        from civicledger.operators.clean import build_master_dim
        return build_master_dim(self["states"], self["constituencies"], self["parliament_qa"])

    def _calamity(self):
        """Relief consents: one per customer."""
        k, bal = F.col("c_custkey"), F.col("c_acctbal")
        start = F.to_date(F.lit("2019-06-01"))
        return self["customer"].select(
            k.alias("s_no"), F.concat(F.element_at(F.array(*map(F.lit, ["Shri ", "Smt ", "DR ", ""])), (k % 4 + 1).cast("int")),
                                      F.lower("c_name")).alias("raw_name"),
            (k % 3 + 1).cast("int").alias("house_code"), F.abs(F.round(bal * 1500, 2)).alias("consented_amount_inr"),
            F.date_add(start, (k % 2100).cast("int")).alias("consent_date"), start.alias("tenure_start_date"),
            F.date_add(start, 1826).alias("tenure_end_date"), F.lit("Flood").alias("calamity_type"))
