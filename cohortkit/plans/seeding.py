"""Composition: cohort -> signals -> exclusions -> final list, audit log, metrics.

``run_seeding(wide, cfg)`` gives a run whose stages are built on first use.  The wide
table is scanned twice: for the per-captain pass (``plans.scope``) and for the
cohort's orders.  Building a stage stores it (when materialising) and counts what the
metrics show on the way, so ``metrics()`` has no scan of its own.  Id sets stay
DataFrames (semi/anti joins), and the audit log is a union of the signal functions'
own flagged frames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..session import materialize_counted
from ..operators import audit_part, audit_union, fixed4, flag_matrix, joined_flags, kv, top_k_per_group
from .cohort import Cohort, eligible_cohort
from .feedback import fb_live, fb_rating, feedback_ids, live_excluded, rating_excluded
from .scope import META, eligible
from .signals import KEY, SIGNAL_COLUMNS, SignalSet, all_signals

SIGNAL_ORDER = ("review", "calls", "ocara", "ticket", "inappchat")


def risk_master(signals: SignalSet) -> DataFrame:
    """One row per flagged captain: a boolean per signal and the number of signals."""
    return flag_matrix(signals.ids(), KEY)


def captain_status(scope: DataFrame, risky: DataFrame, cfg: RunConfig) -> DataFrame:
    """Where each captain of the scope stands: in the cohort, flagged by a signal, excluded by feedback,
    left over (``nminus1``), listed (``final``), outside the shift list (``off_shift``); and the latest metadata.

    Membership is by id, so a null id is never removed by another set, and never listed.
    """
    flags = risky.select(F.col(KEY).alias("_risky"))
    known = F.col(KEY).isNotNull()
    listed = F.col("shift_name").isin(list(cfg.shift_list))
    s = scope.join(flags, F.col(KEY) == F.col("_risky"), "left").select(
        KEY, eligible(cfg).alias("in_cohort"), F.col("_risky").isNotNull().alias("flagged"),
        (live_excluded(cfg) | rating_excluded(cfg)).alias("excluded"), *META)
    s = s.withColumn("nminus1", F.col("in_cohort") & ~F.col("flagged") & ~(F.col("excluded") & known))
    return s.select("*", (F.col("nminus1") & known & (F.coalesce(listed, F.lit(False)) if cfg.apply_shift_filter
                                                      else F.lit(True))).alias("final"),
                    (F.col("nminus1") & known & F.coalesce(~listed, F.lit(False))).alias("off_shift"))


def audit_log(s: SignalSet, live: DataFrame, rating: DataFrame, status: DataFrame, cfg: RunConfig) -> DataFrame:
    """Every removal reason, ``(captain_id, signal, logic, evidence)``."""
    rv = s.review.flagged
    calls = s.calls.flagged
    parts = [
        audit_part(s.chat.flagged, KEY, "inappchat", "rude_behavior",
                   kv(("incidents", F.col("incidents")), ("female", F.col("female_incidents")))),
        audit_part(s.ticket.flagged, KEY, "ticket", F.col("tier"), kv(("count", F.col("ticket_count")))),
        audit_part(rv.where("flag_l0"), KEY, "review", "L0_any", kv(("count", F.col("l0_count")))),
        audit_part(rv.where("flag_l1"), KEY, "review", "L1_female", kv(("count", F.col("l1_female_count")))),
        audit_part(rv.where("flag_l2"), KEY, "review", "L2_p95", kv(("rate_diff", fixed4(F.col("rate_diff"))))),
        audit_part(calls, KEY, "calls",
                   joined_flags([(F.col("f1"), "rate"), (F.col("f2"), "vol"), (F.col("f3"), "cv")]),
                   kv(("rate_diff", fixed4(F.col("call_rate_diff"))), ("calls_diff", fixed4(F.col("calls_diff"))),
                      ("cv_diff", fixed4(F.col("cv_diff"))))),
        audit_part(s.cancel.flagged, KEY, "ocara", F.col("direction"), kv(("F_minus_M", fixed4(F.col("diff"))))),
        audit_part(live.where("excluded"), KEY, "new_feedback", "live_feedback_no",
                   kv(("total", F.col("total_count")), ("yes", F.col("yes_count")), ("no", F.col("no_count")))),
        audit_part(rating.where("excluded"), KEY, "new_feedback", "rating_screen_low_yes",
                   kv(("total", F.col("total_count")), ("pct_yes", F.col("pct_yes")))),
        audit_part(status.where("off_shift"), KEY, "shift", "shift_not_in_list",
                   kv(("shift_name", F.col("shift_name")))),
    ]
    return audit_union(parts)


def audit_top(audit: DataFrame, k: int) -> DataFrame:
    """First ``k`` audit rows per signal, ordered by captain, logic, evidence."""
    return top_k_per_group(audit, ["signal"], [F.col(KEY), F.col("logic"), F.col("evidence")], k)


class SeedingRun:
    """One run of the job; every stage is built on first use.

    Stored when materialising (parquet in the checkpoint folder): the per-captain
    pass, the cohort's orders (row grain, signal columns), the per-captain facts,
    flagged sets, thresholds, risk master and status.  Outputs read those.
    """

    def __init__(self, wide: DataFrame, cfg: RunConfig, materialize: bool = True):
        self.wide, self.cfg, self.materialize = wide, cfg, materialize
        self._counted: dict[str, dict] = {}

    def _store(self, df: DataFrame, label: str, counts: dict[str, Column]) -> DataFrame:
        """Keep a stage and its counts; not materialising, both stay lazy."""
        if self.materialize:
            df, self._counted[label] = materialize_counted(df, label, counts)
        else:
            self._counted[label] = {"_frame": df, "_counts": counts}
        return df

    def _count(self, label: str) -> dict:
        got = self._counted[label]
        if "_frame" in got:
            got = self._counted[label] = got["_frame"].agg(*[c.alias(n) for n, c in got["_counts"].items()]).first().asDict()
        return got

    @cached_property
    def cohort(self) -> Cohort:
        live, rating = live_excluded(self.cfg), rating_excluded(self.cfg)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        counts = {"source_rows": total("scoped_rows"), "base_rows": total("base_rows"),
                  "captains": F.count_if(eligible(self.cfg)), "live_excluded": F.count_if(live),
                  "rating_excluded": F.count_if(rating), "feedback": F.count_if(live | rating)}
        return eligible_cohort(self.wide, self.cfg, lambda df: self._store(df, "captain-scope", counts))

    @cached_property
    def signal_orders(self) -> DataFrame:
        """The cohort's orders, projected to the signal columns; stored once when materialising.

        Every signal pass (call-count quantile, per-captain facts, cancel sums)
        then scans this stage table instead of re-running the scope filters
        and the semi join.
        """
        return self._store(self.cohort.orders.select(*SIGNAL_COLUMNS), "cohort-orders", {"orders": F.count(F.lit(1))})

    @cached_property
    def signals(self) -> SignalSet:
        return all_signals(self.signal_orders, self.cfg, self.materialize, self._store)

    @cached_property
    def risky(self) -> DataFrame:
        return self._store(risk_master(self.signals), "risk-master",
                           {"risky": F.count(F.lit(1)), **{n: F.count_if(f"flag_{n}") for n in SIGNAL_ORDER}})

    @cached_property
    def status(self) -> DataFrame:
        in_cohort, flagged, excluded, known = (F.col("in_cohort"), F.col("flagged"), F.col("excluded"),
                                               F.col(KEY).isNotNull())
        return self._store(captain_status(self.cohort.scope, self.risky, self.cfg), "captain-status", {
            "seed": F.count_if(in_cohort & ~flagged), "nminus1": F.count_if("nminus1"), "final": F.count_if("final"),
            "off_shift": F.count_if("off_shift"), **overlap_counts_of(in_cohort, flagged, excluded, known),
            "audited": F.count_if(known & (flagged | excluded | F.col("off_shift")))})

    @cached_property
    def seed(self) -> DataFrame:
        return self.status.where(F.col("in_cohort") & ~F.col("flagged")).select(KEY)

    @cached_property
    def live(self) -> DataFrame:
        return fb_live(self.cohort.scope, self.cfg)

    @cached_property
    def rating(self) -> DataFrame:
        return fb_rating(self.cohort.scope, self.cfg)

    @cached_property
    def feedback(self) -> DataFrame:
        return feedback_ids(self.cohort.scope, self.cfg)

    @cached_property
    def nminus1(self) -> DataFrame:
        return self.status.where("nminus1").select(KEY)

    @cached_property
    def meta(self) -> DataFrame:
        return self.status.where(F.col("nminus1") & F.col(KEY).isNotNull()).select(KEY, *META)

    @cached_property
    def final(self) -> DataFrame:
        return self.status.where("final").select(KEY, "mobile", "shift_name")

    @cached_property
    def audit(self) -> DataFrame:
        return audit_log(self.signals, self.live, self.rating, self.status, self.cfg)

    def overlap(self) -> DataFrame:
        """Feedback removals already covered by the five signals vs incremental ones (one pass over the status)."""
        in_cohort, flagged, excluded = F.col("in_cohort"), F.col("flagged"), F.col("excluded")
        one = overlap_counts_of(in_cohort, flagged, excluded, F.col(KEY).isNotNull())
        return self.status.agg(*[c.alias(n) for n, c in one.items()], F.count_if(in_cohort & ~flagged).alias("seed_before"),
                               F.count_if("nminus1").alias("nminus1_after"))

    def metrics(self) -> DataFrame:
        return funnel_metrics(self)


def overlap_counts_of(in_cohort: Column, flagged: Column, excluded: Column, known: Column) -> dict[str, Column]:
    return {"df_new_feedback_total": F.count_if(excluded), "already_in_5signal_risky": F.count_if(excluded & flagged),
            "incremental_new_removals": F.count_if(excluded & ~flagged),
            "incremental_in_cohort": F.count_if(excluded & ~flagged & in_cohort & known)}


def run_seeding(wide: DataFrame, cfg: RunConfig, materialize: bool = True) -> SeedingRun:
    return SeedingRun(wide, cfg, materialize)


# ---- funnel metrics --------------------------------------------------------

def funnel_metrics(r: SeedingRun) -> DataFrame:
    """``(stage, metric, value)`` rows for every stage of the run.

    Every count was taken while its stage was stored; the thresholds are one
    stored row.  Builds the stages that are not built yet and reads no other table.
    """
    status, s = r.status, r.signals
    spark = status.sparkSession
    scope, orders, facts, risky, end = (r._count(x) for x in ("captain-scope", "cohort-orders", "captain-facts", "risk-master",
                                                              "captain-status"))
    review, calls, cancel = (r._count(f"flagged-{x}") for x in ("review", "calls", "cancel"))
    cuts = s.cuts.first().asDict()
    audit_rows = (facts["chat_captains"] + facts["ticket_rows"] + sum(review[f"{x}_flagged"] for x in ("l0", "l1", "l2"))
                  + calls["calls_risky"] + cancel["cancel_risky"] + scope["live_excluded"] + scope["rating_excluded"]
                  + end["off_shift"])
    rows = {
        "cohort": {"source_rows": scope["source_rows"], "base_6m_dropped": scope["base_rows"],
                   "cohort_captains": scope["captains"], "cohort_orders": orders["orders"]},
        "inappchat": {"captains_flagged": facts["chat_captains"], "female_incidents": facts["female_incidents"],
                      "male_incidents": facts["male_incidents"]},
        "ticket": {"tickets_total": facts["tickets_total"], "p0_p1_captains": facts["ticket_captains"]},
        "review": {**{f"{x}_flagged": review[f"{x}_flagged"] for x in ("l0", "l1", "l2")},
                   "total_review_risky": review["review_risky"], "p95_l2_threshold": cuts["p95_l2_threshold"]},
        "calls": {"qualifying_captains": facts["calls_qualifying"], "risky_captains": calls["calls_risky"],
                  **{c: cuts[c] for c in ("call_rate_threshold", "calls_diff_threshold", "cv_diff_threshold")}},
        "ocara": {"qualifying_captains": facts["cancel_qualifying"], "risky_captains": cancel["cancel_risky"],
                  **{c: cuts[c] for c in ("p98_threshold", "p02_threshold", "upper_used", "lower_used")}},
        "risky": {"total_unique_risky": risky["risky"], **{n: risky[n] for n in SIGNAL_ORDER},
                  "risky_pct": risky["risky"] / scope["captains"] * 100 if scope["captains"] else 0.0},
        "seed": {"safe_seed_captains": end["seed"]},
        "new_feedback": {"live_feedback_excluded": scope["live_excluded"],
                         "rating_screen_excluded": scope["rating_excluded"], "union": scope["feedback"]},
        "feedback_applied": {**{n: end[n] for n in ("df_new_feedback_total", "already_in_5signal_risky",
                                                    "incremental_new_removals", "incremental_in_cohort")},
                             "seed_before": end["seed"], "nminus1_after": end["nminus1"]},
        "final": {"nminus1_after_new_feedback": end["nminus1"], "after_shift_filter": end["final"]},
        "audit": {"rows": audit_rows, "unique_captains": end["audited"]},
    }
    lits = [F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("metric"),
                     F.lit(None if value is None else float(value)).cast("double").alias("value"))
            for stage, group in rows.items() for name, value in group.items()]
    return spark.range(1).select(F.inline(F.array(*lits)))
