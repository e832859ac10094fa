"""The five risk signals on the cohort's orders.

All five read one per-captain table, ``captain_facts``: a ``(captain, gender)``
aggregate over the cohort orders (distinct rides, label counts, call stats)
pivoted to one row per captain.  That is one scan and one distinct-count
aggregate for signals 1-4 instead of one per signal (the reference counts the
same distinct rides three times).  Signal 5 adds the captain-day cancel counts
(max per day, then sum: two partial aggregates).

Thresholds are nearest-rank quantiles (``operators.quantile``), all of them
found in one plan over the facts (``thresholds``) and embedded as scalar
subqueries on its one row, so nothing is collected.
Each signal returns ``(metrics, flagged)``; the audit log is built from the
``flagged`` frames, so a rule is written once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import safe_ratio
from ..session import materialize as materialize_stage
from ..operators import (breach, cap_at, floor_at, lower_tail, max_then_sum, pivot_segments, quantile_col,
                         quantile_row, upper_tail, vote_count)
from .cohort import FEMALE, MALE, SEG, SEGMENTS

KEY = "captain_id"
CALLS = "total_calls_doneby_captain"
CHAT = "chat_agent_response_issue_type"
TICKET = "support_ticket_agent_response_issue_type"
REVIEW = "post_ride_review_agent_response_issue_type"
SIGNAL_COLUMNS = ("captain_id", "order_id", "order_date", "customer_gender", "gender",
                  "total_calls_doneby_captain", "chat_agent_response_issue_type",
                  "support_ticket_agent_response_issue_type", "post_ride_review_agent_response_issue_type",
                  "female_ocara_count_captainlevel", "male_ocara_count_captainlevel",
                  "female_cc_count_captainlevel", "male_cc_count_captainlevel")
OCARA_COLS = {
    "cancels_f": "female_ocara_count_captainlevel",
    "cancels_m": "male_ocara_count_captainlevel",
    "cc_f": "female_cc_count_captainlevel",
    "cc_m": "male_cc_count_captainlevel",
}


def tier_col(tier: str) -> str:
    return f"tier_{tier}_rows"


def calls_cap(orders: DataFrame, cfg: RunConfig, materialize: bool = False) -> Column:
    """p99 (nearest rank) of non-null call counts; 0.0 when there is none."""
    return F.coalesce(quantile_col(orders, CALLS, cfg.q_calls_cap, materialize=materialize), F.lit(0.0))


def gender_facts(orders: DataFrame, cfg: RunConfig, cap: Column | None = None) -> DataFrame:
    """Long ``(captain_id, gender)`` facts shared by signals 1-5."""
    calls = F.col(CALLS).cast("double")
    capped = cap_at(calls, calls_cap(orders, cfg) if cap is None else cap)
    called = F.when(calls.isNull(), F.lit(0)).otherwise(F.lit(1))
    chat, ticket, review = F.col(CHAT), F.col(TICKET), F.col(REVIEW)
    rev_ok = review.isin(list(cfg.review_labels))
    l0, l1, l2 = cfg.review_labels[0], cfg.review_labels[1], cfg.review_labels[2]
    metrics = [
        F.count_distinct("order_id").alias("rides"),
        F.count_if(chat.isin(list(cfg.chat_issues)) & (chat == cfg.chat_rude)).alias("rude_rows"),
        F.count_if(ticket.isin(list(cfg.ticket_tiers_all))).alias("ticket_rows"),
        *[F.count_if(ticket.isin(list(cfg.ticket_tiers_all)) & (ticket == t)).alias(tier_col(t))
          for t in cfg.ticket_tiers_remove],
        F.count_if(rev_ok & (review == l0)).alias("l0_rows"),
        F.count_if(rev_ok & (review == l1)).alias("l1_rows"),
        F.count_if(rev_ok & (review == l2)).alias("l2_rows"),
        F.avg(called).alias("call_rate"),
        F.avg(capped).alias("avg_calls"),
        F.stddev_samp(capped).alias("std_calls"),
    ]
    return orders.groupBy(KEY, SEG).agg(*metrics)


FACT_VALUES = ("rides", "rude_rows", "ticket_rows", "l0_rows", "l1_rows", "l2_rows",
               "call_rate", "avg_calls", "std_calls")


def captain_facts(orders: DataFrame, cfg: RunConfig, cap: Column | None = None) -> DataFrame:
    """One row per cohort captain: every fact as ``<fact>_Female`` / ``<fact>_Male``."""
    values = list(FACT_VALUES) + [tier_col(t) for t in cfg.ticket_tiers_remove]
    return pivot_segments(gender_facts(orders, cfg, cap), KEY, SEG, SEGMENTS, values)


def _both(c: str) -> Column:
    """Female + Male of a count fact, a missing segment counting 0."""
    return F.coalesce(F.col(f"{c}_{FEMALE}"), F.lit(0)) + F.coalesce(F.col(f"{c}_{MALE}"), F.lit(0))


@dataclass(frozen=True)
class Signal:
    metrics: DataFrame  # per-captain scores (qualifying captains)
    flagged: DataFrame  # flagged captains with evidence columns
    thresholds: dict  # name -> scalar Column


# ---- Signal 1: in-app chat -------------------------------------------------

def sig_chat(facts: DataFrame, cfg: RunConfig) -> Signal:
    m = facts.select(KEY, _both("rude_rows").alias("incidents"),
                     F.coalesce(F.col(f"rude_rows_{FEMALE}"), F.lit(0)).alias("female_incidents"))
    return Signal(metrics=m, flagged=m.where(F.col("incidents") > 0), thresholds={})


# ---- Signal 2: ticket severity --------------------------------------------

def sig_ticket(facts: DataFrame, cfg: RunConfig) -> Signal:
    """Flag captains with any ticket in the removal tiers; one evidence row per tier."""
    per_tier = facts.select(KEY, *[_both(tier_col(t)).alias(t) for t in cfg.ticket_tiers_remove])
    long = per_tier.unpivot([KEY], list(cfg.ticket_tiers_remove), "tier", "ticket_count")
    flagged = long.where(F.col("ticket_count") > 0)
    m = facts.select(KEY, _both("ticket_rows").alias("ticket_rows"))
    return Signal(metrics=m, flagged=flagged, thresholds={})


# ---- Signal 3: reviews -----------------------------------------------------

def review_l2(facts: DataFrame, cfg: RunConfig) -> DataFrame:
    """L2 rate per gender of captains with >= 1 L2 from each gender."""
    l2f = F.coalesce(F.col(f"l2_rows_{FEMALE}"), F.lit(0))
    l2m = F.coalesce(F.col(f"l2_rows_{MALE}"), F.lit(0))
    rate_f = safe_ratio(l2f, F.col(f"rides_{FEMALE}"))
    rate_m = safe_ratio(l2m, F.col(f"rides_{MALE}"))
    return (facts.select(KEY, l2f.alias("l2_count_f"), l2m.alias("l2_count_m"),
                         F.col(f"rides_{FEMALE}").alias("total_rides_f"), F.col(f"rides_{MALE}").alias("total_rides_m"),
                         rate_f.alias("l2_rate_f"), rate_m.alias("l2_rate_m"))
            .withColumn("rate_diff", F.col("l2_rate_f") - F.col("l2_rate_m"))
            .where((F.col("l2_count_f") >= 1) & (F.col("l2_count_m") >= 1)))


def sig_review(facts: DataFrame, cfg: RunConfig, cuts: DataFrame) -> Signal:
    l2, cut = review_l2(facts, cfg), columns_of(cuts, "p95_l2_threshold")
    l2_flag = l2.where(F.col("rate_diff") >= cut["p95_l2_threshold"]).select(KEY, "rate_diff")
    per = (facts.select(KEY, _both("l0_rows").alias("l0_count"),
                        F.coalesce(F.col(f"l1_rows_{FEMALE}"), F.lit(0)).alias("l1_female_count"))
           .join(l2_flag, KEY, "left"))
    flagged = (per.withColumn("flag_l0", F.col("l0_count") > 0)
               .withColumn("flag_l1", F.col("l1_female_count") > 0)
               .withColumn("flag_l2", F.col("rate_diff").isNotNull())
               .where(F.col("flag_l0") | F.col("flag_l1") | F.col("flag_l2")))
    return Signal(metrics=l2, flagged=flagged, thresholds=cut)


# ---- Signal 4: calls -------------------------------------------------------

def calls_qualify(cfg: RunConfig) -> Column:
    return ((F.col(f"rides_{MALE}") >= cfg.min_rides_per_gender) & (F.col(f"rides_{FEMALE}") >= cfg.min_rides_per_gender)
            & (F.col(f"call_rate_{FEMALE}") > 0.0))


def calls_metrics(facts: DataFrame, cfg: RunConfig) -> DataFrame:
    f, m = FEMALE, MALE
    eps = F.lit(cfg.cv_eps)
    q = (facts.where(calls_qualify(cfg))
         .select(KEY,
                 F.col(f"rides_{f}").alias("ride_count_f"), F.col(f"rides_{m}").alias("ride_count_m"),
                 F.col(f"call_rate_{f}").alias("call_rate_f"), F.col(f"call_rate_{m}").alias("call_rate_m"),
                 F.col(f"avg_calls_{f}").alias("avg_calls_f"), F.col(f"avg_calls_{m}").alias("avg_calls_m"),
                 F.col(f"std_calls_{f}").alias("std_calls_f"), F.col(f"std_calls_{m}").alias("std_calls_m")))
    return (q.withColumn("call_rate_diff", F.col("call_rate_f") - F.col("call_rate_m"))
            .withColumn("calls_diff", F.col("avg_calls_f") - F.col("avg_calls_m"))
            .withColumn("cv_f", F.col("std_calls_f") / (F.col("avg_calls_f") + eps))
            .withColumn("cv_m", F.col("std_calls_m") / (F.col("avg_calls_m") + eps))
            .withColumn("cv_diff", F.when(F.col("call_rate_f") > cfg.cv_min_female_rate,
                                          F.col("cv_m") - F.col("cv_f"))))


def sig_calls(facts: DataFrame, cfg: RunConfig, cuts: DataFrame) -> Signal:
    m = calls_metrics(facts, cfg)
    cut = columns_of(cuts, "call_rate_threshold", "calls_diff_threshold", "cv_diff_threshold")
    scored = (m.withColumn("f1", breach(F.col("call_rate_diff"), cut["call_rate_threshold"]))
              .withColumn("f2", breach(F.col("calls_diff"), cut["calls_diff_threshold"]))
              .withColumn("f3", breach(F.col("cv_diff"), cut["cv_diff_threshold"]))
              .withColumn("breaches", vote_count([F.col("f1"), F.col("f2"), F.col("f3")])))
    flagged = scored.where(F.col("breaches") >= cfg.votes_needed)
    return Signal(metrics=m, flagged=flagged, thresholds=cut)


# ---- Signal 5: cancellations ------------------------------------------------

def cancel_sums(orders: DataFrame) -> DataFrame:
    """Per captain: captain-day cancel counts (repeated on each ride row) de-repeated by max, then summed."""
    return max_then_sum(orders, KEY, "order_date", OCARA_COLS, fill=0)


def _accepted(segment: str, suffix: str) -> Column:
    """Rides and cancels of a gender; a captain without cancel counts has 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{c}_{suffix}"), F.lit(0)) for c in ("cancels", "cc")],
                  F.col(f"rides_{segment}"))


def cancel_qualify(cfg: RunConfig) -> Column:
    return ((_accepted(FEMALE, "f") >= cfg.min_rides_per_gender) & (_accepted(MALE, "m") >= cfg.min_rides_per_gender))


def cancel_metrics(facts: DataFrame, cfg: RunConfig) -> DataFrame:
    """Accepted = rides + captain cancels + customer cancels per gender; rates and F-M diff.

    ``facts`` carries the ``cancel_sums`` columns (see ``SignalSet.facts``).
    """
    q = (facts.where(cancel_qualify(cfg))
         .select(KEY, F.col(f"rides_{FEMALE}").alias("rides_f"), F.col(f"rides_{MALE}").alias("rides_m"),
                 *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in OCARA_COLS],
                 _accepted(FEMALE, "f").alias("accepted_f"), _accepted(MALE, "m").alias("accepted_m")))
    return (q.withColumn("rate_f", F.try_divide("cancels_f", "accepted_f"))
            .withColumn("rate_m", F.try_divide("cancels_m", "accepted_m"))
            .withColumn("diff", F.col("rate_f") - F.col("rate_m")))


def sig_cancel(facts: DataFrame, cfg: RunConfig, cuts: DataFrame) -> Signal:
    m = cancel_metrics(facts, cfg)
    cut = columns_of(cuts, "p98_threshold", "p02_threshold", "upper_used", "lower_used")
    upper, lower = cut["upper_used"], cut["lower_used"]
    flagged = (m.where((F.col("diff") >= upper) | (F.col("diff") <= lower))
               .withColumn("direction", F.when(F.col("diff") >= upper, F.lit("avoids_female"))
                           .otherwise(F.lit("avoids_male"))))
    return Signal(metrics=m, flagged=flagged, thresholds=cut)


# ---- thresholds ---------------------------------------------------------------

def columns_of(row: DataFrame, *names: str) -> dict:
    """Columns of a one-row frame as scalar subqueries."""
    return {n: row.select(n).scalar() for n in names}


def thresholds(facts: DataFrame, cfg: RunConfig, materialize: bool = False) -> DataFrame:
    """One row with every threshold of signals 3-5, their quantiles found in one plan."""
    row = quantile_row(
        [(review_l2(facts, cfg), {"review": "rate_diff"}),
         (calls_metrics(facts, cfg), {"rate": "call_rate_diff", "vol": "calls_diff", "cv": "cv_diff"}),
         (cancel_metrics(facts, cfg), {"cancel": "diff"})],
        {"review": ("review", cfg.q_review), "rate": ("rate", cfg.q_calls), "vol": ("vol", cfg.q_calls),
         "cv": ("cv", cfg.q_calls), "high": ("cancel", cfg.q_cancel_hi), "low": ("cancel", cfg.q_cancel_lo)},
        materialize)
    cuts = row.select(
        F.coalesce("review", F.lit(cfg.review_default)).alias("p95_l2_threshold"),
        floor_at(F.col("rate"), cfg.floor_rate).alias("call_rate_threshold"),
        floor_at(F.col("vol"), cfg.floor_vol).alias("calls_diff_threshold"),
        floor_at(F.col("cv"), cfg.floor_cv).alias("cv_diff_threshold"),
        F.coalesce("high", F.lit(cfg.cancel_hi_default)).alias("p98_threshold"),
        F.coalesce("low", F.lit(cfg.cancel_lo_default)).alias("p02_threshold"))
    return cuts.withColumns({"upper_used": upper_tail(F.col("p98_threshold")),
                             "lower_used": lower_tail(F.col("p02_threshold"))})


def facts_counts(cfg: RunConfig) -> dict[str, Column]:
    """Aggregates over the facts table that the run's metrics show."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rude, rude_f = _both("rude_rows"), F.coalesce(F.col(f"rude_rows_{FEMALE}"), F.lit(0))
    tiers = [_both(tier_col(t)) > 0 for t in cfg.ticket_tiers_remove]
    return {"chat_captains": F.count_if(rude > 0), "female_incidents": total(rude_f), "male_incidents": total(rude - rude_f),
            "tickets_total": total(_both("ticket_rows")),
            "ticket_captains": F.count_if(reduce(lambda a, b: a | b, tiers, F.lit(False))),
            "ticket_rows": total(reduce(lambda a, b: a + b, [t.cast("int") for t in tiers], F.lit(0))),
            "calls_qualifying": F.count_if(calls_qualify(cfg)), "cancel_qualifying": F.count_if(cancel_qualify(cfg))}


class SignalSet:
    """The five signals over one per-captain facts table, each built on first use.

    ``store(df, label, counts)`` keeps a stage and takes its ``counts`` (name ->
    aggregate); with ``materialize`` the stages are parquet in the session's
    checkpoint folder: every signal, threshold and audit part reads the stored facts
    (one row per cohort captain), so the row-grain work runs once and the later
    plans stay small.
    """

    def __init__(self, orders: DataFrame, cfg: RunConfig, materialize: bool = True, store=None):
        self.orders, self.cfg, self.materialize = orders, cfg, materialize
        self._store = store or (lambda df, label, counts: materialize_stage(df, label) if materialize else df)

    @cached_property
    def calls_cap(self) -> Column:
        return calls_cap(self.orders, self.cfg, self.materialize)

    @cached_property
    def facts(self) -> DataFrame:
        f = captain_facts(self.orders, self.cfg, self.calls_cap).join(cancel_sums(self.orders), KEY, "left")
        return self._store(f, "captain-facts", facts_counts(self.cfg))

    @cached_property
    def cuts(self) -> DataFrame:
        return thresholds(self.facts, self.cfg, self.materialize)

    def _flagged(self, sig: Signal, label: str, **counts: Column) -> Signal:
        """Store a thresholded flagged set (small, per captain)."""
        return replace(sig, flagged=self._store(sig.flagged, f"flagged-{label}", {f"{label}_risky": F.count(F.lit(1)), **counts}))

    @cached_property
    def chat(self) -> Signal:
        return sig_chat(self.facts, self.cfg)  # no threshold: a projection of the stored facts

    @cached_property
    def ticket(self) -> Signal:
        return sig_ticket(self.facts, self.cfg)

    @cached_property
    def review(self) -> Signal:
        return self._flagged(sig_review(self.facts, self.cfg, self.cuts), "review",
                             **{f"{x}_flagged": F.count_if(f"flag_{x}") for x in ("l0", "l1", "l2")})

    @cached_property
    def calls(self) -> Signal:
        return self._flagged(sig_calls(self.facts, self.cfg, self.cuts), "calls")

    @cached_property
    def cancel(self) -> Signal:
        return self._flagged(sig_cancel(self.facts, self.cfg, self.cuts), "cancel")

    def ids(self) -> dict[str, DataFrame]:
        """Flagged captain ids per signal, in the risk-master column order."""
        return {
            "review": self.review.flagged.select(KEY),
            "calls": self.calls.flagged.select(KEY),
            "ocara": self.cancel.flagged.select(KEY),
            "ticket": self.ticket.flagged.select(KEY).distinct(),
            "inappchat": self.chat.flagged.select(KEY),
        }


def all_signals(orders: DataFrame, cfg: RunConfig, materialize: bool = True, store=None) -> SignalSet:
    return SignalSet(orders, cfg, materialize, store)
