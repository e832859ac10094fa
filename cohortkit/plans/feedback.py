"""Explicit-feedback exclusion rules.

Both rules count *distinct orders* with a female answer, in total and per answer, over
the scoped orders (all captains, no upper date bound).  The counts come from the
one pass of ``plans.scope``; here are the rules on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig

KEY = "captain_id"


def _counts(rule: str) -> list[Column]:
    return [F.col(f"{rule}_{n}").alias(f"{n}_count") for n in ("total", "yes", "no")]


def pct_yes(rule: str) -> Column:
    """Share of yes orders in percent; null without an answered order."""
    return F.round(F.try_divide(f"{rule}_yes", F.col(f"{rule}_total")) * F.lit(100), 2)


def live_excluded(cfg: RunConfig) -> Column:
    """More than ``live_min_total`` answered orders and any 'No'."""
    return (F.col("live_total") > cfg.live_min_total) & (F.col("live_no") > 0)


def rating_excluded(cfg: RunConfig) -> Column:
    """More than ``rating_min_total`` answered orders and %yes below the cut."""
    return (F.col("rating_total") > cfg.rating_min_total) & F.coalesce(pct_yes("rating") < F.lit(cfg.rating_min_pct_yes),
                                                                       F.lit(False))


def fb_live(scope: DataFrame, cfg: RunConfig) -> DataFrame:
    """Live feedback of every captain with an answered order."""
    return scope.where(F.col("live_total") > 0).select(KEY, *_counts("live"), live_excluded(cfg).alias("excluded"))


def fb_rating(scope: DataFrame, cfg: RunConfig) -> DataFrame:
    """Rating screen of every captain with an answered order."""
    return scope.where(F.col("rating_total") > 0).select(
        KEY, *_counts("rating"), pct_yes("rating").alias("pct_yes"), rating_excluded(cfg).alias("excluded"))


def feedback_ids(scope: DataFrame, cfg: RunConfig) -> DataFrame:
    """Captains that either rule excludes."""
    return scope.where(live_excluded(cfg) | rating_excluded(cfg)).select(KEY)
