"""Read scope, normalisation and the eligible cohort.

``scoped_orders`` is the script's ``df`` (pushed-down scope + type fixes),
``base_orders`` its six-month dropped base, ``eligible_cohort`` the captain
cohort and its orders.  Everything stays lazy; the filters on ``ride_city``,
``order_status`` and ``order_date`` reach the parquet scan as pushed filters.

Per-captain cohort rules come from the one pass of ``plans.scope``, which also
serves the feedback rules, the metadata and the run's counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import RunConfig
from ..functions import lenient_double, lenient_int, lenient_timestamp, ts_lit
from ..operators import keep
from .scope import STATS, captain_scope, eligible

SEG = "gender"  # derived two-value segment column: Female / Male
FEMALE, MALE = "Female", "Male"
SEGMENTS = {FEMALE: "Female", MALE: "Male"}


def normalize(df: DataFrame) -> DataFrame:
    """Type fixes on read: ids as text, lenient numeric casts, text or timestamp dates."""
    date_is_text = isinstance(df.schema["order_date"].dataType, StringType)
    fixes = {
        "captain_id": F.col("captain_id").cast("string"),
        "order_id": F.col("order_id").cast("string"),
        "order_date": lenient_timestamp(F.col("order_date"), date_is_text),
        "customer_gender": lenient_int(F.col("customer_gender")),
        "customer_feedback_rating": lenient_double(F.col("customer_feedback_rating")),
        "total_calls_doneby_captain": lenient_double(F.col("total_calls_doneby_captain")),
    }
    return df.withColumns({k: v for k, v in fixes.items() if k in df.columns})


def scoped_orders(wide: DataFrame, cfg: RunConfig) -> DataFrame:
    """The script's ``df``: scope filter (city, dropped, date >= window start), known genders.

    No upper date bound and all captains (not only the cohort): the feedback
    rules and the metadata pick read this frame.

    Text dates are first compared as text with the ISO start day (pushed to the
    scan, and true for every date that parses to the window), then parsed
    leniently: a malformed value becomes null and its row is dropped.
    """
    if isinstance(wide.schema["order_date"].dataType, StringType):
        since = F.col("order_date") >= cfg.window_start.strftime("%Y-%m-%d")
    else:
        since = F.col("order_date") >= ts_lit(cfg.window_start)
    scope = F.col("ride_city").isin(list(cfg.city_ids)) & (F.col("order_status") == cfg.dropped_status) & since
    return (normalize(wide.where(scope))
            .where((F.col("order_date") >= ts_lit(cfg.window_start))
                   & F.col("customer_gender").isin([cfg.male_code, cfg.female_code])))


def base_orders(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """Six-month dropped base in the cities, upper bound midnight of ``as_of``."""
    return df.where((F.col("order_date") >= ts_lit(cfg.window_start))
                    & (F.col("order_date") <= ts_lit(cfg.as_of))
                    & (F.col("order_status") == cfg.dropped_status)
                    & F.col("ride_city").isin(list(cfg.city_ids)))


def with_segment(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """``gender`` label: female code -> Female, anything else -> Male."""
    return df.withColumn(SEG, F.when(F.col("customer_gender") == cfg.female_code, F.lit(FEMALE))
                         .otherwise(F.lit(MALE)))


@dataclass(frozen=True)
class Cohort:
    scoped: DataFrame  # script df
    base: DataFrame  # six-month dropped base
    scope: DataFrame  # everything needed per captain of ``scoped``, from one pass
    stats: DataFrame  # female stats per active captain
    ids: DataFrame  # eligible captain ids
    orders: DataFrame  # base rows of eligible captains (with ``gender``)


def eligible_cohort(wide: DataFrame, cfg: RunConfig, store=lambda df: df) -> Cohort:
    """``store`` keeps the per-captain pass, so that every later step reads it and not the wide table.

    ``stats`` has the captains active in the last ``active_months`` with a female
    ride in the base (others are absent, as in a group-by over female rows).
    """
    df = scoped_orders(wide, cfg)
    base = base_orders(df, cfg)
    scope = store(captain_scope(df, cfg))
    stats = scope.where(F.col("active") & (F.col("female_total_rides") > 0)).select("captain_id", *STATS)
    ids = scope.where(eligible(cfg)).select("captain_id")
    orders = with_segment(keep(base, ids, "captain_id"), cfg)
    return Cohort(scoped=df, base=base, scope=scope, stats=stats, ids=ids, orders=orders)
