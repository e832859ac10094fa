"""One pass over the scoped orders for everything that is needed per captain.

Cohort statistics, both feedback rules' distinct answered orders, the latest metadata
and the row counts all read the same scoped rows.  Here they are one aggregate in
two steps, so the wide table is scanned once for them:

* by (captain, answered order): an order counts once however many rows carry it.
  Rows without a female answer share one group of their captain, so the partial
  aggregate reduces them to a row a captain and task before the shuffle; only
  answered orders move one by one, and a hot captain's spread over its orders.
* by captain: sums of the first step, and the latest of its latest structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import ts_lit
from ..operators import latest_struct

KEY = "captain_id"
META = ("service_type", "mobile", "shift_name")
STATS = ("female_total_rides", "female_rated_rides", "bad_female_ratings")


def answers(cfg: RunConfig) -> dict[str, tuple[Column, Column, Column]]:
    """Per rule: the answer, and whether it is a yes or a no."""
    live, rating = F.col("live_feedback_feedback"), F.col("rating_screen_feedback")
    return {"live": (live, live == "Yes", live == cfg.no_label),
            "rating": (rating, rating.isin(list(cfg.yes_labels)), rating == cfg.no_label)}


def captain_scope(scoped: DataFrame, cfg: RunConfig) -> DataFrame:
    """One row per captain of the scoped orders: row counts, activity, female counts, answered orders, metadata.

    The upper date bound of the six-month base holds for ``base_rows``, ``active``
    and the female counts alone; answers and metadata have none.
    """
    female = F.col("customer_gender") == cfg.female_code
    base = F.col("order_date") <= ts_lit(cfg.as_of)
    rated = F.col("customer_feedback_rating")
    given = {k: female & a.isNotNull() for k, (a, _, _) in answers(cfg).items()}
    answered = given["live"] | given["rating"]
    firsts = [
        F.count(F.lit(1)).alias("scoped_rows"),
        F.count_if(base).alias("base_rows"),
        F.max(base & (F.col("order_date") >= ts_lit(cfg.active_start))).alias("active"),
        F.count_if(base & female).alias("female_total_rides"),
        F.count_if(base & female & rated.isin(list(cfg.rated_values))).alias("female_rated_rides"),
        F.count_if(base & female & rated.isin(list(cfg.bad_values))).alias("bad_female_ratings"),
        latest_struct(["order_date"], ["order_id"], META).alias("latest"),
    ]
    seconds = [*[F.sum(c).alias(c) for c in ("scoped_rows", "base_rows", *STATS)], F.max("active").alias("active"),
               F.max("latest").alias("latest")]
    for k, (_, yes, no) in answers(cfg).items():
        for name, hit in (("total", given[k]), ("yes", given[k] & yes), ("no", given[k] & no)):
            firsts.append(F.max(hit).alias(f"{k}_{name}"))
            seconds.append(F.count_if(f"{k}_{name}").alias(f"{k}_{name}"))
    per_order = scoped.groupBy(KEY, answered.alias("_answered"), F.when(answered, F.col("order_id")).alias("_order")).agg(*firsts)
    one = per_order.groupBy(KEY).agg(*seconds)
    return one.select(KEY, *[c for c in one.columns if c not in (KEY, "latest")], *[F.col("latest")[m].alias(m) for m in META])


def eligible(cfg: RunConfig) -> Column:
    """Active, enough female rides and ratings, none bad."""
    return (F.col("active") & (F.col("female_total_rides") >= cfg.female_min_rides) & (F.col("female_total_rides") > 0)
            & (F.col("female_rated_rides") >= cfg.female_min_rated) & (F.col("bad_female_ratings") == 0))
