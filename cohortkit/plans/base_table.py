"""Base-table build: eleven sources -> one order-grain wide table.

One function per named sub-query of the original SQL, each a lazy DataFrame.
Sources come in as a name -> DataFrame map (``t1`` .. ``t11``), so the same code
reads catalog tables on a cluster or the fixture views in tests.

Rewrites against the SQL as written (same rows):

* the three text-label sub-queries (three windows over three filtered copies
  of one join) are one ``groupBy(order, captain)`` with a conditional latest
  pick per input type;
* the two feedback sub-queries (two scans of the quality table and a full
  outer join) are one scan and one ``groupBy(order)`` with two conditional
  latest picks -- an order appears when either pick exists;
* inner joins whose right side is only an existence test are semi joins.

Day bounds are pushed into every source scan; the wide table keeps the order
log's grain because every right side is unique on its join key.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (CANCEL_EVENT_TYPES, LIVE_FEEDBACK_TAG, RATING_SCREEN_TAG, SERVICE_CLASS_DEFAULT,
                      SERVICE_CLASSES, TEXT_INPUT_TYPES, RunConfig)
from ..functions import first_match, isin_ci
from ..operators import keep, latest_per_key, latest_per_key_by_case
from ..session import at_once, materialize
from .bloom import Bloom, reduced, stored_ids
from .latest_state import SERVICE, SNAPSHOT, rows_of

Sources = Mapping[str, DataFrame]

WIDE_COLUMNS = (
    "order_id", "order_date", "captain_id", "customer_id", "customer_gender", "city_name",
    "customer_feedback_rating", "started_epoch", "customer_rated_epoch", "dropped_epoch", "order_status",
    "yyyymmdd", "riderinfo__servicenames", "service_type", "shift_name", "ride_city",
    "male_ocara_count_captainlevel", "female_ocara_count_captainlevel", "male_cc_count_captainlevel",
    "female_cc_count_captainlevel", "total_calls_doneby_captain",
    "chat_agent_input_type", "chat_agent_response_issue_type",
    "support_ticket_agent_input_type", "support_ticket_agent_response_issue_type",
    "post_ride_review_agent_input_type", "post_ride_review_agent_response_issue_type",
    "eventtime_rating_screen", "rating_screen_text", "rating_screen_feedback",
    "eventtime_livefeedback", "live_feedback_text", "live_feedback_feedback",
    "mobile",
)


def _days(col: str, cfg: RunConfig):
    return F.col(col).between(F.lit(cfg.day_from), F.lit(cfg.day_to))


def order_scope(src: Sources, cfg: RunConfig, days: tuple[str, str] | None = None) -> DataFrame:
    """``olf``: order log rows in the day range (or the part ``days`` of it), service category and cities."""
    t1 = src["t1"]
    if days:
        t1 = t1.where(F.col("yyyymmdd").between(F.lit(days[0]), F.lit(days[1])))
    return (t1.where(_days("yyyymmdd", cfg) & F.col("service_category").isin(list(cfg.service_categories))
                     & F.col("city").isin(list(cfg.city_ids)))
            .select("order_id", "order_date", "captain_id", "customer_id",
                    F.col("customer_obj_gender").alias("customer_gender"), "city_name",
                    "customer_feedback_rating", "started_epoch", "customer_rated_epoch", "dropped_epoch",
                    "order_status", "yyyymmdd"))


def captain_base(olf: DataFrame) -> DataFrame:
    return olf.select("captain_id").where(F.col("captain_id").isNotNull()).distinct()


def captain_days(olf: DataFrame) -> DataFrame:
    """(captain, day) pairs of the order log."""
    return olf.select("captain_id", "yyyymmdd").where(F.col("captain_id").isNotNull()).distinct()


def service_history(src: Sources) -> DataFrame:
    return src["t2"].withColumnRenamed("riderinfo__userid", "captain_id")


def latest_service(src: Sources, base: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Latest service-names row per captain (ranked before the class filter) and its class.

    With ``state`` (a stored ``latest_state.SERVICE``) the history is not read.
    """
    if state is None:
        last = latest_per_key(keep(service_history(src), base, SERVICE.key), [SERVICE.key], order=SERVICE.order,
                              payload=SERVICE.payload)
    else:
        last = keep(rows_of(state, SERVICE), base, SERVICE.key)
    return last.withColumn("service_type", first_match(F.col("riderinfo__servicenames"), SERVICE_CLASSES,
                                                       SERVICE_CLASS_DEFAULT))


def service_class(src: Sources) -> DataFrame:
    """Class of every distinct service-names value (the ordered keyword rule)."""
    names = src["t2"].select("riderinfo__servicenames").distinct()
    return names.withColumn("service_type", first_match(F.col("riderinfo__servicenames"), SERVICE_CLASSES,
                                                        SERVICE_CLASS_DEFAULT))


def active_snapshots(src: Sources) -> DataFrame:
    return src["t3"].withColumnRenamed("_id", "captain_id").where(F.col("active") == True)  # noqa: E712


def rider_snapshot(src: Sources, base: DataFrame, cfg: RunConfig, state: DataFrame | None = None) -> DataFrame:
    """Latest *active* snapshot row per captain, kept when its city is in scope; from ``state``
    (a stored ``latest_state.SNAPSHOT``) if given."""
    if state is None:
        last = latest_per_key(keep(active_snapshots(src), base, SNAPSHOT.key), [SNAPSHOT.key], order=SNAPSHOT.order,
                              payload=SNAPSHOT.payload)
    else:
        last = keep(rows_of(state, SNAPSHOT), base, SNAPSHOT.key)
    return last.where(F.col("city").isin(list(cfg.city_ids)))


def mode_captains(src: Sources, base: DataFrame, cfg: RunConfig) -> DataFrame:
    t4 = src["t4"].where(F.col("mode_id") == cfg.mode_id).select("captain_id")
    return keep(t4, base, "captain_id").distinct()


def captain_mapping(src: Sources, olf: DataFrame, cfg: RunConfig, states: Sources | None = None,
                    bloom: Bloom | None = None) -> DataFrame:
    """Captains whose latest class is not 'others', with an in-scope active snapshot and the mode.

    ``states``: stored latest rows for t2 and t3, by those names, read in place of the histories.
    ``bloom``: the captains are stored first, so that ``reduced`` plans can filter t2, t3 and t4 by them.
    """
    base, states = captain_base(olf), states or {}
    if bloom:
        base = stored_ids(base, "captain-ids")
    csi = latest_service(src, base, states.get("t2")).where(F.col("service_type") != SERVICE_CLASS_DEFAULT)
    rs = rider_snapshot(src, base, cfg, states.get("t3"))
    csj = mode_captains(src, base, cfg)
    cm = keep(csi.join(rs, "captain_id", "inner"), csj, "captain_id")
    return cm.select(F.col("captain_id").alias("cm_captain_id"), "riderinfo__servicenames", "service_type",
                     "shift_name", F.col("city").alias("ride_city"), "mobile")


def cancel_counts(src: Sources, cfg: RunConfig) -> DataFrame:
    """One cancel event per order (latest day), then four counts per captain-day."""
    t5 = src["t5"]
    ev = t5.where(_days("yyyymmdd", cfg) & isin_ci(F.col("city"), cfg.city_names)
                  & isin_ci(F.col("service"), cfg.cancel_services)
                  & isin_ci(F.col("event_type"), CANCEL_EVENT_TYPES)
                  & (F.lower(F.col("customer_gender")) != "unknown"))
    one = latest_per_key(ev, ["order_id"], order=["yyyymmdd"], ties=["captain_id", "event_type", "customer_gender"],
                         payload=["yyyymmdd", "captain_id", "event_type", "customer_gender"])
    g = F.lower(F.col("customer_gender"))
    e = F.col("event_type")
    return one.groupBy(F.col("yyyymmdd").alias("ocara_yyyymmdd"), F.col("captain_id").alias("ocara_captain_id")).agg(
        F.count_if((g == "male") & (e == "rider_cancelled")).alias("male_ocara_count_captainlevel"),
        F.count_if((g == "female") & (e == "rider_cancelled")).alias("female_ocara_count_captainlevel"),
        F.count_if((g == "male") & (e == "customer_cancelled")).alias("male_cc_count_captainlevel"),
        F.count_if((g == "female") & (e == "customer_cancelled")).alias("female_cc_count_captainlevel"),
    )


def calls_per_order(src: Sources, cfg: RunConfig) -> DataFrame:
    t6 = src["t6"]
    return (t6.where(_days("yyyymmdd", cfg) & isin_ci(F.col("eventprops__city"), cfg.city_names))
            .groupBy(F.col("eventprops__orderid").alias("cd_order_id"))
            .agg(F.count_distinct("eventid").alias("total_calls_doneby_captain")))


TEXT_PREFIX = {"CHAT": "chat", "SUPPORT_TICKET": "support_ticket", "POST_RIDE_REVIEW": "post_ride_review"}


def text_labels(src: Sources, cfg: RunConfig) -> DataFrame:
    """Latest non-null label per (order, captain) for each of the three input types, one pass."""
    out = (src["t7"].where(_days("yyyymmdd", cfg) & F.col("response__issue_type").isNotNull())
           .select("row_id", "response__issue_type"))
    inp = (src["t8"].where(_days("yyyymmdd", cfg) & isin_ci(F.col("city_name"), cfg.city_names)
                           & isin_ci(F.col("input_type"), TEXT_INPUT_TYPES, upper=True)
                           & F.col("order_id").isNotNull() & F.col("captain_id").isNotNull())
           .select("row_id", "order_id", "captain_id", F.upper("input_type").alias("input_type"), "yyyymmdd"))
    joined = inp.join(out, "row_id", "inner")
    cases = {TEXT_PREFIX[t]: F.col("input_type") == t for t in TEXT_INPUT_TYPES}
    picked = latest_per_key_by_case(joined, ["order_id", "captain_id"], cases, order=["yyyymmdd"],
                                    ties=["row_id"], payload=["response__issue_type"])
    cols = []
    for t in TEXT_INPUT_TYPES:
        p = TEXT_PREFIX[t]
        cols += [F.when(F.col(p).isNotNull(), F.lit(t)).alias(f"{p}_agent_input_type"),
                 F.col(p)["response__issue_type"].alias(f"{p}_agent_response_issue_type")]
    return picked.select("order_id", "captain_id", *cols)


def feedback_merge(src: Sources, cfg: RunConfig) -> DataFrame:
    """Latest live-feedback and latest rating-screen answer per order (either may be missing)."""
    users = src["t10"].select(F.col("_id").alias("data__customerid"))
    sdi = (src["t9"].where(F.col("service_level").isin(list(cfg.service_levels))
                           & isin_ci(F.col("city_display_name"), cfg.city_names))
           .select(F.col("service_detail_id").alias("data__servicedetail")))
    live = F.col("data__additionalfeedback") == LIVE_FEEDBACK_TAG
    rating = F.col("data__screen") == RATING_SCREEN_TAG
    q = (src["t11"].where(F.col("yyyymmdd").between(F.lit(cfg.day_from), F.lit(cfg.day_to))
                          & F.col("data__feedback").isNotNull()
                          & F.col("data__questionid").isin(list(cfg.question_ids))
                          & (live | rating)))
    q = keep(keep(q, users, "data__customerid"), sdi, "data__servicedetail")
    picked = latest_per_key_by_case(q, ["data__orderid"], {"rs": rating, "lf": live}, order=["eventtime"],
                                    payload=["data__text", "data__feedback"])
    return picked.select(
        F.col("data__orderid").alias("newfeedback_order_id"),
        F.col("rs")["eventtime"].alias("eventtime_rating_screen"),
        F.col("rs")["data__text"].alias("rating_screen_text"),
        F.col("rs")["data__feedback"].alias("rating_screen_feedback"),
        F.col("lf")["eventtime"].alias("eventtime_livefeedback"),
        F.col("lf")["data__text"].alias("live_feedback_text"),
        F.col("lf")["data__feedback"].alias("live_feedback_feedback"),
    )


@dataclass(frozen=True)
class Sides:
    """What a build takes from the sources other than the order log, over the whole range and for any order days."""
    states: Sources  # latest rows of t2 and t3, see ``captain_mapping``
    cancels: DataFrame
    calls: DataFrame
    labels: DataFrame
    answers: DataFrame


def stored_sides(src: Sources, cfg: RunConfig) -> Sides:
    """The sides, stored: several builds over the same sources (``refresh_days``) then work them out once."""
    sides = {"labels": text_labels(src, cfg), "answers": feedback_merge(src, cfg), "calls": calls_per_order(src, cfg),
             "cancels": cancel_counts(src, cfg), "t2": SERVICE.reduce(service_history(src)),
             "t3": SNAPSHOT.reduce(active_snapshots(src))}
    done = at_once({name: partial(materialize, df, f"side-{name}") for name, df in sides.items()})
    return Sides({n: done.pop(n) for n in ("t2", "t3")}, **done)


def captain_day_facts(src: Sources, olf: DataFrame, cfg: RunConfig, states: Sources | None = None,
                      bloom: Bloom | None = None, cancels: DataFrame | None = None) -> DataFrame:
    """Mapping and cancel counts (``cancels`` if given) of every (captain, day) of the order log whose captain is mapped."""
    days = materialize(captain_days(olf), "captain-days")
    cm = captain_mapping(src, days, cfg, states, bloom)
    oc = cancel_counts(src, cfg) if cancels is None else cancels
    d = days.join(cm, days.captain_id == cm.cm_captain_id, "inner").drop("cm_captain_id")
    d = d.join(oc, (d.captain_id == oc.ocara_captain_id) & (d.yyyymmdd == oc.ocara_yyyymmdd), "left")
    return (d.drop("ocara_captain_id", "ocara_yyyymmdd")
            .withColumnsRenamed({"captain_id": "cf_captain_id", "yyyymmdd": "cf_yyyymmdd"}))


def build_base_table(src: Sources, cfg: RunConfig, days: tuple[str, str] | None = None, by_order: bool = False,
                     states: Sources | None = None, bloom: Bloom | None = None, sides: Sides | None = None) -> DataFrame:
    """The 33-column order-grain table (+ ``mobile``), of all days or of the order days ``days`` (first, last).

    The side tables are always read over the whole range: an order's labels, calls
    and answers may be of a later day than the order.

    Captain mapping and cancel counts meet at the narrow (captain, day) grain, so
    the order rows are shuffled for both at once, and a hot captain by its days.
    That table is stored: the join with it has a plain shuffle on both sides,
    which adaptive execution can split further.

    ``by_order``: the order log is bucketed by order id (``sources.bucketed``).  The
    joins by order then come first and read it in place, and the order rows move once,
    by (captain, day).  The labels' join by (order, captain) uses the buckets only
    where ``spark.sql.requireAllClusterKeysForCoPartition`` is false; otherwise the
    order rows move for it as well.  Without buckets the captain join comes first, as
    it drops the rows of unmapped captains before the other shuffles.

    ``states``: see ``captain_mapping``.

    ``bloom``: histories and answers pass a Bloom filter of the ids they are joined with
    before they are shuffled (t2 and t3 by captain, t11 by service detail).  The answers
    are then stored, as the filter is made only in plans that run in here.

    ``sides``: ``stored_sides`` of the same sources and configuration, read in place of all sources but the
    order log and t4.
    """
    olf = order_scope(src, cfg, days)
    if sides and states is None:
        states = sides.states
    with reduced(olf.sparkSession, bloom):
        cf = materialize(captain_day_facts(src, olf, cfg, states, bloom, sides and sides.cancels), "captain-day-facts")
    cd = sides.calls if sides else calls_per_order(src, cfg)
    tl = sides.labels if sides else text_labels(src, cfg)
    tl = tl.withColumnsRenamed({"order_id": "tl_order_id", "captain_id": "tl_captain_id"})
    nf = sides.answers if sides else feedback_merge(src, cfg)
    if bloom and not sides:
        with reduced(olf.sparkSession, bloom):
            nf = materialize(nf, "feedback")

    def with_captain_day(w: DataFrame) -> DataFrame:
        return w.join(cf, (w.captain_id == cf.cf_captain_id) & (w.yyyymmdd == cf.cf_yyyymmdd), "inner")

    w = olf if by_order else with_captain_day(olf)
    w = w.join(cd, w.order_id == cd.cd_order_id, "left")
    w = w.join(nf, w.order_id == nf.newfeedback_order_id, "left")
    w = w.join(tl, (w.order_id == tl.tl_order_id) & (w.captain_id == tl.tl_captain_id), "left")
    return (with_captain_day(w) if by_order else w).select(*WIDE_COLUMNS)


def refresh_days(src: Sources, cfg: RunConfig, path: str, first: str, last: str, sides: Sides | None = None) -> None:
    """Build the order days ``first`` .. ``last`` of the wide table at ``path`` anew; other days stay as they are.
    ``sides``: see ``build_base_table``.

    The table is partitioned by day, and only the partitions written are replaced, so
    a rerun gives the same table.  A day whose orders have all gone from the sources
    writes nothing and keeps its old partition.
    """
    (build_base_table(src, cfg, (first, last), sides=sides).repartition("yyyymmdd", F.pmod(F.xxhash64("order_id"), F.lit(8)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yyyymmdd").parquet(path))
