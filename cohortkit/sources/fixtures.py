"""Source tables of the job, derived from the TPC-H-shaped test tables.

The real inputs are private warehouse tables.  These views give each of them a
deterministic stand-in built from ``/root/testdata/sf*/``: ``t1``..``t11`` feed
the base-table build, ``w1`` is a direct order-grain wide table for the scoring
part (all suppliers act as captains, so the signals have enough captains).

Every rule is an arithmetic function of TPC-H keys, so the DuckDB oracle views
(``cohortkit.oracle.fixtures_sql``) compute the same rows.  Nothing here
collects or loops: each view is a lazy plan over the given parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _day(ts: Column) -> Column:
    """``date_format`` as ``yyyyMMdd``, for four-digit years from the date's own text, which costs less a row."""
    d = ts.cast("date")
    plain = d.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date"))
    return F.when(plain, F.replace(d.cast("string"), F.lit("-"), F.lit(""))).otherwise(F.date_format(d, "yyyyMMdd"))


def _epoch(ts: Column) -> Column:
    return (F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * F.lit(86400))


def f_rides(t: dict[str, DataFrame]) -> DataFrame:
    """lineitem x orders x supplier x nation x region with the shared keys.

    Each dimension joins the fact side directly (not pre-joined to each other):
    a single-table side keeps its file-size statistics, so the planner
    broadcasts it while small and falls back to a sort-merge join when the
    table grows with the scale factor -- no hint needed.
    """
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
                              "l_linestatus", "l_shipdate")
    o = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    sup = t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nat = t["nation"].select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    reg = t["region"].select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return (li.join(o, "l_orderkey").join(sup, "l_suppkey").join(nat, "s_nationkey").join(reg, "n_regionkey")
            .withColumn("day", _day(F.col("l_shipdate"))))


def _with_ids(fr: DataFrame) -> DataFrame:
    """The rides with their text ids: made from the keys where they are read, not stored beside them."""
    return (fr.withColumn("oid", F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber")))
            .withColumn("cap", _s("l_suppkey")))


def _rating(c=F.col) -> Column:
    return (F.when(c("l_partkey") % 3 == 0, F.lit(None).cast("double"))
            .when((c("l_partkey") + c("l_linenumber")) % 97 == 0, F.lit(2.0))
            .otherwise((F.lit(4) + c("l_linenumber") % 2).cast("double")))


def _status() -> Column:
    return F.when(F.col("l_returnflag") == "N", "cancelled").otherwise("dropped")


def _chat_label() -> Column:
    return (F.when((F.col("l_partkey") + F.col("l_orderkey")) % 211 == 0, "rude behavior")
            .when(F.col("l_partkey") % 5 == 0, "No issue"))


def _review_label() -> Column:
    m = (F.col("l_orderkey") + F.col("l_partkey")) % 307
    return (F.when((F.col("l_orderkey") + 7 * F.col("l_linenumber") + F.col("l_partkey")) % 9 == 0, "L2_MEDIUM")
            .when(m == 1, "L0_HIGHEST_THREAT")
            .when(m < 4, "L1_HIGH_CONCERN")
            .when(F.col("l_partkey") % 7 == 0, "L3_POSITIVE"))


def _ticket_label(mod_below: int) -> Column:
    return F.when((3 * F.col("l_orderkey") + F.col("l_partkey")) % 251 < mod_below,
                  F.concat(F.lit("P"), _s(F.col("l_partkey") % 4)))


def _live_answer() -> Column:
    return F.when(F.col("l_orderkey") % 23 == 0, "No").otherwise("Yes")


def _rating_answer() -> Column:
    return (F.when(F.col("l_orderkey") % 17 == 0, "No")
            .when(F.col("l_orderkey") % 2 == 0, "Yes, I felt safe!")
            .otherwise("Yes"))


def stored_rides(t: dict[str, DataFrame], store: bool) -> DataFrame:
    """``f_rides`` written once to the checkpoint folder (several views derive from it)."""
    fr = f_rides(t)
    if not store:
        return _with_ids(fr)
    from ..session import materialize

    return _with_ids(materialize(fr, "f-rides"))


def source_views(spark: SparkSession, sf_dir: str, store: bool = True) -> dict[str, DataFrame]:
    """The eleven source tables t1..t11 (schemas of FIXTURES.md section 1)."""
    t = read_tables(spark, sf_dir)
    fr = stored_rides(t, store)
    v: dict[str, DataFrame] = {}
    v["t1"] = fr.select(
        F.col("oid").alias("order_id"),
        F.col("l_shipdate").alias("order_date"),
        F.col("cap").alias("captain_id"),
        _s("o_custkey").alias("customer_id"),
        F.when(F.col("o_custkey") % 29 == 0, F.lit(2)).otherwise(F.col("o_custkey") % 2).cast("int")
        .alias("customer_obj_gender"),
        F.col("r_name").alias("city_name"),
        _rating().alias("customer_feedback_rating"),
        _epoch(F.col("l_shipdate")).alias("started_epoch"),
        F.when(F.col("l_partkey") % 3 != 0, _epoch(F.col("l_shipdate")) + 3600).alias("customer_rated_epoch"),
        (_epoch(F.col("l_shipdate")) + 1800).alias("dropped_epoch"),
        _status().alias("order_status"),
        F.col("day").alias("yyyymmdd"),
        F.when(F.col("l_partkey") % 13 == 0, "auto").otherwise("link").alias("service_category"),
        F.col("r_name").alias("city"),
    )
    ev = t["events"]
    v["t2"] = ev.select(
        _s("user_id").alias("riderinfo__userid"),
        F.when(F.col("event_type") == "purchase", "Bike Rated by Women,Link")
        .when(F.col("event_type") == "view", "Scooty")
        .when(F.col("event_type") == "click", "Bike")
        .when(F.col("event_type") == "error", "Link")
        .when(F.col("event_type") == "signup", "Auto").alias("riderinfo__servicenames"),
        F.col("ts").alias("updated_epoch"),
    )
    sup = t["supplier"].select(F.col("s_suppkey").alias("user_id"), "s_nationkey")
    nat = t["nation"].select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    reg = t["region"].select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    v["t3"] = (ev.join(sup, "user_id").join(nat, "s_nationkey").join(reg, "n_regionkey").select(
        _s("user_id").alias("_id"),
        F.concat(F.lit("SHIFT_"), _s(F.col("event_id") % 6)).alias("shift_name"),
        F.concat(F.lit("000-"), _s("user_id")).alias("mobile"),
        F.col("r_name").alias("city"),
        F.col("ts").alias("created_on"),
        (F.col("event_id") % 5 != 0).alias("active"),
    ))
    v["t4"] = t["supplier"].select(
        _s("s_suppkey").alias("captain_id"),
        F.when(F.col("s_suppkey") % 12 == 11, "mode_other").otherwise("mode_link").alias("mode_id"),
    )
    v["t5"] = fr.filter(F.col("l_returnflag") == "N").select(
        F.col("oid").alias("order_id"),
        F.col("cap").alias("captain_id"),
        F.when(F.col("l_linestatus") == "F", "customer_cancelled")
        .when(F.col("l_partkey") % 41 == 0, "RIDER_CANCELLED")
        .otherwise("rider_cancelled").alias("event_type"),
        F.when(F.col("o_custkey") % 31 == 0, "unknown")
        .when(F.col("o_custkey") % 2 == 1, "Female").otherwise("male").alias("customer_gender"),
        F.col("day").alias("yyyymmdd"),
        F.col("r_name").alias("city"),
        F.lit("Link").alias("service"),
    )
    n_calls = (F.col("l_orderkey") % 7) * (F.col("l_linenumber") % 2)
    v["t6"] = (fr.filter((F.col("l_partkey") + F.col("o_custkey") % 2) % 4 == 0)
               .select("oid", "day", "r_name", F.explode(F.sequence(F.lit(0).cast("long"), n_calls)).alias("n"))
               .select(F.col("oid").alias("eventprops__orderid"),
                       F.concat(F.col("oid"), F.lit("-"), _s("n")).alias("eventid"),
                       F.col("day").alias("yyyymmdd"),
                       F.col("r_name").alias("eventprops__city")))
    types = F.array(F.lit("chat"), F.lit("Support_Ticket"), F.lit("post_ride_review"))
    tx = fr.select("*", F.explode(types).alias("typ"))
    row_id = F.concat(F.col("oid"), F.lit("|"), _s("l_partkey"), F.lit("|"), F.col("typ"))
    v["t8"] = tx.select(
        row_id.alias("row_id"),
        F.col("r_name").alias("city_name"),
        F.col("day").alias("yyyymmdd"),
        F.col("oid").alias("order_id"),
        F.col("cap").alias("captain_id"),
        F.col("typ").alias("input_type"),
    )
    v["t7"] = tx.select(
        row_id.alias("row_id"),
        F.col("day").alias("yyyymmdd"),
        F.when(F.col("typ") == "chat", _chat_label())
        .when(F.col("typ") == "Support_Ticket", _ticket_label(4))
        .otherwise(_review_label()).alias("response__issue_type"),
    )
    nat = t["nation"].join(t["region"], t["nation"].n_regionkey == t["region"].r_regionkey)
    v["t9"] = nat.select(
        F.element_at(F.array(*[F.lit(x) for x in ("Link", "Scooty", "Bike Rated by Women", "Auto")]),
                     (F.col("n_nationkey") % 4 + 1).cast("int")).alias("service_level"),
        F.col("r_name").alias("city_display_name"),
        F.concat(F.lit("sd"), _s("n_nationkey")).alias("service_detail_id"),
    )
    v["t10"] = t["customer"].select(_s("c_custkey").alias("_id"), (F.col("c_custkey") % 3).cast("int").alias("gender"))
    live = F.col("l_partkey") % 6 == 0
    rating = F.col("l_partkey") % 5 == 0
    v["t11"] = fr.filter(live | rating).select(
        F.col("oid").alias("data__orderid"),
        F.col("l_shipdate").alias("eventtime"),
        F.concat(F.lit("text_"), _s("l_partkey")).alias("data__text"),
        F.when(live, _live_answer()).otherwise(_rating_answer()).alias("data__feedback"),
        _s("o_custkey").alias("data__customerid"),
        F.concat(F.lit("sd"), _s("s_nationkey")).alias("data__servicedetail"),
        F.when(live, F.lit("liveFeedback")).alias("data__additionalfeedback"),
        F.when(rating, F.lit("ratings")).alias("data__screen"),
        F.concat(F.lit("q"), _s(F.col("l_linenumber") % 8)).alias("data__questionid"),
        F.col("day").alias("yyyymmdd"),
    )
    return v


def wide_view(spark: SparkSession, sf_dir: str, store: bool = False) -> DataFrame:
    """``w1``: order-grain wide table straight from lineitem x orders.

    Same 33 columns (+ ``mobile``) as the base-table build, but every supplier
    is a captain and every label is drawn per line, so the scoring part sees
    enough captains.  Cancel counts are per captain-day from ``l_returnflag='N'``
    lines (``O`` = captain cancelled, ``F`` = customer cancelled).
    """
    t = read_tables(spark, sf_dir)
    fr = stored_rides(t, store).withColumn("g", (F.col("o_custkey") % 2).cast("int"))
    fem = F.col("g") == 1
    cancelled = fr.filter(F.col("l_returnflag") == "N")
    cancels = cancelled.groupBy(F.col("cap").alias("c_cap"), F.col("day").alias("c_day")).agg(
        F.count_if(~fem & (F.col("l_linestatus") == "O")).alias("male_ocara_count_captainlevel"),
        F.count_if(fem & (F.col("l_linestatus") == "O")).alias("female_ocara_count_captainlevel"),
        F.count_if(~fem & (F.col("l_linestatus") == "F")).alias("male_cc_count_captainlevel"),
        F.count_if(fem & (F.col("l_linestatus") == "F")).alias("female_cc_count_captainlevel"),
    )
    calls = F.when((F.col("l_partkey") + F.col("o_custkey") % 2) % 4 == 0,
                   F.lit(1) + (F.col("l_orderkey") % 7) * (F.col("l_linenumber") % 2))
    chat = _chat_label()
    ticket = _ticket_label(1)
    review = _review_label()
    live = F.when(F.col("l_partkey") % 6 == 0, _live_answer())
    rate = F.when(F.col("l_partkey") % 5 == 0, _rating_answer())
    w = fr.join(cancels, (fr.cap == cancels.c_cap) & (fr.day == cancels.c_day), "left")
    return w.select(
        F.col("oid").alias("order_id"),
        F.col("l_shipdate").alias("order_date"),
        F.col("cap").alias("captain_id"),
        _s("o_custkey").alias("customer_id"),
        F.col("g").alias("customer_gender"),
        F.col("r_name").alias("city_name"),
        _rating().alias("customer_feedback_rating"),
        _status().alias("order_status"),
        F.col("day").alias("yyyymmdd"),
        F.lit("Link").alias("riderinfo__servicenames"),
        F.lit("bike_motorbike").alias("service_type"),
        F.concat(F.lit("SHIFT_"), _s(F.col("l_orderkey") % 5)).alias("shift_name"),
        F.col("r_name").alias("ride_city"),
        F.concat(F.lit("000-"), F.col("cap")).alias("mobile"),
        "male_ocara_count_captainlevel", "female_ocara_count_captainlevel",
        "male_cc_count_captainlevel", "female_cc_count_captainlevel",
        calls.alias("total_calls_doneby_captain"),
        F.when(chat.isNotNull(), F.lit("CHAT")).alias("chat_agent_input_type"),
        chat.alias("chat_agent_response_issue_type"),
        F.when(ticket.isNotNull(), F.lit("SUPPORT_TICKET")).alias("support_ticket_agent_input_type"),
        ticket.alias("support_ticket_agent_response_issue_type"),
        F.when(review.isNotNull(), F.lit("POST_RIDE_REVIEW")).alias("post_ride_review_agent_input_type"),
        review.alias("post_ride_review_agent_response_issue_type"),
        rate.alias("rating_screen_feedback"),
        live.alias("live_feedback_feedback"),
    )
