"""Edge rules of the job on small inline wide tables."""

import datetime as dt

from pyspark.sql import functions as F

from cohortkit.config import fixture_config
from cohortkit.plans.cohort import normalize
from cohortkit.plans.seeding import run_seeding

CFG = fixture_config(as_of=dt.date(2000, 1, 1))
WIDE_SCHEMA = ("captain_id string, order_id string, order_date timestamp_ntz, customer_gender int, "
               "customer_feedback_rating double, order_status string, ride_city string, "
               "total_calls_doneby_captain long, chat_agent_response_issue_type string, "
               "support_ticket_agent_response_issue_type string, post_ride_review_agent_response_issue_type string, "
               "female_ocara_count_captainlevel long, male_ocara_count_captainlevel long, "
               "female_cc_count_captainlevel long, male_cc_count_captainlevel long, "
               "live_feedback_feedback string, rating_screen_feedback string, service_type string, "
               "mobile string, shift_name string")
DAY = dt.datetime(1999, 12, 1)


def row(cap, oid, g=1, rating=4.0, day=DAY, calls=None, chat=None, ticket=None, review=None, live=None, rate=None,
        status="dropped", city="ASIA", oc=(None, None, None, None)):
    return (cap, oid, day, g, rating, status, city, calls, chat, ticket, review, *oc, live, rate,
            "bike_motorbike", "000-" + cap, "SHIFT_1")


def wide(spark, rows):
    return spark.createDataFrame(rows, WIDE_SCHEMA)


def test_cohort_rules(spark):
    rows = ([row("ok", f"o{i}") for i in range(3)]
            + [row("bad", f"b{i}", rating=4.0 if i else 2.0) for i in range(3)]
            + [row("few", f"f{i}") for i in range(2)]
            + [row("old", f"x{i}", day=dt.datetime(1999, 8, 1)) for i in range(3)]  # not active in last 3 months
            + [row("unrated", f"u{i}", rating=None) for i in range(3)])
    r = run_seeding(wide(spark, rows), CFG, materialize=False)
    assert sorted(x.captain_id for x in r.cohort.ids.collect()) == ["ok"]


def test_rating_screen_band(spark):
    # 20 rated orders: 18 yes -> 90.0 (kept), 17 yes -> 85.0 (removed), 19 yes -> 95.0 (kept)
    rows = []
    for cap, yes in (("y18", 18), ("y17", 17), ("y19", 19)):
        rows += [row(cap, f"{cap}-{i}", rate="Yes" if i < yes else "No") for i in range(20)]
    r = run_seeding(wide(spark, rows), CFG, materialize=False)
    got = {x.captain_id: (x.pct_yes, x.excluded) for x in r.rating.collect()}
    assert got == {"y18": (90.0, False), "y17": (85.0, True), "y19": (95.0, False)}


def test_live_feedback_rule(spark):
    rows = ([row("one", "a", live="No")]  # total 1: kept
            + [row("two", "b", live="No"), row("two", "c", live="Yes")]
            + [row("yes", "d", live="Yes"), row("yes", "e", live="Yes")])
    r = run_seeding(wide(spark, rows), CFG, materialize=False)
    got = {x.captain_id: x.excluded for x in r.live.collect()}
    assert got == {"one": False, "two": True, "yes": False}


def test_zero_calls_count_as_called(spark):
    rows = ([row("c", f"f{i}", g=1, calls=0) for i in range(5)] + [row("c", f"m{i}", g=0, calls=None) for i in range(5)]
            + [row("c", "r", g=1)])
    r = run_seeding(wide(spark, rows), CFG, materialize=False)
    m = r.signals.calls.metrics.collect()[0]
    assert m.call_rate_f == 5 / 6 and m.call_rate_m == 0.0


def test_one_gender_only_no_failure(spark):
    rows = [row("f", f"o{i}") for i in range(6)]
    r = run_seeding(wide(spark, rows), CFG, materialize=False)
    assert r.signals.calls.metrics.count() == 0
    assert r.signals.cancel.metrics.count() == 0
    assert [x.captain_id for x in r.seed.collect()] == ["f"]


def test_empty_inputs_give_defaults(spark):
    r = run_seeding(wide(spark, [row("x", "o", status="cancelled")]), CFG, materialize=False)
    th = r.signals.cancel.thresholds
    got = r.cohort.scoped.limit(1).select(th["p98_threshold"].alias("a"), th["p02_threshold"].alias("b")).collect()
    assert got == []  # scoped is empty: nothing to evaluate
    one = r.wide.limit(1).select(th["p98_threshold"].alias("a"), th["p02_threshold"].alias("b"),
                                 r.signals.review.thresholds["p95_l2_threshold"].alias("c")).collect()[0]
    assert (one.a, one.b, one.c) == (1.0, -1.0, 1.0)


def test_lenient_casts(spark):
    df = spark.createDataFrame([("1", "2024-01-05", "4.0"), ("1.0", "2024-01-05 10:00:00", "x"), ("x", None, None)],
                               "customer_gender string, order_date string, customer_feedback_rating string")
    got = [(r.customer_gender, r.order_date, r.customer_feedback_rating) for r in normalize(df).collect()]
    assert got[0] == (1, dt.datetime(2024, 1, 5), 4.0)
    assert got[1][0] is None and got[1][1] is None and got[1][2] is None
    assert got[2] == (None, None, None)


def test_threshold_equality_flags(spark):
    # every captain has the same positive L2 rate difference: p95 equals it, so all are flagged (>=)
    rows = []
    for c in ("a", "b", "c"):
        rows += [row(c, f"{c}f{i}", g=1, review="L2_MEDIUM" if i == 0 else None) for i in range(4)]
        rows += [row(c, f"{c}m{i}", g=0, review="L2_MEDIUM" if i == 0 else None) for i in range(8)]
    r = run_seeding(wide(spark, rows), CFG, materialize=False)
    fl = r.signals.review.flagged.where("flag_l2").collect()
    assert sorted(x.captain_id for x in fl) == ["a", "b", "c"]
    assert all(abs(x.rate_diff - 0.125) < 1e-12 for x in fl)
