import math
import random

from pyspark.sql import functions as F

from cohortkit.functions import first_match, safe_ratio
from cohortkit.operators import (cap_at, exclude, fixed4, flag_matrix, joined_flags, kv, latest_per_key,
                                 latest_per_key_by_case, max_then_sum, pivot_segments, quantile_nearest,
                                 top_k_per_group)


def test_latest_per_key_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", 2, 1, "x"), ("a", 2, 3, "y"), ("a", None, 9, "z"), ("b", None, 1, "n"), ("b", None, 2, "m")],
        "k string, d int, tie int, v string")
    got = {r.k: (r.d, r.v) for r in latest_per_key(df, ["k"], ["d"], ["tie"], ["d", "v"]).collect()}
    # desc with nulls last; equal dates broken by the tie column desc
    assert got == {"a": (2, "y"), "b": (None, "m")}


def test_latest_by_case_one_pass(spark):
    df = spark.createDataFrame([("o1", "CHAT", 1, "l1"), ("o1", "CHAT", 2, "l2"), ("o1", "TICKET", 1, "t1")],
                               "o string, typ string, day int, lab string")
    r = latest_per_key_by_case(df, ["o"], {"chat": F.col("typ") == "CHAT", "rev": F.col("typ") == "REV"},
                               order=["day"], payload=["lab"]).collect()[0]
    assert r.chat.lab == "l2" and r.rev is None


def test_pivot_missing_segment_is_null(spark):
    long = spark.createDataFrame([("c1", "Female", 3), ("c1", "Male", 4), ("c2", "Female", 5)],
                                 "k string, g string, n long")
    got = {r.k: (r.n_f, r.n_m) for r in pivot_segments(long, "k", "g", {"Female": "f", "Male": "m"}, ["n"]).collect()}
    assert got == {"c1": (3, 4), "c2": (5, None)}


def nearest(vals, q):
    s = sorted(vals)
    return s[int(math.floor((len(s) - 1) * q + 0.5))]


def test_quantile_matches_nearest_rank(spark):
    rnd = random.Random(7)
    for n in (1, 2, 3, 10, 101, 600):
        vals = [float(rnd.choice([rnd.randint(-3, 3), rnd.random(), rnd.gauss(0, 1e5)])) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
        for q in (0.0, 0.02, 0.5, 0.95, 0.98, 0.99, 1.0):
            got = quantile_nearest(df, "x", q, buckets=8).collect()
            assert [r.value for r in got] == [nearest(vals, q)], (n, q)


def test_quantile_empty_is_no_row(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantile_nearest(df, "x", 0.5).collect() == []
    assert df.select(quantile_nearest(df, "x", 0.5).scalar().alias("q")).collect()[0].q is None


def test_quantile_hot_value(spark):
    # one value holds a third of the rows: it is one row after the value count
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") * 1.0).alias("x"))
    vals = [5.0 if i % 3 == 0 else float(i) for i in range(3000)]
    for q in (0.02, 0.3, 0.98):
        assert quantile_nearest(df, "x", q).collect()[0].value == nearest(vals, q)


def test_first_match_order(spark):
    classes = (("prefbyher", ("bike rated by women",)), ("bike_scooter", ("scooty",)),
               ("bike_motorbike", ("bike", "link")))
    df = spark.createDataFrame([("Bike Rated by Women,Link",), ("Scooty Bike",), ("LINK",), ("Auto",), (None,)],
                               "s string")
    got = [r.c for r in df.select(first_match(F.col("s"), classes, "others").alias("c")).collect()]
    assert got == ["prefbyher", "bike_scooter", "bike_motorbike", "others", "others"]


def test_kv_and_fixed4(spark):
    df = spark.createDataFrame([(1, 0.00012345, None)], "a int, b double, c double")
    r = df.select(kv(("a", F.col("a")), ("b", fixed4(F.col("b"))), ("c", fixed4(F.col("c")))).alias("e")).collect()[0]
    assert r.e == "a=1, b=0.0001, c=NA"


def test_joined_flags_and_cap(spark):
    df = spark.createDataFrame([(True, False, True, None)], "f1 boolean, f2 boolean, f3 boolean, x double")
    r = df.select(joined_flags([(F.col("f1"), "rate"), (F.col("f2"), "vol"), (F.col("f3"), "cv")]).alias("l"),
                  cap_at(F.col("x"), F.lit(3.0)).alias("c"), safe_ratio(F.lit(1), F.lit(0)).alias("s")).collect()[0]
    assert (r.l, r.c, r.s) == ("rate+cv", 0.0, 0.0)


def test_flag_matrix_and_exclude(spark):
    a = spark.createDataFrame([("c1",), ("c2",)], "captain_id string")
    b = spark.createDataFrame([("c2",), ("c3",)], "captain_id string")
    m = {r.captain_id: (r.flag_a, r.flag_b, r.total_signals)
         for r in flag_matrix({"a": a, "b": b}, "captain_id").collect()}
    assert m == {"c1": (True, False, 1), "c2": (True, True, 2), "c3": (False, True, 1)}
    assert [r.captain_id for r in exclude(a, b, "captain_id").collect()] == ["c1"]


def test_max_then_sum(spark):
    df = spark.createDataFrame([("c", "d1", 2), ("c", "d1", 2), ("c", "d2", None), ("c", "d3", 1)],
                               "k string, day string, n long")
    r = max_then_sum(df, "k", "day", {"s": "n"}).collect()[0]
    assert r.s == 3


def test_top_k(spark):
    df = spark.createDataFrame([("s1", i) for i in range(10)] + [("s2", 1)], "g string, v int")
    got = top_k_per_group(df, ["g"], [F.col("v")], 3).collect()
    assert sorted((r.g, r.v) for r in got) == [("s1", 0), ("s1", 1), ("s1", 2), ("s2", 1)]


def test_latest_per_key_random_vs_python(spark):
    """Random keys, orders with nulls and ties: the pick equals a plain-Python sort."""
    rnd = random.Random(3)
    rows = [(rnd.choice("abcde"), rnd.choice([None, 1, 2, 3]), rnd.randint(0, 3), rnd.choice("xyz"))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, d int, t int, v string")
    got = {r.k: (r.d, r.t, r.v) for r in latest_per_key(df, ["k"], ["d"], ["t"], ["d", "t", "v"]).collect()}

    def rank(r):  # DESC NULLS LAST on each of (d, t, v)
        return tuple((x is not None, x if x is not None else 0) for x in r[1:])

    want = {}
    for r in rows:
        if r[0] not in want or rank(r) > rank(want[r[0]]):
            want[r[0]] = r
    assert got == {k: v[1:] for k, v in want.items()}


def test_k_of_n_vote_random(spark):
    from cohortkit.operators import k_of_n
    rnd = random.Random(5)
    rows = [tuple(rnd.choice([True, False, None]) for _ in range(3)) for _ in range(100)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    got = [r.v for r in df.select(k_of_n([F.col("a"), F.col("b"), F.col("c")], 2).alias("v")).collect()]
    assert got == [sum(1 for x in r if x) >= 2 for r in rows]
