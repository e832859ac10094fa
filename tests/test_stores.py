"""Stores that run at once, sides worked out once, bucket counts, and the rides' stored columns."""

import threading

import pytest
from pyspark.sql import functions as F

from cohortkit import queries
from cohortkit.config import fixture_config
from cohortkit.plans import base_table as bt
from cohortkit.session import at_once
from cohortkit.sources import fixtures
from cohortkit.sources.bucketed import bucket_count

SF = "/root/testdata/sf0.001"
CFG = fixture_config(start_day="19991101")


def key(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def test_jobs_run_at_once():
    both = threading.Barrier(2, timeout=20)
    assert at_once({"a": lambda: both.wait() >= 0, "b": lambda: both.wait() >= 0}) == {"a": True, "b": True}
    with pytest.raises(ZeroDivisionError):
        at_once({"a": lambda: 1, "b": lambda: 1 // 0})


def test_buckets_grow_with_the_rows(spark):
    assert bucket_count(spark.range(0)) == bucket_count(spark.range(64), rows=4) == 16
    assert bucket_count(spark.range(101), rows=4) == 26


def test_every_source_is_stored_at_once(spark, monkeypatch):
    class Seen(Exception):
        pass

    def seen(jobs):
        raise Seen(*jobs)

    monkeypatch.setattr(queries, "at_once", seen)
    for store in (queries._by_day, queries._stored_sources):
        with pytest.raises(Seen) as e:
            store(spark, SF)
        assert sorted(e.value.args) == sorted(f"t{i}" for i in range(1, 12)) and set(e.value.args[:3]) == {"t1", "t7", "t8"}


def test_builds_from_stored_sides_read_no_side_source(spark):
    src = fixtures.source_views(spark, SF)
    sides = bt.stored_sides(src, CFG)
    bare = {"t1": src["t1"], "t4": src["t4"]}
    for days in (None, ("19991101", "19991130")):
        want = key(bt.build_base_table(src, CFG, days))
        assert want and key(bt.build_base_table(bare, CFG, days, sides=sides)) == want


def test_day_text_is_that_of_date_format(spark):
    days = spark.sql("SELECT make_timestamp(y, m, 1, 23, 59, 59) AS ts FROM VALUES (1, 1), (987, 12), (1995, 2), (9999, 12), (10000, 1), (-3, 5), (null, 1) AS v(y, m)")
    rows = days.select(fixtures._day(F.col("ts")).alias("a"), F.date_format(F.col("ts").cast("date"), "yyyyMMdd").alias("b")).collect()
    assert len(rows) == 7 and all(r.a == r.b for r in rows) and "19950201" in {r.a for r in rows}


def test_stored_rides_hold_no_text_ids(spark):
    rides = fixtures.stored_rides(fixtures.read_tables(spark, SF), True)
    stored = set(spark.read.parquet(*rides.inputFiles()).columns)
    assert not stored & {"oid", "cap", "l_quantity", "l_extendedprice"} and {"oid", "cap"} <= set(rides.columns)
    assert not rides.where(~F.col("oid").eqNullSafe(F.concat_ws("-", "l_orderkey", "l_linenumber")) | ~F.col("cap").eqNullSafe(F.col("l_suppkey").cast("string"))).count()
