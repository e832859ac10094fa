"""Bucketed order joins and the folded latest state."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from cohortkit.config import fixture_config
from cohortkit.operators import latest_per_key
from cohortkit.plans import base_table as bt
from cohortkit.plans import latest_state as ls
from cohortkit.queries import _folded
from cohortkit.sources.bucketed import bucket_by_order
from cohortkit.sources.fixtures import source_views

SF = "/root/testdata/sf0.001"
CFG = fixture_config(start_day="19991101")


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def key(rows):
    return sorted(str(sorted(r.asDict().items())) for r in rows)


@contextlib.contextmanager
def settings(spark, **conf):
    conf = {k.replace("_", "."): v for k, v in conf.items()}
    had = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def order_moves(plan):
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[.*customer_rated_epoch.*\]\nArguments: (\w+\([^)]*\))", plan)


def test_bucketed_order_log_moves_once(spark, tmp_path):
    src = source_views(spark, SF)
    stored = bucket_by_order(src, "bucketed_test", str(tmp_path), 8)
    want = key(bt.build_base_table(src, CFG).collect())
    with settings(spark, spark_sql_autoBroadcastJoinThreshold="-1"):
        two = order_moves(explained(bt.build_base_table(stored, CFG, by_order=True)))
        with settings(spark, spark_sql_requireAllClusterKeysForCoPartition="false"):
            df = bt.build_base_table(stored, CFG, by_order=True)
            plan = explained(df)
            got = key(df.collect())
        calls = explained(bt.calls_per_order(stored, CFG))
    one = order_moves(plan)
    assert len(one) == 1 and "captain_id" in one[0] and "yyyymmdd" in one[0], one
    assert len(two) == 2 and "Exchange" not in calls
    assert want and got == want


ROWS = [("a", 1, "x"), ("a", 3, "z"), ("a", 3, "y"), ("b", 2, None), ("b", None, "q"), ("c", None, None), (None, 9, "n")]


@pytest.mark.parametrize("parts", [[[0, 1, 2, 3, 4, 5, 6]], [[0], [1], [2], [3], [4], [5], [6]], [[2, 4], [6], [1, 5], [0], [3], [2, 1]], [[], [0, 1, 2], [3, 4, 5, 6], []]])
def test_folds_equal_the_one_shot_pick(spark, tmp_path, parts):
    what = ls.Latest("k", ["at"], ["at", "v"], buckets=4)
    schema = "k string, at int, v string"
    state = None
    for i, part in enumerate(parts):
        rows = spark.createDataFrame([ROWS[j] for j in part], schema)
        state = ls.fold(state, rows, what, f"fold_test_{len(parts)}_{i}", str(tmp_path / str(i)))
    every = spark.createDataFrame(ROWS, schema).where("k is not null")
    assert key(ls.rows_of(state, what).collect()) == key(latest_per_key(every, ["k"], ["at"], payload=["at", "v"]).collect())


def test_a_fold_moves_the_new_rows_alone(spark, tmp_path):
    what = ls.Latest("k", ["at"], ["at", "v"], buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.range(2000).select((F.col("id") % 700).cast("string").alias("k"), "id", F.col("id").alias("at"), F.lit("v").alias("v"))
    state = ls.fold(None, rows, what, "fold_plan_0", str(tmp_path / "0"))
    with settings(spark, spark_sql_autoBroadcastJoinThreshold="-1"):
        plan = explained(ls.merged(state, rows.where("id > 1900"), what))
        again = ls.fold(state, rows.where("id > 1900"), what, "fold_plan_1", str(tmp_path / "1"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(moved) == 1 and "latest" not in moved[0], moved
    assert len(again.inputFiles()) <= what.buckets
    assert key(again.collect()) == key(state.collect())


def test_states_give_the_same_mapping(spark):
    src = source_views(spark, SF)
    olf = bt.order_scope(src, CFG)
    states = {"t2": _folded(spark, bt.service_history(src), ls.SERVICE), "t3": _folded(spark, bt.active_snapshots(src), ls.SNAPSHOT)}
    want = key(bt.captain_mapping(src, olf, CFG).collect())
    assert want and key(bt.captain_mapping({**src, "t2": None, "t3": None}, olf, CFG, states).collect()) == want
