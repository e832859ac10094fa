"""Bloom reductions: same rows, the filter in the plan, fewer bytes shuffled."""

import contextlib
import io

import pytest

from cohortkit.config import fixture_config
from cohortkit.plans import base_table as bt
from cohortkit.plans.bloom import Bloom, reduced, stored_ids
from cohortkit.queries import _stored_sources

SF = "/root/testdata/sf0.001"
CFG = fixture_config(start_day="19991101")
ANY = Bloom(min_scan="0", broadcast="-1")


@pytest.fixture(scope="module")
def src(spark):
    return _stored_sources(spark, SF)


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def key(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def test_histories_and_answers_are_filtered(spark, src):
    base = bt.captain_base(bt.order_scope(src, CFG))
    held = stored_ids(base, "captain-ids")
    assert key(held) == key(base)
    for plan in (lambda b: bt.latest_service(src, b), lambda b: bt.rider_snapshot(src, b, CFG), lambda b: bt.feedback_merge(src, CFG)):
        want = key(plan(base))
        with reduced(spark, ANY):
            assert "might_contain" in explained(plan(held))
            assert key(plan(held)) == want
        assert "might_contain" not in explained(plan(held))  # the session's settings are back
    assert want


def test_base_table_is_the_same(spark, src):
    want = key(bt.build_base_table(src, CFG))
    assert want and key(bt.build_base_table(src, CFG, bloom=ANY)) == want
    none = {**src, "t1": src["t1"].limit(0), "t9": src["t9"].limit(0)}
    assert bt.build_base_table(none, CFG, bloom=ANY).count() == 0


def test_settings_return_after_an_error(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(name)
    with pytest.raises(ValueError), reduced(spark, ANY):
        assert spark.conf.get(name) == "-1"
        raise ValueError
    assert spark.conf.get(name) == had
