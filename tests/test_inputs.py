"""Spoilt input and the stage folder."""

import types

import pytest
from pyspark.sql import functions as F

from cohortkit.config import fixture_config
from cohortkit.plans.cohort import scoped_orders
from cohortkit.plans.signals import review_l2
from cohortkit.session import checkpoint_dir, use_scratch_checkpoint_dir
from cohortkit.sources.fixtures import source_views, wide_view

SF = "/root/testdata/sf0.001"


def bare_session(master):
    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master)
    return types.SimpleNamespace(sparkContext=context, conf=conf)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_no_stage_folder_is_an_error_on_a_cluster(master):
    for ask in (checkpoint_dir, use_scratch_checkpoint_dir):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ask(bare_session(master))


def test_text_dates_are_pushed_and_read_leniently(spark, tmp_path):
    cfg = fixture_config()
    wide = wide_view(spark, SF)
    text = F.date_format("order_date", "yyyy-MM-dd")
    bad = F.when(F.col("order_id").endswith("7"), F.lit("2O26-13-4x")).otherwise(text)
    wide.withColumn("order_date", bad).write.parquet(str(tmp_path / "wide"))
    read = scoped_orders(spark.read.parquet(str(tmp_path / "wide")), cfg)
    want = scoped_orders(wide.where(~F.col("order_id").endswith("7")), cfg)
    assert read.count() == want.count() > 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # the plan's text is cut otherwise
    read = scoped_orders(spark.read.parquet(str(tmp_path / "wide")), cfg)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_date," in plan


def test_review_rate_without_order_ids(spark):
    facts = spark.createDataFrame([("c1", 2, 3, 0, 4), ("c2", 1, 1, 2, 2)],
                                  "captain_id string, l2_rows_Female long, l2_rows_Male long, rides_Female long, rides_Male long")
    rates = {r.captain_id: (r.l2_rate_f, r.l2_rate_m) for r in review_l2(facts, fixture_config()).collect()}
    assert rates == {"c1": (0.0, 0.75), "c2": (0.5, 0.5)}


def test_sources_have_only_documented_columns(spark):
    views = source_views(spark, SF)
    assert set(views["t2"].columns) == {"riderinfo__userid", "riderinfo__servicenames", "updated_epoch"}
    assert set(views["t3"].columns) == {"_id", "shift_name", "mobile", "city", "created_on", "active"}
