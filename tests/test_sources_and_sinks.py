"""Sources by path and by day, the command line, the refresh of days, and the published outputs."""

import contextlib
import datetime as dt
import io
import json
import re

import pytest
from pyspark.sql import functions as F

import cohortkit.__main__ as command
from cohortkit.config import fixture_config, production_config
from cohortkit.plans import base_table as bt
from cohortkit.plans import build_base_table
from cohortkit.queries import _run
from cohortkit.sources import read_manifest, read_output, read_parquet, read_sources, sinks
from cohortkit.sources.fixtures import source_views, wide_view

SF = "/root/testdata/sf0.001"
CFG = fixture_config()


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def key(rows):
    return sorted(str(sorted(r.asDict().items(), key=lambda x: x[0])) for r in rows)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The sources as parquet; those with a day partitioned by it (days of the run and some before)."""
    root = tmp_path_factory.mktemp("sources")
    paths = {}
    for name, df in source_views(spark, SF).items():
        paths[name] = str(root / name)
        if "yyyymmdd" in df.columns:
            df.where(F.col("yyyymmdd") >= "19991101").repartition(1).write.partitionBy("yyyymmdd").parquet(paths[name])
        else:
            df.write.parquet(paths[name])
    return paths


def test_day_partitions_are_pruned(spark, stored):
    src = read_sources(spark, stored)
    assert dict(src["t1"].dtypes)["yyyymmdd"] == "string"
    cfg = CFG.with_(start_day="19991201", end_day="19991215")
    for name, df in {"t1": bt.order_scope(src, cfg), "t5": bt.cancel_counts(src, cfg), "t6": bt.calls_per_order(src, cfg)}.items():
        plan = explained(df)
        found = re.search(r"PartitionFilters: \[(.*)\]", plan).group(1)
        assert ">= 19991201" in found and "<= 19991215" in found and "cast" not in found, (name, found)
    plan = explained(bt.order_scope(src, cfg))
    read = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert "yyyymmdd" not in read and "PushedFilters: [" in plan
    days = {r.yyyymmdd for r in bt.order_scope(src, cfg).select("yyyymmdd").distinct().collect()}
    assert days and min(days) >= "19991201" and max(days) <= "19991215"


def test_sources_by_path_give_the_same_base_table(spark, stored):
    cfg = CFG.with_(start_day="19991101")
    want = build_base_table(source_views(spark, SF), cfg).collect()
    assert want and key(build_base_table(read_sources(spark, stored), cfg).collect()) == key(want)


def test_sources_by_table_name_and_missing_ones(spark, stored):
    spark.read.parquet(stored["t9"]).createOrReplaceTempView("service_map_for_test")
    src = read_sources(spark, {**stored, "t9": "service_map_for_test"})
    assert src["t9"].count() == spark.read.parquet(stored["t9"]).count()
    with pytest.raises(KeyError, match="t9"):
        read_sources(spark, {k: v for k, v in stored.items() if k != "t9"})


def test_command_line(spark, stored, tmp_path, monkeypatch, capsys):
    asked = []
    monkeypatch.setattr(command, "production_config", lambda as_of: asked.append(as_of) or CFG.with_(start_day="19991101"))
    out, base = str(tmp_path / "out"), str(tmp_path / "wide")
    command.main(["--sources", *[f"{k}={v}" for k, v in stored.items()], "--base-out", base, "--out", out, "--as-of", "2000-01-01"])
    assert asked == [dt.date(2000, 1, 1)] and spark.read.parquet(base).columns == list(bt.WIDE_COLUMNS)
    printed = dict(x.split(": ", 1) for x in capsys.readouterr().out.splitlines() if ": " in x)
    assert {k: printed[k] for k in sinks.OUTPUT_NAMES} == read_manifest(spark, out, "01jan2000")["outputs"]
    first = {(r.stage, r.metric): r.value for r in spark.read.parquet(f"{out}/metrics_01jan2000").collect()}
    assert first["cohort", "source_rows"] > 0 and len(first) == 46
    # the wide table written before gives the same run
    command.main(["--wide", base, "--out", str(tmp_path / "again")])
    assert asked[1] is None
    again = {(r.stage, r.metric): r.value for r in spark.read.parquet(str(tmp_path / "again" / "metrics_01jan2000")).collect()}
    assert again == first
    with pytest.raises(SystemExit):
        command.main(["--out", out])


def test_default_date_is_today():
    before = dt.date.today()
    assert before <= production_config().as_of <= dt.date.today()


def test_refresh_of_days_is_idempotent(spark, tmp_path):
    src, path = source_views(spark, SF), str(tmp_path / "wide")
    cfg = CFG.with_(start_day="19991101")
    want = key(build_base_table(src, cfg).collect())
    bt.refresh_days(src, cfg, path, "19991101", "19991130")
    files = {f for f in spark.read.parquet(path).inputFiles()}
    for _ in range(2):
        bt.refresh_days(src, cfg, path, "19991201", cfg.day_to)
        got = read_parquet(spark, path)
        assert key(got.select(*bt.WIDE_COLUMNS).collect()) == want
        assert files <= set(got.inputFiles())  # other days' files were left alone


def test_a_run_that_stops_between_two_sinks_publishes_nothing(spark, tmp_path, monkeypatch):
    run, out = _run(spark, SF), str(tmp_path / "out")
    first = sinks.write_outputs(run, out)
    before = read_manifest(spark, out, "01jan2000")
    assert before["outputs"] == first and before["tag"] == "01jan2000"
    plain, done = sinks.write_csv, []

    def stops(df, path):
        if len(done) == 2:
            raise OSError("lost the store")
        done.append(plain(df, path))
        return done[-1]

    monkeypatch.setattr(sinks, "write_csv", stops)
    with pytest.raises(OSError):
        sinks.write_outputs(run, out)
    assert len(done) == 2 and read_manifest(spark, out, "01jan2000") == before
    assert read_output(spark, out, "01jan2000", "final").count() == run.final.count()
    monkeypatch.setattr(sinks, "write_csv", plain)
    again = sinks.write_outputs(run, out)
    assert read_manifest(spark, out, "01jan2000")["outputs"] == again and set(again.values()).isdisjoint(first.values())
    assert json.loads(before["schemas"]["final"])["fields"][0]["name"] == "captain_id"


def test_numbered_outputs_follow_the_sort(spark, tmp_path):
    run = _run(spark, SF)
    sinks.write_outputs(run, str(tmp_path))
    rows = read_output(spark, str(tmp_path), "01jan2000", "risk", numbered=True).orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(1, len(rows) + 1))
    assert rows == sorted(rows, key=lambda r: (-r.total_signals, r.captain_id))


def test_lenient_casts_of_text_columns(spark):
    from cohortkit.plans.cohort import normalize

    rows = [("1", "4.5", "3", "2000-01-01"), ("x", "good", "?", "1999-13-01"), (None, None, None, None), (" 0", "5", "-", "")]
    df = spark.createDataFrame(rows, "customer_gender string, customer_feedback_rating string, total_calls_doneby_captain string, "
                                     "order_date string")
    df = df.withColumns({"captain_id": F.lit(7), "order_id": F.lit(8)})
    got = [(r.customer_gender, r.customer_feedback_rating, r.total_calls_doneby_captain, r.order_date) for r in normalize(df).collect()]
    assert got[0] == (1, 4.5, 3.0, dt.datetime(2000, 1, 1)) and got[1] == got[2] == (None,) * 4
    assert got[3][:3] == (0, 5.0, None) and got[3][3] is None
    assert wide_view(spark, SF).columns
