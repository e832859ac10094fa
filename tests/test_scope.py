"""The per-captain pass, the counts taken while stages are stored, and how often a run scans the wide table."""

import datetime as dt
import os
import random
import subprocess
import sys
import textwrap

from cohortkit.config import fixture_config
from cohortkit.plans import seeding
from cohortkit.plans.feedback import fb_live, fb_rating
from cohortkit.plans.scope import captain_scope, eligible
from cohortkit.queries import _run
from cohortkit.session import materialize_counted

SF = "/root/testdata/sf0.001"
CFG = fixture_config()
ROW = ("captain_id string, order_id string, order_date timestamp, customer_gender int, customer_feedback_rating double, "
       "live_feedback_feedback string, rating_screen_feedback string, service_type string, mobile string, shift_name string")


def random_rows(n=400, seed=3):
    rnd = random.Random(seed)
    day = lambda: dt.datetime(1999, 7, 1) + dt.timedelta(days=rnd.randrange(260))
    return [(rnd.choice(["a", "b", "c", "d", None]), rnd.choice([None, *[f"o{k}" for k in range(60)]]), day(), rnd.choice([0, 1]),
             rnd.choice([None, 1.0, 4.0, 5.0]), rnd.choice([None, None, "Yes", "No", "?"]),
             rnd.choice([None, None, "No", *CFG.yes_labels]), rnd.choice([None, "x"]), rnd.choice(["1", "2"]), rnd.choice("ST"))
            for _ in range(n)]


def test_captain_scope_brute_force(spark):
    rows = random_rows()
    got = {r.captain_id: r.asDict() for r in captain_scope(spark.createDataFrame(rows, ROW), CFG).collect()}
    for cap in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == cap]
        base = [r for r in mine if r[2].date() < CFG.as_of or r[2] == dt.datetime.combine(CFG.as_of, dt.time())]
        fem = [r for r in base if r[3] == CFG.female_code]
        x = got[cap]
        assert (x["scoped_rows"], x["base_rows"]) == (len(mine), len(base))
        assert x["active"] == any(r[2].date() >= CFG.active_start for r in base)
        assert x["female_total_rides"] == len(fem)
        assert x["female_rated_rides"] == sum(r[4] in CFG.rated_values for r in fem)
        assert x["bad_female_ratings"] == sum(r[4] in CFG.bad_values for r in fem)
        for at, rule, yes in ((5, "live", ("Yes",)), (6, "rating", CFG.yes_labels)):
            given = [r for r in mine if r[3] == CFG.female_code and r[at] is not None]
            assert x[f"{rule}_total"] == len({r[1] for r in given})  # a null order id counts as one order
            assert x[f"{rule}_yes"] == len({r[1] for r in given if r[at] in yes})
            assert x[f"{rule}_no"] == len({r[1] for r in given if r[at] == CFG.no_label})
        low = lambda v: (v is not None, v or "")
        last = max(mine, key=lambda r: (r[2], low(r[1]), low(r[7]), low(r[8]), low(r[9])))
        assert (x["service_type"], x["mobile"], x["shift_name"]) == last[7:10]


def test_rules_without_answers(spark):
    df = spark.createDataFrame([("a", "o", dt.datetime(1999, 12, 1), CFG.female_code, 5.0, None, None, None, None, None)], ROW)
    scope = captain_scope(df, CFG)
    assert fb_live(scope, CFG).count() == fb_rating(scope, CFG).count() == 0
    assert captain_scope(df.limit(0), CFG).count() == 0
    assert scope.where(eligible(CFG)).count() == 0  # one ride is too few


def leaves(df):
    """Folders that the plan of a frame reads, one entry a scan."""
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scans = [plan.apply(i) for i in range(plan.size())]
    return [s.relation().location().rootPaths().mkString(",") for s in scans if s.getClass().getSimpleName() == "LogicalRelation"]


def test_a_run_scans_the_wide_table_twice(spark, monkeypatch):
    run = _run(spark, SF)
    stored = []
    import cohortkit.session as session

    plain = session.materialize

    def recording(df, label="stage"):
        stored.append((label, leaves(df)))
        return plain(df, label)

    monkeypatch.setattr(session, "materialize", recording)  # the counted stages store through it
    outputs = [run.seed, run.nminus1, run.final, run.audit, run.risky, run.overlap()]
    metrics = run.metrics()
    wide = [label for label, paths in stored for p in paths if "/wide-" in p]
    assert wide == ["captain-scope", "cohort-orders"]
    assert not any("/wide-" in p for df in outputs for p in leaves(df))
    assert leaves(metrics) == []  # the numbers were taken while the stages were stored
    assert metrics.count() == 46


def test_counts_equal_the_outputs(spark):
    run = _run(spark, SF)
    m = {(r.stage, r.metric): r.value for r in run.metrics().collect()}
    audit = run.audit.collect()
    assert m["audit", "rows"] == len(audit) and m["audit", "unique_captains"] == len({a.captain_id for a in audit})
    assert m["cohort", "cohort_orders"] == run.cohort.orders.count()
    assert m["seed", "safe_seed_captains"] == run.seed.count() and m["final", "after_shift_filter"] == run.final.count()
    lazy = seeding.run_seeding(run.wide, run.cfg, materialize=False)
    assert lazy.cohort and lazy._count("captain-scope") == run._count("captain-scope")


def test_counts_sit_in_the_stage_that_writes(spark):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    run = _run(spark, SF)
    df = run.cohort.scope.observe(Observation(), F.count(F.lit(1)).alias("n"))
    assert df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "CollectMetrics"  # above every shuffle


def test_retried_tasks_are_counted_once(tmp_path):
    """Every task of the writing stage and of the one before fails once; the counts are those of one pass."""
    code = f"""
        import sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession, functions as F
        from cohortkit.session import materialize_counted
        spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "3").config("spark.sql.adaptive.enabled", "false").getOrCreate())
        spark.sparkContext.setCheckpointDir({str(tmp_path)!r})
        def flaky(batches):
            for b in batches:
                yield b
            if TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("lost")
        df = spark.range(0, 1000, 1, 4).mapInPandas(flaky, "id long").groupBy((F.col("id") % 50).alias("k")).count()
        df = df.mapInPandas(flaky, "k long, count long")
        out, got = materialize_counted(df, "x", {{"rows": F.count(F.lit(1)), "total": F.sum("count")}})
        print("COUNTED", got["rows"], got["total"], out.count())
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert "COUNTED 50 1000 50" in out.stdout, out.stderr[-2000:]


def test_counts_of_an_empty_stage(spark):
    from pyspark.sql import functions as F

    _, got = materialize_counted(spark.range(0), "none", {"n": F.count(F.lit(1)), "s": F.coalesce(F.sum("id"), F.lit(0))})
    assert got == {"n": 0, "s": 0}
