"""Registered queries: each a Spark plan over the test tables plus its DuckDB oracle.

``spark_queries()[name](spark, sf_dir)`` returns a DataFrame (building it may store stage tables);
``oracle_queries()[name]`` the equivalent SQL over the pre-registered test
tables.  Doubles computed by aggregates are rounded to 6 places on both sides
before comparison.  Every query reads whole tables; none caps rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import RunConfig, fixture_config
from .oracle.pipeline_sql import r6, service_case, sql
from .plans import base_table as bt
from .plans import latest_state as ls
from .plans.bloom import Bloom
from .plans.seeding import audit_top, run_seeding
from .session import at_once, checkpoint_dir, materialize, use_scratch_checkpoint_dir
from .sources.bucketed import bucket_by_order, bucket_count
from .sources.fixtures import source_views, wide_view
from .sources.catalog import read_parquet, read_sources
from .sources.sinks import read_manifest, read_output, write_outputs

CFG: RunConfig = fixture_config()
NO_SUCH_STATUS = replace(CFG, dropped_status="lost")  # a scope that no row of the table meets


def _r6(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def _run(spark: SparkSession, sf: str, cfg: RunConfig = CFG, source: str = "w1"):
    """One scoring run over a stored wide table.

    The original job hands the wide table over as a parquet file (SQL output ->
    script input); the same here: the fixture view (or the built base table)
    is written once to the checkpoint folder and the run reads it with pushed
    filters, instead of every branch re-deriving it from the TPC-H joins.
    """
    if source == "w1":
        wide = wide_view(spark, sf)
    elif source == "w1_dated":  # text dates, some malformed: their rows are dropped
        wide = wide_view(spark, sf).withColumn("order_date", F.when(F.col("order_id").endswith("7"), F.lit("2O26-13-4x"))
                                               .otherwise(F.date_format("order_date", "yyyy-MM-dd")))
    elif source == "w1_blank":  # female orders have lost their ids
        female = F.col("customer_gender") == cfg.female_code
        wide = wide_view(spark, sf).withColumn("order_id", F.when(~female, F.col("order_id")))
    else:
        wide = bt.build_base_table(source_views(spark, sf), cfg)
    return run_seeding(materialize(wide, f"wide-{source}"), cfg)


CALLS_DOUBLES = ("call_rate_f", "call_rate_m", "avg_calls_f", "avg_calls_m", "std_calls_f", "std_calls_m",
                 "call_rate_diff", "calls_diff", "cv_f", "cv_m", "cv_diff")
CANCEL_DOUBLES = ("rate_f", "rate_m", "diff")
L2_DOUBLES = ("l2_rate_f", "l2_rate_m", "rate_diff")


def _thresholds(spark: SparkSession, sf: str) -> DataFrame:
    r = _run(spark, sf)
    s = r.signals
    vals = {"p99_calls": s.calls_cap, **s.review.thresholds, **s.calls.thresholds,
            **s.cancel.thresholds}
    arr = F.array(*[F.struct(F.lit(k).alias("name"), F.round(v.cast("double"), 6).alias("value"))
                    for k, v in vals.items()])
    return r.cohort.ids.agg(F.count(F.lit(1)).alias("_n")).select(F.inline(arr))


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/cohortkit/{label}-{uuid.uuid4().hex}"


def _sink(spark: SparkSession, sf: str, name: str, numbered: bool = False) -> DataFrame:
    """An output of the run as its CSV sink published it, read back through the manifest with the output's types."""
    run, out = _run(spark, sf), _fresh(spark, "sinks")
    write_outputs(run, out)
    rows = read_output(spark, out, run.cfg.run_tag, name, numbered)
    return rows.withColumn("run_tag", F.lit(read_manifest(spark, out, run.cfg.run_tag)["tag"])) if numbered else rows


def _refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table built day range by day range, the first one twice."""
    src, path = source_views(spark, sf), _fresh(spark, "wide-by-day")
    half = (CFG.day_from, "19991001"), ("19991002", CFG.day_to)
    sides = bt.stored_sides(src, CFG)
    for first, last in (*half, half[0]):
        bt.refresh_days(src, CFG, path, first, last, sides)
    return read_parquet(spark, path).select(*bt.WIDE_COLUMNS)


def _by_day(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table from sources read by path, the order log stored partitioned by day."""
    def store(name: str, df: DataFrame) -> str:
        path = _fresh(spark, f"source-{name}")
        if name == "t1":
            df.repartition("yyyymmdd").write.partitionBy("yyyymmdd").parquet(path)
        else:
            df.write.parquet(path)
        return path

    paths = at_once({name: partial(store, name, df) for name, df in _longest_first(source_views(spark, sf))})
    return bt.build_base_table(read_sources(spark, paths), CFG)


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table from an order log and calls bucketed by order id, and from folded states of the captains' rows."""
    src = source_views(spark, sf)
    done = at_once({
        "orders": lambda: bucket_by_order(src, _table_name("orders"), _fresh(spark, "bucketed"), bucket_count(src["t1"])),
        "t2": lambda: _folded(spark, bt.service_history(src), ls.SERVICE),
        "t3": lambda: _folded(spark, bt.active_snapshots(src), ls.SNAPSHOT)})
    return bt.build_base_table(done["orders"], CFG, by_order=True, states={n: done[n] for n in ("t2", "t3")})


def _longest_first(src: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    return sorted(src.items(), key=lambda s: s[0] not in ("t1", "t7", "t8"))


def _stored_sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return at_once({name: partial(materialize, df, f"source-{name}") for name, df in _longest_first(source_views(spark, sf))})


def _bloomed(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table with Bloom reductions at any size and no broadcast."""
    return bt.build_base_table(_stored_sources(spark, sf), CFG, bloom=Bloom(min_scan="0", broadcast="-1"))


def _table_name(label: str) -> str:
    return f"cohortkit_{label}_{uuid.uuid4().hex}"


def _folded(spark: SparkSession, rows: DataFrame, what: ls.Latest, days: int = 3) -> DataFrame:
    """A state of all rows: those before the last ``days`` days in one fold, then day by day, the newest day
    first and the oldest of them twice (late and repeated days)."""
    rows, what = materialize(rows, "history"), replace(what, buckets=16)
    day = F.to_date(what.order[0])
    last = [r.day for r in rows.select(day.alias("day")).where("day is not null").distinct().orderBy(F.desc("day")).limit(days).collect()]
    early = rows.where(F.coalesce(~day.isin(last), F.lit(True))) if last else rows
    state = None
    for part in [early, *[rows.where(day == d) for d in [*last, *last[-1:]]]]:
        state = ls.fold(state, part, what, _table_name("state"), _fresh(spark, "state"))
    return state


def _latest_service_daily(spark: SparkSession, sf: str) -> DataFrame:
    src = source_views(spark, sf)
    state = _folded(spark, bt.service_history(src), ls.SERVICE)
    return bt.latest_service(src, bt.captain_base(bt.order_scope(src, CFG)), state)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    src = source_views
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # cohort (I6)
        "eligible_cohort": lambda s, d: _run(s, d).cohort.ids,
        "female_stats": lambda s, d: _run(s, d).cohort.stats,
        "cohort_orders": lambda s, d: _run(s, d).cohort.orders.select(
            "captain_id", "order_id", "order_date", "customer_gender", "gender"),
        # base table build
        "latest_service": lambda s, d: (lambda t: bt.latest_service(t, bt.captain_base(bt.order_scope(t, CFG))))(src(s, d)),
        "service_class": lambda s, d: bt.service_class(src(s, d, store=False)),
        "captain_mapping": lambda s, d: (lambda t: bt.captain_mapping(t, bt.order_scope(t, CFG), CFG))(src(s, d)),
        "cancel_counts": lambda s, d: bt.cancel_counts(src(s, d), CFG),
        "calls_per_order": lambda s, d: bt.calls_per_order(src(s, d), CFG),
        "text_labels": lambda s, d: bt.text_labels(src(s, d), CFG),
        "feedback_merge": lambda s, d: bt.feedback_merge(src(s, d), CFG),
        "base_table": lambda s, d: bt.build_base_table(src(s, d), CFG),
        # signals (I7-I11)
        "sig_chat": lambda s, d: _run(s, d).signals.chat.flagged,
        "sig_ticket": lambda s, d: _run(s, d).signals.ticket.flagged,
        "quantiles": _thresholds,
        "review_l2": lambda s, d: _r6(_run(s, d).signals.review.metrics, L2_DOUBLES),
        "sig_review": lambda s, d: _r6(_run(s, d).signals.review.flagged, ["rate_diff"]),
        "calls_metrics": lambda s, d: _r6(_run(s, d).signals.calls.metrics, CALLS_DOUBLES),
        "sig_calls": lambda s, d: _r6(_run(s, d).signals.calls.flagged, CALLS_DOUBLES),
        "cancel_metrics": lambda s, d: _r6(_run(s, d).signals.cancel.metrics, CANCEL_DOUBLES),
        "sig_cancel": lambda s, d: _r6(_run(s, d).signals.cancel.flagged, CANCEL_DOUBLES),
        # composition
        "risk_master": lambda s, d: _run(s, d).risky,
        "safe_seed": lambda s, d: _run(s, d).seed,
        "fb_live": lambda s, d: _run(s, d).live,
        "fb_rating": lambda s, d: _run(s, d).rating,
        "fb_overlap": lambda s, d: _run(s, d).overlap(),
        "nminus1": lambda s, d: _run(s, d).nminus1,
        "final_list": lambda s, d: _run(s, d).final,
        "audit_log": lambda s, d: _run(s, d).audit,
        "audit_top5": lambda s, d: audit_top(_run(s, d).audit, CFG.top_k_audit),
        "funnel_metrics": lambda s, d: _r6(_run(s, d).metrics(), ["value"]),
        # spoilt input, a scope without rows, shift filter on
        "normalize_text": lambda s, d: _run(s, d, source="w1_dated").cohort.stats,
        "review_null_orders": lambda s, d: _r6(_run(s, d, source="w1_blank").signals.review.metrics, L2_DOUBLES),
        "cohort_empty": lambda s, d: _run(s, d, NO_SUCH_STATUS).cohort.ids,
        "final_list_shift": lambda s, d: _run(s, d, replace(CFG, apply_shift_filter=True)).final,
        # the CSV sinks, written and read back
        "sink_final_list": lambda s, d: _sink(s, d, "final"),
        "sink_risk_master": lambda s, d: _sink(s, d, "risk"),
        "published_final_order": lambda s, d: _sink(s, d, "final", numbered=True),
        "published_risk_order": lambda s, d: _sink(s, d, "risk", numbered=True),
        # the wide table by parts of its days, and from sources partitioned by day
        "base_table_refreshed": _refreshed,
        "base_table_by_day": _by_day,
        # from bucketed sources and folded states
        "base_table_bucketed": _bucketed,
        "base_table_bloom": _bloomed,
        "latest_service_daily": _latest_service_daily,
        # sorted distinct signals of the audit log
        "audit_signals": lambda s, d: _run(s, d).audit.select("signal").distinct().select(
            "signal", F.row_number().over(Window.orderBy("signal")).alias("place")),  # ten signals at most
        # the scoring run fed by the base-table build instead of the direct view
        "base_cohort_stats": lambda s, d: _run(s, d, source="base").cohort.stats,
        "base_final_list": lambda s, d: _run(s, d, source="base").final,
        "base_audit_log": lambda s, d: _run(s, d, source="base").audit,
    }
    return {name: _with_stage_folder(f) for name, f in q.items()}


def _with_stage_folder(f):
    return lambda spark, sf_dir: f(use_scratch_checkpoint_dir(spark), sf_dir)


def _cols(prefix: str, cols) -> str:
    return ", ".join(r6(c) + f" AS {c}" for c in cols)


FUNNEL_NEEDS = ["sc", "base", "cohort", "bc", "sig_chat", "tickets", "sig_ticket", "sig_review", "p95",
                "calls_metrics", "sig_calls", "cthr", "cancel_metrics", "sig_cancel", "othr", "risk_master", "seed",
                "fb_live", "fb_rating", "feedback_ids", "fb_overlap", "nminus1", "final_list", "audit"]
OVERLAP_COLUMNS = ("df_new_feedback_total", "already_in_5signal_risky", "incremental_new_removals",
                   "incremental_in_cohort", "seed_before", "nminus1_after")


def funnel_sql(cfg: RunConfig) -> str:
    n = lambda t, w="": f"(SELECT count(*) FROM {t} {w})"
    rows = [
        ("cohort", "source_rows", n("sc")), ("cohort", "base_6m_dropped", n("base")),
        ("cohort", "cohort_captains", n("cohort")), ("cohort", "cohort_orders", n("bc")),
        ("inappchat", "captains_flagged", n("sig_chat")),
        ("inappchat", "female_incidents", "(SELECT coalesce(sum(female_incidents), 0) FROM sig_chat)"),
        ("inappchat", "male_incidents", "(SELECT coalesce(sum(incidents - female_incidents), 0) FROM sig_chat)"),
        ("ticket", "tickets_total", n("tickets")),
        ("ticket", "p0_p1_captains", "(SELECT count(DISTINCT captain_id) FROM sig_ticket)"),
        ("review", "l0_flagged", n("sig_review", "WHERE flag_l0")),
        ("review", "l1_flagged", n("sig_review", "WHERE flag_l1")),
        ("review", "l2_flagged", n("sig_review", "WHERE flag_l2")),
        ("review", "p95_l2_threshold", "(SELECT v FROM p95)"),
        ("review", "total_review_risky", n("sig_review")),
        ("calls", "qualifying_captains", n("calls_metrics")), ("calls", "risky_captains", n("sig_calls")),
        ("calls", "call_rate_threshold", "(SELECT t_rate FROM cthr)"),
        ("calls", "calls_diff_threshold", "(SELECT t_vol FROM cthr)"),
        ("calls", "cv_diff_threshold", "(SELECT t_cv FROM cthr)"),
        ("ocara", "qualifying_captains", n("cancel_metrics")), ("ocara", "risky_captains", n("sig_cancel")),
        ("ocara", "p98_threshold", "(SELECT p98 FROM othr)"), ("ocara", "p02_threshold", "(SELECT p02 FROM othr)"),
        ("ocara", "upper_used", "(SELECT upper_used FROM othr)"),
        ("ocara", "lower_used", "(SELECT lower_used FROM othr)"),
        ("risky", "total_unique_risky", n("risk_master")),
        ("risky", "risky_pct", f"coalesce({n('risk_master')} / nullif({n('cohort')}, 0), 0) * 100"),
        *[("risky", s, n("risk_master", f"WHERE flag_{s}")) for s in ("review", "calls", "ocara", "ticket",
                                                                       "inappchat")],
        ("seed", "safe_seed_captains", n("seed")),
        ("new_feedback", "live_feedback_excluded", n("fb_live", "WHERE excluded")),
        ("new_feedback", "rating_screen_excluded", n("fb_rating", "WHERE excluded")),
        ("new_feedback", "union", n("feedback_ids")),
        *[("feedback_applied", c, f"(SELECT {c} FROM fb_overlap)") for c in OVERLAP_COLUMNS],
        ("final", "nminus1_after_new_feedback", n("nminus1")), ("final", "after_shift_filter", n("final_list")),
        ("audit", "rows", n("audit")), ("audit", "unique_captains", "(SELECT count(DISTINCT captain_id) FROM audit)"),
    ]
    return "\nUNION ALL ".join(f"SELECT '{st}' AS stage, '{mt}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value"
                               for st, mt, v in rows)


def oracle_queries(cfg: RunConfig = CFG) -> dict[str, str]:
    S = lambda needs, select, wide="w1": sql(cfg, needs, select, wide)
    calls_cols = ("captain_id, ride_count_f, ride_count_m, " + _cols("", CALLS_DOUBLES))
    th = ("SELECT 'p99_calls' AS name, round((SELECT v FROM p99), 6) AS value "
          "UNION ALL SELECT 'p95_l2_threshold', round((SELECT v FROM p95), 6) "
          "UNION ALL SELECT 'call_rate_threshold', round(t_rate, 6) FROM cthr "
          "UNION ALL SELECT 'calls_diff_threshold', round(t_vol, 6) FROM cthr "
          "UNION ALL SELECT 'cv_diff_threshold', round(t_cv, 6) FROM cthr "
          "UNION ALL SELECT 'p98_threshold', round(p98, 6) FROM othr "
          "UNION ALL SELECT 'p02_threshold', round(p02, 6) FROM othr "
          "UNION ALL SELECT 'upper_used', round(upper_used, 6) FROM othr "
          "UNION ALL SELECT 'lower_used', round(lower_used, 6) FROM othr")
    top = ("SELECT captain_id, signal, logic, evidence, CAST(rank AS INTEGER) AS rank FROM ("
           "SELECT *, row_number() OVER (PARTITION BY signal ORDER BY captain_id, logic, evidence) AS rank "
           "FROM audit) WHERE rank <= " + str(cfg.top_k_audit))
    return {
        "funnel_metrics": S(FUNNEL_NEEDS, funnel_sql(cfg)),
        "eligible_cohort": S(["cohort"], "SELECT captain_id FROM cohort"),
        "female_stats": S(["female_stats"], "SELECT * FROM female_stats"),
        "cohort_orders": S(["bc"], "SELECT captain_id, order_id, order_date, customer_gender, gender FROM bc"),
        "latest_service": S(["latest_service"], "SELECT * FROM latest_service"),
        "service_class": S(["t2"], "SELECT DISTINCT riderinfo__servicenames, "
                                   f"{service_case('riderinfo__servicenames')} AS service_type FROM t2"),
        "captain_mapping": S(["mapping"], "SELECT * FROM mapping"),
        "cancel_counts": S(["cancels"], "SELECT * FROM cancels"),
        "calls_per_order": S(["calls"], "SELECT * FROM calls"),
        "text_labels": S(["labels"], "SELECT * FROM labels"),
        "feedback_merge": S(["feedback"], "SELECT * FROM feedback"),
        "base_table": S(["base_table"], "SELECT * FROM base_table"),
        "sig_chat": S(["sig_chat"], "SELECT * FROM sig_chat"),
        "sig_ticket": S(["sig_ticket"], "SELECT * FROM sig_ticket"),
        "quantiles": S(["p99", "p95", "cthr", "othr"], th),
        "review_l2": S(["review_l2"], "SELECT captain_id, l2_count_f, l2_count_m, total_rides_f, total_rides_m, "
                                      + _cols("", L2_DOUBLES) + " FROM review_l2"),
        "sig_review": S(["sig_review"], "SELECT captain_id, l0_count, l1_female_count, round(rate_diff, 6) "
                                        "AS rate_diff, flag_l0, flag_l1, flag_l2 FROM sig_review"),
        "calls_metrics": S(["calls_metrics"], f"SELECT {calls_cols} FROM calls_metrics"),
        "sig_calls": S(["sig_calls"], f"SELECT {calls_cols}, f1, f2, f3, breaches FROM sig_calls"),
        "cancel_metrics": S(["cancel_metrics"], "SELECT captain_id, rides_f, rides_m, cancels_f, cancels_m, cc_f, "
                                                "cc_m, accepted_f, accepted_m, " + _cols("", CANCEL_DOUBLES)
                            + " FROM cancel_metrics"),
        "sig_cancel": S(["sig_cancel"], "SELECT captain_id, rides_f, rides_m, cancels_f, cancels_m, cc_f, cc_m, "
                                        "accepted_f, accepted_m, " + _cols("", CANCEL_DOUBLES)
                        + ", direction FROM sig_cancel"),
        "risk_master": S(["risk_master"], "SELECT * FROM risk_master"),
        "safe_seed": S(["seed"], "SELECT * FROM seed"),
        "fb_live": S(["fb_live"], "SELECT * FROM fb_live"),
        "fb_rating": S(["fb_rating"], "SELECT * FROM fb_rating"),
        "fb_overlap": S(["fb_overlap"], "SELECT * FROM fb_overlap"),
        "nminus1": S(["nminus1"], "SELECT * FROM nminus1"),
        "final_list": S(["final_list"], "SELECT * FROM final_list"),
        "audit_log": S(["audit"], "SELECT * FROM audit"),
        "audit_top5": S(["audit"], top),
        "normalize_text": S(["female_stats"], "SELECT * FROM female_stats", wide="w1_dated"),
        "review_null_orders": S(["review_l2"], "SELECT captain_id, l2_count_f, l2_count_m, total_rides_f, total_rides_m, "
                                               + _cols("", L2_DOUBLES) + " FROM review_l2", wide="w1_blank"),
        "cohort_empty": sql(NO_SUCH_STATUS, ["cohort"], "SELECT captain_id FROM cohort"),
        "final_list_shift": sql(replace(cfg, apply_shift_filter=True), ["final_list"], "SELECT * FROM final_list"),
        "sink_final_list": S(["final_list"], "SELECT * FROM final_list"),
        "sink_risk_master": S(["risk_master"], "SELECT * FROM risk_master"),
        "published_final_order": S(["final_list"], "SELECT row_number() OVER (ORDER BY captain_id) AS row_no, *, "
                                                   f"'{cfg.run_tag}' AS run_tag FROM final_list"),
        "published_risk_order": S(["risk_master"], "SELECT row_number() OVER (ORDER BY total_signals DESC, captain_id) "
                                                   f"AS row_no, *, '{cfg.run_tag}' AS run_tag FROM risk_master"),
        "base_table_refreshed": S(["base_table"], "SELECT * FROM base_table"),
        "base_table_by_day": S(["base_table"], "SELECT * FROM base_table"),
        "base_table_bucketed": S(["base_table"], "SELECT * FROM base_table"),
        "base_table_bloom": S(["base_table"], "SELECT * FROM base_table"),
        "latest_service_daily": S(["latest_service"], "SELECT * FROM latest_service"),
        "audit_signals": S(["audit"], "SELECT signal, CAST(row_number() OVER (ORDER BY signal) AS INTEGER) AS place "
                                      "FROM (SELECT DISTINCT signal FROM audit)"),
        "base_cohort_stats": S(["female_stats"], "SELECT * FROM female_stats", wide="base_table"),
        "base_final_list": S(["final_list"], "SELECT * FROM final_list", wide="base_table"),
        "base_audit_log": S(["audit"], "SELECT * FROM audit", wide="base_table"),
    }
