"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed end to end (plan build + stage tables + result), in a
fresh run, so no query reuses another's stored tables.  ``full_run`` is the
whole job: cohort, five signals, feedback rules, final list and audit log,
written as CSV to a scratch folder, and the run's metrics.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortkit.queries import CFG, _run, spark_queries  # noqa: E402
from cohortkit.session import local_session  # noqa: E402
from cohortkit.sources.sinks import write_outputs  # noqa: E402

HEADLINE = ["base_table", "eligible_cohort", "quantiles", "sig_calls", "sig_cancel", "risk_master",
            "final_list", "audit_log"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    spark.range(1).count()  # JVM warm-up outside the timings
    qs = spark_queries()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        t = time.time()
        rows[name] = len(qs[name](spark, sf_dir).collect())
        times[name] = round(time.time() - t, 3)
    out = tempfile.mkdtemp(prefix="bench-out-", dir=os.environ.get("TMPDIR", "/tmp"))
    t = time.time()
    run = _run(spark, sf_dir)
    write_outputs(run, out)
    run.metrics().collect()
    times["full_run"] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": float(sf) if sf else sf_dir,
                      "cpus": cpus, "as_of": str(CFG.as_of)}))


if __name__ == "__main__":
    main()
