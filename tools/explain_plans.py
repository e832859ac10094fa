"""Print formatted physical plans of the key stages (sf 0.001 by default)."""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortkit.operators import quantile_nearest  # noqa: E402
from cohortkit.plans import base_table as bt  # noqa: E402
from cohortkit.queries import CFG, _run  # noqa: E402
from cohortkit.session import local_session  # noqa: E402
from cohortkit.sources.fixtures import source_views  # noqa: E402


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8, shuffle_partitions=16)
    r = _run(spark, sf)
    src = source_views(spark, sf)
    stages = {
        "Scoped scan (script input): pushed filters and pruned columns": r.cohort.scoped.select(
            "captain_id", "order_id", "order_date", "customer_gender"),
        "Eligible cohort: one partial+final aggregate per captain": r.cohort.ids,
        "Per-captain facts before storing: single-distinct plan on (captain, gender, order)":
            __import__("cohortkit.plans.signals", fromlist=["captain_facts"]).captain_facts(
                r.signal_orders, CFG),
        "Nearest-rank quantile (p98 of the cancel diff)": quantile_nearest(r.signals.cancel.metrics, "diff", 0.98),
        "Text labels: one groupBy with three conditional latest picks": bt.text_labels(src, CFG),
        "Feedback merge: one scan, two conditional latest picks (no full outer join)": bt.feedback_merge(src, CFG),
        "Final list": r.final,
        "Audit top-5 per signal (partial WindowGroupLimit)": __import__(
            "cohortkit.plans.seeding", fromlist=["audit_top"]).audit_top(r.audit, 5),
    }
    out = ["# Physical plans of the key stages", "",
           f"Generated by `tools/explain_plans.py` at `{sf}` (`local[8]`, AQE on; initial plans,",
           "AQE re-plans at run time). Stored stage tables appear as parquet scans.", ""]
    for title, df in stages.items():
        out += [f"## {title}", "", "```", plan(df).strip(), "```", ""]
    print("\n".join(out))


if __name__ == "__main__":
    main()
