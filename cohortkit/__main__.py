"""Run the job: ``python -m cohortkit --wide <parquet> --out <dir> [--as-of YYYY-MM-DD]``.

``--sources t1=<table or path> ... t11=<...>`` builds the wide table from the
eleven sources first (``--base-out`` keeps it).  The outputs are published by
the manifest ``<dir>/manifest_<tag>.json``.  Uses the active/default
session; the checkpoint folder is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from .config import production_config
from .plans import build_base_table, run_seeding
from .session import materialize
from .sources import read_parquet, read_sources, write_outputs


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="cohortkit")
    ap.add_argument("--wide", help="parquet path or table of the order-grain wide table")
    ap.add_argument("--sources", nargs="*", default=[], help="t1=... t11=... (table names or parquet paths)")
    ap.add_argument("--base-out", help="where to write the built wide table (parquet)")
    ap.add_argument("--out", required=True, help="output folder for the CSV lists and audit log")
    ap.add_argument("--as-of", default=None, help="run date, default today")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    cfg = production_config(dt.date.fromisoformat(args.as_of) if args.as_of else None)
    if args.sources:
        wide = build_base_table(read_sources(spark, dict(s.split("=", 1) for s in args.sources)), cfg)
        if args.base_out:
            wide.write.mode("overwrite").parquet(args.base_out)
            wide = spark.read.parquet(args.base_out)
        else:
            wide = materialize(wide, "wide")
    elif args.wide:
        w = args.wide
        wide = read_parquet(spark, w) if ("/" in w or ":" in w) else spark.table(w)
    else:
        ap.error("give --wide or --sources")
    run = run_seeding(wide, cfg)
    paths = write_outputs(run, args.out)
    run.metrics().write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/metrics_{cfg.run_tag}")
    for k, p in paths.items():
        print(f"{k}: {p}")


if __name__ == "__main__":
    main()
