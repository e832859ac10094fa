"""Sinks: the job's five CSV outputs, named with the run tag, published together.

A run writes its outputs into a folder of its own; readers find them through the
tag's manifest, a small file put in place last and in one step.  A run that stops
half way leaves the manifest of the run before it, so the outputs named by a
manifest are always those of one run; a rerun of a tag replaces its manifest.
Paths come from the caller; nothing is written to a machine-local default.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "captain_id"
OUTPUT_NAMES = {
    "seed": "seeding_list_{tag}",
    "nminus1": "seed_nminus1_{tag}",
    "final": "final_list_{tag}",
    "audit": "audit_log_{tag}",
    "risk": "risk_master_{tag}",
}


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def _store(spark: SparkSession, path: str):
    """(Hadoop path, file context) of a path, whatever store it names."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and renamed over the old one."""
    jvm = spark._jvm
    aside, files = _store(spark, f"{path}.{uuid.uuid4().hex}")
    system = aside.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(aside)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    over = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(files.makeQualified(aside), files.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), over)


def manifest_path(out_dir: str, tag: str) -> str:
    return f"{out_dir.rstrip('/')}/manifest_{tag}.json"


def write_outputs(run, out_dir: str) -> dict[str, str]:
    """Write seed, n-minus-1, final list, audit log and risk master, then the manifest; name -> path.

    Id lists are sorted by captain and the risk master by number of signals
    (desc) then captain -- a range-partitioned sort of small per-captain
    tables, only at the sink.
    """
    tag = run.cfg.run_tag
    frames = {"seed": run.seed.orderBy(KEY), "nminus1": run.nminus1.orderBy(KEY), "final": run.final.orderBy(KEY),
              "audit": run.audit, "risk": run.risky.orderBy(F.desc("total_signals"), F.col(KEY))}
    folder = f"{out_dir.rstrip('/')}/run_{tag}_{uuid.uuid4().hex}"
    paths = {k: write_csv(frames[k], f"{folder}/{OUTPUT_NAMES[k].format(tag=tag)}") for k in frames}
    schemas = {k: f.schema.jsonValue() for k, f in frames.items()}
    _put(run.wide.sparkSession, manifest_path(out_dir, tag),
         json.dumps({"tag": tag, "outputs": paths, "schemas": {k: json.dumps(v) for k, v in schemas.items()}}))
    return paths


def read_manifest(spark: SparkSession, out_dir: str, tag: str) -> dict:
    """The tag's published run: ``tag``, ``outputs`` (name -> path) and ``schemas``."""
    text = spark.read.text(manifest_path(out_dir, tag), wholetext=True).first()
    return json.loads(text.value)


def read_output(spark: SparkSession, out_dir: str, tag: str, name: str, numbered: bool = False) -> DataFrame:
    """A published output with its types; ``numbered``: and ``row_no``, its place in the files from 1 on.

    Part files are named in the order of the sort.  Rows are numbered inside their
    file, and files follow each other by their sizes (a row a file).
    """
    from pyspark.sql.types import StructType

    held = read_manifest(spark, out_dir, tag)
    rows = spark.read.option("header", True).schema(StructType.fromJson(json.loads(held["schemas"][name]))).csv(held["outputs"][name])
    if not numbered:
        return rows
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_at")))
    files = rows.groupBy(F.col("_file").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    files = files.select("_of", (F.sum("_n").over(Window.orderBy("_of")) - F.col("_n")).alias("_before"))
    names = [c for c in rows.columns if not c.startswith("_")]
    return rows.join(files, F.col("_file") == F.col("_of")).select((F.col("_before") + F.col("_nth")).alias("row_no"), *names)
