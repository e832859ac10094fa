"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, materialize, use_scratch_checkpoint_dir

#: White space that parts words, everywhere in this package (ASCII only).
WHITE = r"[\x20\x09-\x0D]+"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the write go with its end; they would otherwise stay on disk
    until the driver's garbage collector meets them.
    """
    conf = df.sparkSession.conf
    had = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, f"llm-{label}")
    finally:
        conf.unset(CLEANUP) if had is None else conf.set(CLEANUP, had)


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path (a URI of the shared store) for files that tasks write."""
    return f"{checkpoint_dir(spark).rstrip('/')}/cohortkit/llm-{label}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """(file system, path) of a URI; every store that pyarrow knows, chosen by the scheme alone."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_scratch_checkpoint_dir(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have: underscores go in front until they differ."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(texts, most: int):
    """Index ranges [a, b) of ``texts`` whose lengths sum to about ``most``; a longer text stands alone."""
    a = total = 0
    for b, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(texts):
        yield a, len(texts)
