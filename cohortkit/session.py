"""Session helpers.

The library never creates a session behind the caller's back; these helpers are
for tests, the bench and command-line runs.  On a cluster the session comes
from the platform and ``spark.checkpoint.dir`` names the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Observation, SparkSession

T = TypeVar("T")

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "cohortkit",
                  extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**SESSION_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return use_scratch_checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for stored stage tables, as the session names it.

    Fails when the session has none: a machine-local folder would split a
    stage's part files over the executors of a cluster.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def use_scratch_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """For tests, bench and registered queries: a scratch folder where the session names none.

    Only a ``local`` master, whose driver and executors are one process, gets
    one; any other master must name its shared folder.
    """
    sc = spark.sparkContext
    unset = not (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
                 or sc.getConf().get("spark.checkpoint.dir", None))
    if unset and (sc.master == "local" or sc.master.startswith("local[")):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortkit-ckpt-"))
    checkpoint_dir(spark)
    return spark


def at_once(jobs: Mapping[str, Callable[[], T]], most: int = 4) -> dict[str, T]:
    """The results of ``jobs`` that do not depend on each other, up to ``most`` of them running at a time.

    Spark's first-in-first-out order gives the free cores to the earliest job, so the
    next ones use what its last tasks and its commit leave idle; name the longest first.
    The jobs must not change the session's settings.
    """
    with ThreadPoolExecutor(most) as pool:
        running = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: job.result() for name, job in running.items()}


def materialize_counted(df, label: str, counts: dict) -> tuple:
    """``materialize`` with aggregates taken on the way: (stored frame, {name: value}).

    The aggregates (an ``Observation``) sit on top of the written plan, in the stage
    whose tasks write the files: the driver counts each partition of that stage
    once, so retried and speculative tasks add nothing.
    """
    seen = Observation()
    stored = materialize(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), label)
    return stored, dict(seen.get)


def materialize(df, label: str = "stage"):
    """Write ``df`` as parquet under the session's checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but in one job (an eager RDD
    checkpoint computes its plan twice) and the stored files carry real size
    statistics for AQE's join choices.  The folder is the shared one named by
    ``spark.checkpoint.dir`` on a cluster; a fresh sub-folder per call.
    """
    spark = df.sparkSession
    root = checkpoint_dir(spark).rstrip("/")
    path = f"{root}/cohortkit/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
