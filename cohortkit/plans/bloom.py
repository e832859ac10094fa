"""Bloom reductions before a shuffle (C1, C4, C11), by Spark's runtime filters.

A semi join whose id side is too large to broadcast shuffles its big side whole, ids
or not.  With a runtime Bloom filter the big side's scan drops nearly all rows that
cannot meet an id before they are shuffled; the join behind it stays exact.  The filter
has ``bits`` bits whatever the number of ids (more ids let more rows through), so
what is sent to the tasks is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

_CONF = "spark.sql.optimizer.runtime.bloomFilter."


@dataclass(frozen=True)
class Bloom:
    """When a reduction is made, and its size."""

    min_scan: str = "10g"  # big sides from this size on
    max_ids: str = "64g"  # id sides up to this size
    items: int = 10_000_000  # ids that the filter is laid out for
    bits: int = 1 << 26  # 8 MB
    broadcast: str | None = None  # id sides up to this size are broadcast instead (None: as the session says)


@contextmanager
def reduced(spark: SparkSession, bloom: Bloom | None) -> Iterator[None]:
    """Plans that run inside make the reductions; without ``bloom`` nothing changes."""
    conf = {}
    if bloom:
        conf = {_CONF + "enabled": "true", _CONF + "applicationSideScanSizeThreshold": bloom.min_scan,
                _CONF + "creationSideThreshold": bloom.max_ids, _CONF + "expectedNumItems": str(bloom.items),
                _CONF + "maxNumItems": str(bloom.items), _CONF + "numBits": str(bloom.bits),
                _CONF + "maxNumBits": str(bloom.bits)}
        if bloom.broadcast is not None:
            conf["spark.sql.autoBroadcastJoinThreshold"] = bloom.broadcast
    had = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored_ids(ids: DataFrame, label: str) -> DataFrame:
    """``ids`` stored, and read under a condition that all meet: Spark makes a
    filter only from a scan with a condition on it, not from an aggregate."""
    return materialize(ids.withColumn("held", F.lit(1)), label).where(F.col("held") >= 1).drop("held")
