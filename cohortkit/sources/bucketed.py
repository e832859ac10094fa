"""Bucketed tables (C8, C9, E1, E2): a join or aggregate on the bucket key reads them in place.

A bucketed table is a catalog table over Parquet files; rows with one key lie in one
bucket, so a key that holds a large part of the rows makes one long bucket, which
adaptive execution cannot split.  Bucket by keys that spread (order ids), and read a
table with a hot key with ``spark.sql.sources.bucketing.enabled`` off.  The number of
buckets should be ``spark.sql.shuffle.partitions`` or more: below it the planner may
choose to shuffle both sides of a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame

from ..session import at_once

#: The order id's column in the sources that are joined or grouped by it.
ORDER_KEYS = {"t1": "order_id", "t6": "eventprops__orderid"}


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int, place: bool = True) -> DataFrame:
    """``df`` stored at ``path`` as the catalog table ``table`` in ``buckets`` by ``keys``; returns the table.

    ``place`` shuffles the rows first, so that a bucket is one file.  Without it every
    task writes a file for each bucket it holds rows of: right for rows that lie in
    such buckets already.
    """
    rows = df.repartition(buckets, *keys) if place else df
    (rows.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
     .saveAsTable(table))
    return df.sparkSession.table(table)


def bucket_count(df: DataFrame, rows: int = 2_000_000, least: int = 16) -> int:
    """Buckets of about ``rows`` rows of ``df``, ``least`` at least: with a fixed number each bucket, which one task
    sorts and writes, grows with the table."""
    return max(least, -(-df.count() // rows))


def bucket_by_order(src: Mapping[str, DataFrame], prefix: str, root: str, buckets: int) -> dict[str, DataFrame]:
    """The sources with the order log and the calls bucketed by order id (tables ``<prefix>_t1``, ``<prefix>_t6``)."""
    stored = at_once({n: partial(write_bucketed, src[n], f"{prefix}_{n}", f"{root.rstrip('/')}/{n}", [key], buckets)
                      for n, key in ORDER_KEYS.items()})
    return {**src, **stored}
