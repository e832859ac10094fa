"""Flag sets and their algebra.

Id sets stay one-column DataFrames; membership is a semi join, subtraction an
anti join (``NOT IN (subquery)`` would return nothing once a null id appears).
Join strategy is left to AQE: a small side is broadcast from its runtime size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (left semi join)."""
    return df.join(ids.select(key), key, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids`` (left anti join)."""
    return df.join(ids.select(key), key, "left_anti")


def vote_count(flags: Sequence[Column]) -> Column:
    """Number of true flags (nulls count as false)."""
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def k_of_n(flags: Sequence[Column], k: int) -> Column:
    return vote_count(flags) >= F.lit(k)


def union_ids(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Long ``(key, signal)`` frame from named id sets (one row per membership)."""
    parts = [df.select(F.col(key), F.lit(name).alias("signal")) for name, df in sets.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def flag_matrix(sets: Mapping[str, DataFrame], key: str, prefix: str = "flag_",
                total: str = "total_signals") -> DataFrame:
    """One row per key in any set, a boolean per set and the number of sets hit."""
    long = union_ids(sets, key)
    wide = long.groupBy(key).agg(*[F.max(F.col("signal") == name).alias(prefix + name) for name in sets])
    return wide.withColumn(total, vote_count([F.col(prefix + n) for n in sets]))


def overlap_counts(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """``|new|``, ``|new & old|`` and ``|new - old|`` as one row (distinct keys)."""
    n = new.select(key).distinct()
    tagged = n.join(old.select(key).distinct().withColumn("_in_old", F.lit(True)), key, "left")
    return tagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_in_old").isNotNull()).alias("already"),
        F.count_if(F.col("_in_old").isNull()).alias("incremental"),
    )
