"""Exact nearest-rank quantile as a lazy, distributed plan.

Rule (the reference's default "nearest" interpolation): with ``n`` non-null
values sorted ascending, return the value at 0-based index
``floor((n - 1) * q + 0.5)``.  Spark's ``percentile``, ``percentile_disc`` and
``percentile_approx`` all pick other values, and an un-partitioned
``Window.orderBy`` over the input would pull every row into one task.

One plan finds any number of quantiles of any number of metrics:

1. ``groupBy(metric, value).count()`` -- distinct values with multiplicities
   (partial aggregation first).  A value held by a third of all rows is one row here.
2. Bucket boundaries: per metric ``percentile_approx`` of the distinct values at
   evenly spaced ranks (one row a metric, so bounded), each bucket holding about
   ``distinct / buckets`` values.  The boundaries only need to be sorted, not
   exact: a value's bucket is the number of boundaries below it (a binary search
   of ``log2(buckets)`` projection steps), a monotone function of the value, so
   buckets are contiguous value ranges.  There are as many buckets as shuffle
   partitions (64 at least), and the sketch is just fine enough for them.
3. Bucket totals -> running sum over at most ``buckets`` rows a metric (bounded
   whatever the data size) -> offset of each bucket; joined back on the bucket
   id (small side with a proven size bound).
4. Running count inside each bucket: a window partitioned by metric and bucket,
   ordered by value (spread over the cluster).  Global running count = offset +
   local.  The value whose running range holds rank ``k`` is the answer.

Nothing is collected to the driver and there is no cross join.  The result is
one row, a column a quantile, null where a metric has no non-null value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize as _store

_INF = float("inf")


def value_counts(df: DataFrame, cols: dict[str, str | Column]) -> DataFrame:
    """``(metric, v, c)``: each metric's distinct non-null values (as doubles) with their multiplicity."""
    each = [F.struct(F.lit(name).alias("metric"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v"))
            for name, c in cols.items()]
    return (df.select(F.inline(F.array(*each))).where(F.col("v").isNotNull())
            .groupBy("metric", "v").agg(F.count(F.lit(1)).alias("c")))


def _with_bucket(vals: DataFrame, buckets: int) -> DataFrame:
    """``vals`` with ``b``, the bucket of a value, and ``n``, the metric's number of values."""
    m = buckets - 1
    # one literal array expression (not one JVM call per element)
    ranks = F.expr("array(" + ", ".join(f"{i / buckets!r}D" for i in range(1, buckets)) + ")")
    bounds = vals.groupBy("metric").agg(F.percentile_approx("v", ranks, 20 * buckets).alias("_bounds"),
                                        F.sum("c").alias("n"))
    levels = max(1, (m).bit_length())
    # lower bound by binary search, folded over the halving step sizes: the number
    # of boundaries strictly below v, a monotone function of v
    steps = F.expr("array(" + ", ".join(str(1 << j) for j in reversed(range(levels))) + ")")

    def step(acc, st):
        nxt = acc + st
        return F.when((nxt <= F.lit(m)) & (F.get(F.col("_bounds"), nxt - 1) < F.col("v")), nxt).otherwise(acc)

    return (vals.join(F.broadcast(bounds), "metric")  # one row a metric
            .withColumn("b", F.aggregate(steps, F.lit(0), step)).drop("_bounds"))


def quantiles_from_counts(vals: DataFrame, picks: dict[str, tuple[str, float]], buckets: int | None = None) -> DataFrame:
    """One row with a column for each of ``picks`` (name -> (metric, q)), from ``value_counts`` rows."""
    if not all(0.0 <= q <= 1.0 for _, q in picks.values()):
        raise ValueError(f"quantiles must be in [0, 1], got {picks}")
    buckets = buckets or max(64, int(vals.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = _with_bucket(vals, buckets)
    # running sum over <= buckets rows a metric: bounded whatever the input size
    before = Window.partitionBy("metric").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offs = (x.groupBy("metric", "b").agg(F.sum("c").alias("bc"))
            .select("metric", "b", F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("metric", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = (x.join(F.broadcast(offs), ["metric", "b"])
         .withColumn("upto", F.col("before") + F.sum("c").over(inside)))

    def here(metric: str, q: float) -> Column:
        k = F.floor((F.col("n") - 1).cast("double") * F.lit(float(q)) + F.lit(0.5))
        return (F.col("metric") == metric) & (F.col("upto") - F.col("c") <= k) & (k < F.col("upto"))

    return y.agg(*[F.max(F.when(here(metric, q), F.col("v"))).alias(name) for name, (metric, q) in picks.items()])


def quantile_row(sources: list[tuple[DataFrame, dict[str, str | Column]]], picks: dict[str, tuple[str, float]],
                 materialize: bool = False, **kw) -> DataFrame:
    """One row with a column for each of ``picks`` over the metrics of several frames.

    ``sources`` lists (frame, {metric: column}).  ``materialize`` stores the value
    counts (parquet in the session's checkpoint folder), which the plan reads
    three times, and the row.
    """
    vals = reduce(DataFrame.unionByName, [value_counts(df, cols) for df, cols in sources])
    if not materialize:
        return quantiles_from_counts(vals, picks, **kw)
    return _store(quantiles_from_counts(_store(vals, "value-counts"), picks, **kw), "quantiles")


def quantile_nearest(df: DataFrame, col: str | Column, q: float, **kw) -> DataFrame:
    """Nearest-rank quantile of the non-null values of ``col`` (one-row frame ``value``; no row without values)."""
    return quantile_row([(df, {"value": col})], {"value": ("value", q)}, **kw).where(F.col("value").isNotNull())


def quantile_col(df: DataFrame, col: str | Column, q: float, **kw) -> Column:
    """The quantile as a scalar-subquery column (null when there is no value).

    With ``materialize`` plans that use it embed a scan of one stored row, not the quantile's plan.
    """
    return quantile_nearest(df, col, q, **kw).scalar()


# ---- threshold helpers ---------------------------------------------------

def floor_at(q: Column, floor: float) -> Column:
    """``max(q or 0.0, floor)`` -- null or smaller thresholds are raised to ``floor``."""
    return F.greatest(F.coalesce(q, F.lit(0.0)), F.lit(float(floor)))


def upper_tail(q: Column) -> Column:
    """Use ``q`` as an upper cut only when it is positive, else +infinity."""
    return F.when(q > 0, q).otherwise(F.lit(_INF))


def lower_tail(q: Column) -> Column:
    """Use ``q`` as a lower cut only when it is negative, else -infinity."""
    return F.when(q < 0, q).otherwise(F.lit(-_INF))


def cap_at(x: Column, cap: Column) -> Column:
    """Clip at ``cap``; null -> 0 (``least`` would skip the null, so test it first)."""
    return F.when(x.isNull(), F.lit(0.0)).otherwise(F.least(x, cap))


def breach(x: Column, threshold: Column) -> Column:
    """Null-safe ``x >= threshold`` (null -> False)."""
    return F.coalesce(x >= threshold, F.lit(False))
