"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to ``2 ** bits`` steps at the corpus's own
quantiles, documents are sorted by the curve index of their cell, and the sorted
run is written to files and cut into shards.  Neighbours on the curve are close
in every dimension, so each file spans a small box of metadata and its Parquet
statistics let a reader skip it on any of the dimensions.

Law ``rows``: shard sizes differ by at most one row.  A shard is a run of the
curve; a document's place is its file's offset plus its row in the file.

Scale.  One aggregate for the quantiles of numbers, one ranking of the distinct values
of each string dimension, one range shuffle of the documents, one write.  The sort key ends with the id, so a cell that holds a third of all rows
still spreads over many files.  What reaches the driver is the quantiles (at most
2 ** bits a dimension); offsets are sums over files, broadcast with one row a file
(``write_curve`` makes at most ``files``), so the texts move once.

Defined results: a null in a dimension sorts before every value; a null text has
size 1 and the crc of no bytes; equal rows sit side by side; an empty table has
no shards.  Equal texts are not kept in one shard (the law counts rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, spare, stage, stage_path


@dataclass(frozen=True)
class Curve:
    dims: tuple = ("lang", "source", "n_chars")
    bits: int = 4


def number(col: str) -> Column:
    """A numeric dimension; null lies below every value."""
    return F.coalesce(F.col(col).cast("double"), F.lit(float("-inf")))


def string_cuts(docs: DataFrame, col: str, steps: int) -> list[str]:
    """Values that part the rows of a string dimension in ``steps`` near equal shares, by the order of whole strings.

    The distinct values are ranked by range partitions: a count each, a running sum inside a partition, and the
    partitions' own sums (a row each).  At most ``steps - 1`` values reach the driver.
    """
    parts = shuffle_partitions(docs.sparkSession)
    count = docs.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = stage(count.repartitionByRange(parts, "v").select("v", "n", F.spark_partition_id().alias("p")), "curve-values")
    whole = values.groupBy(F.col("p").alias("q")).agg(F.sum("n").alias("m"))
    order, every = Window.orderBy("q"), Window.partitionBy()
    whole = whole.select("q", (F.sum("m").over(order) - F.col("m")).alias("before"), F.sum("m").over(every).alias("rows"))
    # a row a range partition: bounded by the shuffle partitions
    upto = values.join(F.broadcast(whole), F.col("p") == F.col("q")).withColumn(
        "upto", F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    got = upto.agg(*[F.min(F.when(F.col("upto") * steps >= F.col("rows") * k, F.col("v"))).alias(f"c{k}")
                     for k in range(1, steps)]).first()
    return sorted({c for c in got if c is not None}, key=lambda c: c.encode("utf-8", "surrogatepass"))


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points (n, dims), by the transpose form of the curve."""
    x = [coords[:, i].astype(np.int64).copy() for i in range(coords.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the highest bit down
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def curve_index(docs: DataFrame, curve: Curve) -> Column:
    kinds = dict(docs.dtypes)
    steps = 1 << curve.bits
    at = [k / steps for k in range(1, steps)]
    numeric = [d for d in curve.dims if kinds[d] != "string"]
    found = docs.agg(*[F.percentile_approx(number(d), at, 2000).alias(f"c{i}") for i, d in enumerate(numeric)]).first() if numeric else ()
    cuts = {d: sorted(set(c or [])) for d, c in zip(numeric, found)}
    cuts.update({d: string_cuts(docs, d, steps) for d in curve.dims if d not in cuts})
    bits = curve.bits

    def cell(d: str) -> Column:
        """Number of cuts below the value, stretched: few cuts (few values) still span the whole side of the cube."""
        value = number(d) if d in numeric else F.col(d)
        below = sum((F.coalesce(value > F.lit(c), F.lit(False)).cast("int") for c in cuts[d]), F.lit(0))
        return F.floor(below * ((1 << bits) - 1) / max(len(cuts[d]), 1)).cast("int")

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    return index(*[cell(d) for d in curve.dims])


def write_curve(docs: DataFrame, path: str, curve: Curve = Curve(), id_col: str = "doc_id", text_col: str = "text",
                files: int | None = None) -> str:
    """``docs`` and their curve index written to ``path`` as Parquet files, each a run of the curve; returns the
    index column's name (one that ``docs`` does not have)."""
    files = files or 2 * shuffle_partitions(docs.sparkSession)
    name, = spare(docs, "_curve")
    (docs.withColumn(name, curve_index(docs, curve))
     .repartitionByRange(files, name, id_col)
     .sortWithinPartitions(name, id_col, text_col)
     .write.option("parquet.block.size", 64 << 20).parquet(path))
    return name


def read_shards(spark, path: str, n_shards: int) -> DataFrame:
    """The files' rows with ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    meta = lambda f: F.col(f"_metadata.{f}")
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    names = [c for c in rows.columns if c not in ("shard", "slot")]  # columns of that name give way
    file, at, of, count, before, total, rank = spare(rows, "_file", "_at", "_of", "_n", "_before", "_all", "_rank")
    rows = rows.select("*", meta("file_name").alias(file), meta("row_index").alias(at))
    # the writer numbers its files in range order: part-00000, part-00001, ...
    size = rows.groupBy(F.col(file).alias(of)).agg(F.count(F.lit(1)).alias(count))
    upto = F.sum(count).over(Window.orderBy(of))  # a row a file
    size = size.select(of, (upto - F.col(count)).alias(before), F.sum(count).over(Window.partitionBy()).alias(total))
    # a row a file, and write_curve makes one file a range: bounded by its ``files``, so the texts are not shuffled again
    rows = rows.join(F.broadcast(size), F.col(file) == F.col(of)).withColumn(rank, F.col(before) + F.col(at))
    place, each, more = F.col(rank), F.floor(F.col(total) / n_shards), F.col(total) % n_shards
    wide = more * (each + 1)  # the first `more` shards have one row more
    shard = F.when(place < wide, F.floor(place / (each + 1))).otherwise(
        more + F.floor((place - wide) / F.greatest(each, F.lit(1)))).cast("int")
    start = shard * each + F.least(shard.cast("long"), more)
    return rows.select(*names, shard.alias("shard"), (place - start).cast("long").alias("slot"))


def shards(docs: DataFrame, n_shards: int = 8, curve: Curve = Curve(), id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, read back from the files written for it."""
    path = stage_path(docs.sparkSession, "shards")
    name = write_curve(docs, path, curve, id_col, text_col)
    return read_shards(docs.sparkSession, path, n_shards).drop(name)
