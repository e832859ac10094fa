"""Connected components of a graph given as edges, on DataFrames.

Every round hooks each node to its least smaller neighbour (an aggregate with a
map-side step, so a hub costs one row a task), shortens the hooks by pointer
jumping, and contracts the edges to the roots.  Edges and labels stay in the
shared store between steps; the driver sees one flag a step.  Both sides of each
join are stored tables, so adaptive execution can split a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _any(df: DataFrame) -> bool:
    return not df.isEmpty()


def _compress(hooks: DataFrame) -> DataFrame:
    """(node, root) from (node, root) hooks with root < node: each root replaced by its own until none has one."""
    while True:
        up = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        hooks = stage(
            hooks.select("node", "root").join(up, F.col("root") == F.col("_n"), "left")
            .select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")),
            "cc-jump")
        if not _any(hooks.filter("moved")):
            return hooks.select("node", "root")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node that has a smaller one in its component; root is the component's least node.

    Edges with a null end or equal ends are none.  No edges: no rows.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")]
    edges = stage(edges.filter(F.col(a) != F.col(b)).select(*pair(a, b)).distinct(), "cc-edges")
    labels = None
    while True:
        hooks = _compress(stage(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "cc-hook"))
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            labels = stage(
                labels.join(up, F.col("root") == F.col("_n"), "left")
                .select("node", F.coalesce("_r", "root").alias("root")).unionByName(hooks), "cc-labels")
        h1 = hooks.select(F.col("node").alias("_h"), F.col("root").alias("_hr"))
        h2 = hooks.select(F.col("node").alias("_l"), F.col("root").alias("_lr"))
        edges = stage(
            edges.join(h1, F.col("hi") == F.col("_h"), "left").join(h2, F.col("lo") == F.col("_l"), "left")
            .select(F.coalesce("_hr", "hi").alias("x"), F.coalesce("_lr", "lo").alias("y"))
            .filter("x != y").select(*pair("x", "y")).distinct(), "cc-edges")
        if not _any(edges):
            return labels
