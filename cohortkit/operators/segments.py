"""Two-segment statistics: segment pivots, two-level sums.

The reference pivots long ``(captain, gender, value)`` frames to wide
``value_Female`` / ``value_Male`` columns.  Here a segment pivot is one
conditional aggregate per segment over the long frame, with the pivot's null
for a missing segment kept (a count over no rows is null, not 0).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_segments(long: DataFrame, key: str, segment: str, segments: Mapping[str, str],
                   values: Sequence[str], fill: Mapping[str, object] | None = None) -> DataFrame:
    """Long ``(key, segment, values...)`` -> one row per key with ``value_suffix`` columns.

    ``segments`` maps segment value -> suffix (e.g. ``{"Female": "Female"}``).
    The segment list is literal, so no job runs to discover it.  Missing
    segments give null (or ``fill[value]`` when given).  ``long`` must be unique
    on ``(key, segment)``.
    """
    fill = dict(fill or {})
    aggs = []
    for v in values:
        for seg, suf in segments.items():
            e = F.max(F.when(F.col(segment) == seg, F.col(v)))
            if v in fill:
                e = F.coalesce(e, F.lit(fill[v]))
            aggs.append(e.alias(f"{v}_{suf}"))
    return long.groupBy(key).agg(*aggs)


def max_then_sum(df: DataFrame, key: str, sub_key: str | Sequence[str], cols: Mapping[str, str],
                 fill: object = 0) -> DataFrame:
    """Undo values repeated on every row of a ``(key, sub_key)`` group, then add up.

    ``cols`` maps output name -> input column: per ``(key, sub_key)`` take
    ``max(coalesce(col, fill))``, then ``sum`` per ``key``.  Both steps have a
    partial aggregate; the second groups a far smaller frame.
    """
    sub = [sub_key] if isinstance(sub_key, str) else list(sub_key)
    daily = df.groupBy(key, *sub).agg(*[F.max(F.coalesce(F.col(c), F.lit(fill))).alias(o) for o, c in cols.items()])
    return daily.groupBy(key).agg(*[F.sum(o).alias(o) for o in cols])
