"""Latest rows kept as a state that takes in new rows.

The one-shot pick ranks the whole history each run.  The state holds one row a key,
the greatest ``(order, ties, payload)`` struct so far, in a table bucketed by the key.
Folding in a day reads the state and that day: the day is reduced to a row a key
(with a map-side step), shuffled into the state's buckets and merged by a full outer
join; the state's rows stay where they are.  A maximum does not mind order or
repetition, so days may come late, twice, or in one lot, with the same state.

Each fold writes a table of its own and leaves the one it read, so a fold that stops
half way is run again from the same state.  A null key is nobody's and is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import latest_struct
from ..sources.bucketed import write_bucketed


@dataclass(frozen=True)
class Latest:
    """What a state keeps: the newest ``payload`` of each ``key``, by ``order`` then ``ties`` (all descending)."""
    key: str
    order: Sequence[str]
    payload: Sequence[str]
    ties: Sequence[str] = ()
    buckets: int = 200

    def reduce(self, rows: DataFrame, name: str = "latest") -> DataFrame:
        return (rows.where(F.col(self.key).isNotNull()).groupBy(self.key)
                .agg(latest_struct(self.order, self.ties, self.payload).alias(name)))


SERVICE = Latest("captain_id", ["updated_epoch"], ["riderinfo__servicenames", "updated_epoch"])
SNAPSHOT = Latest("captain_id", ["created_on"], ["shift_name", "mobile", "city"])


def merged(state: DataFrame, rows: DataFrame, what: Latest) -> DataFrame:
    """(key, latest) of the state and the new rows together; only the new rows are shuffled."""
    new = what.reduce(rows, "newer").withColumnRenamed(what.key, "newer_key")
    both = state.join(new, state[what.key] == new["newer_key"], "full_outer")
    return both.select(F.coalesce(what.key, "newer_key").alias(what.key), F.greatest("latest", "newer").alias("latest"))


def fold(state: DataFrame | None, rows: DataFrame, what: Latest, table: str, path: str) -> DataFrame:
    """The state with ``rows`` taken in, stored as ``table`` at ``path`` (neither of them the state's own)."""
    if state is None:
        return write_bucketed(what.reduce(rows), table, path, [what.key], what.buckets)
    # the join leaves each key in its bucket, so the rows need no second shuffle
    return write_bucketed(merged(state, rows, what), table, path, [what.key], what.buckets, place=False)


def rows_of(state: DataFrame, what: Latest) -> DataFrame:
    """The state as key and payload columns, as ``latest_per_key`` gives them."""
    return state.select(what.key, *[F.col("latest")[c].alias(c) for c in what.payload])
