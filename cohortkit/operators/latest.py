"""Latest row per key.

The reference writes ``ROW_NUMBER() OVER (PARTITION BY k ORDER BY o DESC)`` and
keeps ``rn = 1``.  Here the pick is one aggregate: ``max(struct(order, ties,
payload))`` per key.  It has a map-side partial step, so a key holding a third
of all rows is reduced to one row per map task before the shuffle, and several
conditional picks over one scan share one ``groupBy`` (the single-pass form of
the three text-label CTEs and the two feedback CTEs).

Ordering: descending on each order column, then on each tie column, then on
the payload; nulls rank lowest (``DESC NULLS LAST``), so the pick is
deterministic even when the reference's is arbitrary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fields(order: Sequence[str], ties: Sequence[str], payload: Sequence[str]) -> list[str]:
    out: list[str] = []
    for c in (*order, *ties, *payload):
        if c not in out:
            out.append(c)
    return out


def latest_struct(order: Sequence[str], ties: Sequence[str] = (), payload: Sequence[str] = (),
                  when: Column | None = None) -> Column:
    """Aggregate expression: the greatest ``(order, ties, payload)`` struct of a group.

    ``when`` restricts the candidate rows (rows failing it are ignored).
    """
    s = F.struct(*[F.col(c).alias(c) for c in _fields(order, ties, payload)])
    return F.max(s if when is None else F.when(when, s))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], ties: Sequence[str] = (),
                   payload: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the row ranked first by ``order`` desc, then ``ties`` desc.

    Returns ``keys + payload`` columns (``payload`` defaults to every other column).
    """
    keys = list(keys)
    if payload is None:
        payload = [c for c in df.columns if c not in keys]
    payload = [c for c in payload if c not in keys]
    picked = df.groupBy(*keys).agg(latest_struct(order, ties, payload).alias("_latest"))
    return picked.select(*keys, *[F.col("_latest")[c].alias(c) for c in payload])


def latest_per_key_by_case(df: DataFrame, keys: Sequence[str], cases: Mapping[str, Column],
                           order: Sequence[str], ties: Sequence[str] = (),
                           payload: Sequence[str] = ()) -> DataFrame:
    """Several latest picks in one pass: one struct per named case.

    Returns ``keys`` plus one struct column per case (null when no row of the
    key satisfies the case).  Replaces N windows over N filtered copies of the
    same input with one shuffle.
    """
    aggs = [latest_struct(order, ties, payload, when=cond).alias(name) for name, cond in cases.items()]
    return df.groupBy(*keys).agg(*aggs)
