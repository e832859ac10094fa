"""Scalar column functions (H1-H24) -- all built-in, JVM-side expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, classes: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Ordered keyword classifier: first class whose keyword occurs in ``lower(text)``.

    ``LOWER(x) LIKE '%k%'`` per keyword; order matters (the first match wins).
    A null text falls through to ``default`` as in SQL ``CASE``.
    """
    low = F.lower(text)
    expr = None
    for label, words in classes:
        cond = None
        for w in words:
            c = low.contains(w.lower())
            cond = c if cond is None else (cond | c)
        cond = F.coalesce(cond, F.lit(False))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def isin_ci(c: Column, values: Sequence[str], upper: bool = False) -> Column:
    """Case-blind ``IN``: ``LOWER(c) IN (...)`` (or ``UPPER``)."""
    f = F.upper if upper else F.lower
    return f(c).isin([v.upper() if upper else v.lower() for v in values])


def safe_ratio(n: Column, d: Column) -> Column:
    """``n / d``, 0.0 when ``d`` is 0 or null."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def lenient_int(c: Column) -> Column:
    return c.try_cast("int")


def lenient_double(c: Column) -> Column:
    return c.try_cast("double")


def lenient_timestamp(c: Column, string_input: bool) -> Column:
    """Order dates may arrive as ``yyyy-MM-dd`` text or as timestamps."""
    if string_input:
        return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def ts_lit(d: dt.date) -> Column:
    """Midnight of ``d`` as a ``timestamp_ntz`` literal."""
    return F.lit(d.strftime("%Y-%m-%d 00:00:00")).cast("timestamp_ntz")
