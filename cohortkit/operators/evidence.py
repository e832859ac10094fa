"""Evidence strings and audit parts.

Every audit part has the schema ``(captain_id, signal, logic, evidence)``;
``audit_union`` stacks them by name.  Numbers print as Spark casts them to
text, except doubles rounded for display, which use a fixed ``%.4f`` so small
values do not turn into ``1.0E-4``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_COLUMNS = ("captain_id", "signal", "logic", "evidence")


def fixed4(x: Column) -> Column:
    """Round half up to 4 places and print with exactly 4 decimals (null stays null)."""
    return F.when(x.isNotNull(), F.format_string("%.4f", F.round(x, 4)))


def kv(*pairs: tuple[str, Column]) -> Column:
    """``k1=v1, k2=v2`` with every value cast to text and null printed as ``NA``."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("NA"))) for k, v in pairs]
    return F.concat_ws(", ", *parts)


def joined_flags(parts: Sequence[tuple[Column, str]], sep: str = "+") -> Column:
    """Names of the true flags joined by ``sep`` (false/null flags are skipped)."""
    return F.concat_ws(sep, *[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in parts])


def audit_part(df: DataFrame, key: str, signal: str | Column, logic: str | Column, evidence: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.col(key).alias("captain_id"), lit(signal).alias("signal"),
                     lit(logic).alias("logic"), evidence.alias("evidence"))


def audit_union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
