"""Source tables by name (A1): the eleven inputs of the base-table build.

On a cluster each logical source maps to a catalog table or a parquet path;
the mapping is configuration, the plans only see ``t1`` .. ``t11``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

SOURCE_ROLES = {
    "t1": "order log (fact)",
    "t2": "captain service-names change history",
    "t3": "captain snapshot",
    "t4": "supply journey summary",
    "t5": "classified cancel events",
    "t6": "call events",
    "t7": "text-classifier output",
    "t8": "text-classifier input",
    "t9": "service mapping",
    "t10": "users snapshot",
    "t11": "quality / feedback events",
}


DAY = "yyyymmdd"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; a folder level ``yyyymmdd=20260603`` is read as text, as the plans compare it.

    (Spark takes such a level for a number; a comparison with text would then cast
    the column, and no partition would be left out.)
    """
    df = spark.read.parquet(path)
    if DAY in df.columns and not isinstance(df.schema[DAY].dataType, StringType):
        fields = [StructField(f.name, StringType(), f.nullable) if f.name == DAY else f for f in df.schema.fields]
        df = spark.read.schema(StructType(fields)).parquet(path)
    return df


def read_sources(spark: SparkSession, mapping: Mapping[str, str]) -> dict[str, DataFrame]:
    """``{"t1": "catalog.schema.table" or "/path/to/parquet", ...}`` -> lazy DataFrames.

    A value containing ``/`` or ``:`` is read as parquet, anything else with
    ``spark.table``.  Tables partitioned by day are pruned to the run's days.
    """
    missing = set(SOURCE_ROLES) - set(mapping)
    if missing:
        raise KeyError(f"missing sources: {sorted(missing)}")
    return {k: (read_parquet(spark, v) if ("/" in v or ":" in v) else spark.table(v)) for k, v in mapping.items()}
