"""Tables, column names and schemas; lineage cuts are those of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..staging import shared_folder, staged

__all__ = ["fresh", "shared_folder", "staged", "table", "with_fields"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, or a variant of it that no column has."""
    while name in columns:
        name = f"_{name}"
    return name


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` and the fields of ``ddl``."""
    return T.StructType(list(schema.fields) + list(T.StructType.fromDDL(ddl).fields))
