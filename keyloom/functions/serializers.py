"""Rows as single values: JSON text, or a binary form of one's own, for stores that hold opaque records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


@dataclass(frozen=True)
class Serializer:
    """to: of a struct column to a value. back: of a value to a struct of the given type. Both stay in the JVM if their expressions do."""

    to: Callable[[Column], Column]
    back: Callable[[Column, DataType], Column]


JSON = Serializer(lambda row: F.to_json(row, {"ignoreNullFields": "false"}), lambda v, kind: F.from_json(v, kind, {"mode": "FAILFAST"}))


def serialized(df: DataFrame, keys: list[str], serializer: Serializer = JSON, value: str = "value") -> DataFrame:
    """The key columns, and all columns as one value."""
    return df.select(*keys, serializer.to(F.struct("*")).alias(value))


def deserialized(df: DataFrame, schema: StructType, serializer: Serializer = JSON, value: str = "value") -> DataFrame:
    return df.select(serializer.back(F.col(value), schema).alias("r")).select("r.*")
