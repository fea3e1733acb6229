"""Small DataFrames from values in the driver."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DoubleType, IntegerType, LongType, ShortType, StringType, StructType

_PLAIN = (BinaryType, BooleanType, ByteType, DoubleType, IntegerType, LongType, ShortType, StringType)


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """Rows as a DataFrame. Plain types go by Arrow, which needs no Python worker; the others as Spark itself takes them."""
    if not all(type(f.dataType) in _PLAIN for f in schema.fields):
        return spark.createDataFrame(list(rows), schema)
    kinds = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema.fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds), schema)
