"""Raw keys and values beside the typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from ..plans.schema import TableDef
from .catalog import Catalog

DEFINITION = TableDef("__kv", 255, StructType().add("key", BinaryType(), False).add("value", BinaryType()), ["key"])


class KeyValues:
    def __init__(self, catalog: Catalog):
        self.table = catalog.table(DEFINITION)

    def set(self, key: bytes, value: bytes, batch=None) -> None:
        self.table.unsafe_insert([(key, value)], batch)

    def put(self, rows: DataFrame, batch=None) -> None:
        """Rows of key and value."""
        self.table.unsafe_insert(rows, batch)

    def get(self, key: bytes, batch=None) -> bytes:
        return bytes(self.table.get_point({"key": key}, batch).value)

    def delete(self, key: bytes, batch=None) -> None:
        self.table.delete([{"key": key}], batch)

    def delete_range(self, start: bytes, end: bytes, batch=None) -> None:
        """Keys from start on, up to but without end."""
        self.table.delete(self._between(self.table.df(batch), start, end), batch)

    def range(self, lower: bytes | None = None, upper: bytes | None = None, reverse: bool = False, batch=None) -> DataFrame:
        """Rows from lower on, up to but without upper, by key (unsigned bytes)."""
        return self._between(self.table.df(batch), lower, upper).orderBy(F.desc("key") if reverse else F.asc("key"))

    @staticmethod
    def _between(df: DataFrame, lower: bytes | None, upper: bytes | None) -> DataFrame:
        df = df if lower is None else df.where(F.col("key") >= F.lit(bytearray(lower)))
        return df if upper is None else df.where(F.col("key") < F.lit(bytearray(upper)))


def user_key(*parts: bytes) -> bytes:
    """A namespaced key: each part behind its length."""
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)
