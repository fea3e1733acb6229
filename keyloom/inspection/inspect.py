"""Ad-hoc queries by names and dicts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from ..functions import cond
from ..operators.table import Table
from ..plans.schema import PRIMARY
from ..plans.selector import Point


def _fits(kind: DataType, v: object) -> bool:
    if isinstance(kind, BooleanType):
        return isinstance(v, bool)
    if isinstance(kind, NumericType):
        return isinstance(v, (int, float)) and not isinstance(v, bool)
    return isinstance(v, str) if isinstance(kind, StringType) else True


class Inspect:
    def __init__(self, tables: list[Table]):
        self._tables = {t.name: t for t in tables}

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def _table(self, name: str) -> Table:
        if name not in self._tables:
            raise KeyError("table not found")
        return self._tables[name]

    def indexes(self, table: str) -> list[str]:
        return [PRIMARY, *(i.name for i in self._table(table).definition.indexes)]

    def entry_fields(self, table: str) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self._table(table).definition.schema.fields}

    def query_df(self, table: str, index: str = PRIMARY, selector: dict | None = None, filter: dict | None = None, limit: int = 0, after: dict | None = None) -> DataFrame:
        """Rows of the table. selector: a point of a secondary index (the primary index ignores it). filter: fields that must be equal; numbers of any kind compare, an unknown field or another kind of value matches nothing. limit 0: all."""
        t = self._table(table)
        i = t.definition.index(index)
        q = t.query()
        if i is not None:
            q = q.with_(i, Point(self._record(t, selector or {}, i.key)))
        if filter:
            q = q.filter(self._filter(t, filter))
        if after:
            q = q.after(self._record(t, after))
        return q.limit(limit).to_df()

    def query(self, *args, **kwargs) -> list[dict]:
        """The rows of query_df() as dicts, all in the driver: give a limit."""
        return [r.asDict(recursive=True) for r in self.query_df(*args, **kwargs).collect()]

    @staticmethod
    def _record(t: Table, given: dict, extra: tuple[str, ...] = ()) -> dict:
        for k, v in given.items():
            if k not in t.definition.schema.names and k not in extra:
                raise ValueError(f"field {k} not found")
            if k in t.definition.schema.names and not _fits(t.definition.schema[k].dataType, v):
                raise ValueError(f"field {k} can't be {json.dumps(v, default=str)}")
        return given

    @staticmethod
    def _filter(t: Table, given: dict):
        schema = t.definition.schema
        if any(k not in schema.names or not _fits(schema[k].dataType, v) for k, v in given.items()):
            return F.lit(False)
        return cond.and_(*(cond.eq(k, v) for k, v in given.items()))
