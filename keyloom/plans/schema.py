"""Declarations of tables and indexes. Nothing here touches data: an index is an order and a filter, not a copy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructType

PRIMARY = "primary"


@dataclass(frozen=True)
class Sort:
    """One part of an order: a column name or a Column, ascending or descending."""

    expr: str | Column
    descending: bool = False

    def column(self) -> Column:
        return F.col(self.expr) if isinstance(self.expr, str) else self.expr

    def flipped(self, flip: bool = True) -> Sort:
        return Sort(self.expr, self.descending != flip)

    def ordering(self) -> Column:
        return self.column().desc() if self.descending else self.column().asc()


def asc(expr: str | Column) -> Sort:
    return Sort(expr)


def desc(expr: str | Column) -> Sort:
    return Sort(expr, True)


def as_sort(x: str | Column | Sort) -> Sort:
    return x if isinstance(x, Sort) else Sort(x[1:], True) if isinstance(x, str) and x.startswith("-") else Sort(x)


@dataclass(frozen=True)
class Part:
    """A component of an index's total order. `name` is the record field whose value it is compared with; for a length, the fields."""

    sort: Sort
    names: tuple[str, ...]
    is_length: bool = False

    def value(self, record: dict) -> object:
        """Of a record; MISSING if it doesn't say."""
        if any(n not in record or record[n] is None for n in self.names):
            return MISSING
        if self.is_length:
            return sum(len(v.encode() if isinstance(v, str) else v) for v in (record[n] for n in self.names))
        return record[self.names[0]]


MISSING = object()


def _variable(kind: DataType) -> bool:
    return isinstance(kind, (StringType, BinaryType))


@dataclass(frozen=True)
class IndexDef:
    """A secondary index.

    key: the columns that points and ranges address; none means the whole index, in order.
    order: what sorts rows of one key; the primary key always comes last, ascending.
    where: rows that fail it (a SQL string or Column) are not in the index.
    multi_key: an array expression; a row stands in the index once for each different non-null element, and key then names
    the one field that selectors use for it.
    byte_order: strings in keys sort by their bytes; by default shorter ones come first.
    """

    name: str
    index_id: int
    key: Sequence[str] = ()
    order: Sequence[str | Column | Sort] = ()
    where: str | Column | None = None
    multi_key: str | Column | None = None
    byte_order: bool = False

    def __post_init__(self):
        if not 1 <= self.index_id <= 255:
            raise ValueError("index id must be between 1 and 255; 0 is the primary index")
        if self.name == PRIMARY:
            raise ValueError("the name 'primary' is taken")
        if self.multi_key is not None and len(self.key) != 1:
            raise ValueError("a multi-key index has exactly one key field")
        object.__setattr__(self, "key", tuple(self.key))
        object.__setattr__(self, "order", tuple(as_sort(x) for x in self.order))

    def condition(self) -> Column | None:
        return F.expr(self.where) if isinstance(self.where, str) else self.where

    def keys_array(self) -> Column:
        raw = F.expr(self.multi_key) if isinstance(self.multi_key, str) else self.multi_key
        return F.filter(F.array_distinct(raw), lambda k: k.isNotNull())

    def entries(self, df: DataFrame) -> DataFrame:
        """The index's rows: filtered, and repeated for each key of a multi-key index."""
        if self.where is not None:
            df = df.filter(self.condition())
        if self.multi_key is not None:
            df = df.withColumn(self.key[0], F.explode(self.keys_array()))
        return df


@dataclass(frozen=True)
class TableDef:
    """A typed table: a name, an id of 1 to 255, a schema and the columns of its primary key."""

    name: str
    table_id: int
    schema: StructType
    primary_key: Sequence[str]
    indexes: tuple[IndexDef, ...] = field(default=())

    def __post_init__(self):
        if not 1 <= self.table_id <= 255:
            raise ValueError("table id must be between 1 and 255; 0 is reserved")
        object.__setattr__(self, "primary_key", tuple(self.primary_key))
        if not self.primary_key:
            raise ValueError("a table needs a primary key")
        if missing := [c for c in self.primary_key if c not in self.schema.names]:
            raise ValueError(f"primary key columns {missing} are not in the schema")
        self._check(self.indexes)

    def _check(self, indexes: Sequence[IndexDef]) -> None:
        ids, names = [i.index_id for i in indexes], [i.name for i in indexes]
        if len(set(ids)) != len(ids) or len(set(names)) != len(names):
            raise ValueError("an index with this id or name already exists")
        for i in indexes:
            if i.multi_key is None and (missing := [c for c in i.key if c not in self.schema.names]):
                raise ValueError(f"index {i.name}: columns {missing} are not in the schema")

    def with_indexes(self, *more: IndexDef) -> TableDef:
        return TableDef(self.name, self.table_id, self.schema, self.primary_key, (*self.indexes, *more))

    def index(self, name: str) -> IndexDef | None:
        """None for the primary index."""
        if name == PRIMARY:
            return None
        for i in self.indexes:
            if i.name == name:
                return i
        raise KeyError(f"index not found: {name}")

    def key_parts(self, index: IndexDef | None) -> list[Part]:
        """What must be equal for rows to have one index key."""
        if index is None:
            return [Part(Sort(c), (c,)) for c in self.primary_key]
        return [Part(Sort(c), (c,)) for c in index.key]

    def tail_parts(self, index: IndexDef) -> list[Part]:
        """The order within one index key, primary key included."""
        out = []
        wide = [s.expr for s in index.order if isinstance(s.expr, str) and s.expr in self.schema.names and _variable(self.schema[s.expr].dataType)]
        if wide and not index.byte_order:
            out.append(_length(wide))
        out += [Part(s, (s.expr if isinstance(s.expr, str) else f"order{k}",)) for k, s in enumerate(index.order)]
        return out + [Part(Sort(c), (c,)) for c in self.primary_key]

    def order_parts(self, index: IndexDef | None) -> list[Part]:
        """The total order of an index's rows."""
        if index is None:
            return self.key_parts(None)
        kinds = {c: StringType() if index.multi_key is not None else self.schema[c].dataType for c in index.key}
        wide = [c for c, k in kinds.items() if _variable(k)]
        head = [_length(wide)] if wide and not index.byte_order else []
        return head + self.key_parts(index) + self.tail_parts(index)


def _length(cols: list[str]) -> Part:
    total = F.octet_length(cols[0])
    for c in cols[1:]:
        total = total + F.octet_length(c)
    return Part(Sort(total), tuple(cols), True)
