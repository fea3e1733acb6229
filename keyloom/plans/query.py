"""The query builder. Each method returns a new query; to_df() compiles it to one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import PRIMARY, IndexDef, Part, Sort, TableDef, as_sort
from .selector import SEGMENT, Point, Selector, compare, membership, select
from .skip import skip

Condition = Column | str | Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Query:
    table: TableDef
    rows: Callable[[object | None], DataFrame]  # of a batch or None
    _index: IndexDef | None = None
    _selector: Selector = Point()
    _filter: Condition | None = None
    _order: tuple[Sort, ...] = ()
    _reverse: bool = False
    _offset: int = 0
    _limit: int = 0
    _after: dict | None = None
    _others: tuple[Query, ...] = ()

    def with_(self, index: str | IndexDef | None, selector: Selector) -> Query:
        """The access path; a later one replaces an earlier one."""
        return replace(self, _index=self.table.index(index) if isinstance(index, str) else index, _selector=selector)

    def filter(self, condition: Condition) -> Query:
        """A row predicate; a later one replaces an earlier one. See functions.cond."""
        return replace(self, _filter=condition)

    def order(self, *keys: str | Column | Sort) -> Query:
        """Sorts by these keys ("-c" is descending) and then the primary key, instead of the index's order."""
        return replace(self, _order=tuple(as_sort(k) for k in keys))

    def reverse(self) -> Query:
        return replace(self, _reverse=not self._reverse)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise ValueError("offset must not be negative")
        return replace(self, _offset=n)

    def limit(self, n: int) -> Query:
        """0 is no limit."""
        if n < 0:
            raise ValueError("limit must not be negative")
        return replace(self, _limit=n)

    def after(self, record: dict) -> Query:
        """Only rows that come after this one. With order(), everything if it is not among the rows."""
        return replace(self, _after=dict(record))

    def intersects(self, *others: Query) -> Query:
        """Only rows that the other queries' selectors cover too; they may not do more than select. Rows come in primary key order."""
        return replace(self, _others=(*self._others, *others))

    @property
    def index_name(self) -> str:
        return PRIMARY if self._index is None else self._index.name

    def to_df(self, batch: object | None = None) -> DataFrame:
        df = self.rows(batch)
        names = df.columns
        if self._others:
            found, order = self._intersected(df), [Sort(c) for c in self.table.primary_key]
            parts = self.table.key_parts(None)
        else:
            found, segmented = select(self.table, self._index, self._selector, df)
            parts = self.table.order_parts(self._index)
            order = ([Sort(SEGMENT)] if segmented else []) + [p.sort for p in parts]
        if self._after is not None and not self._order:
            beyond = compare(parts, self._after, not self._reverse, strict=True)
            found = found if beyond is None else found.filter(beyond)
        if self._filter is not None:
            found = found.filter(self._filter(found) if callable(self._filter) and not isinstance(self._filter, Column) else self._filter)
        if self._order:
            order = [*self._order, *(Sort(c) for c in self.table.primary_key)]
            found = self._after_sorted(found) if self._after is not None else found
        else:
            order = [s.flipped(self._reverse) for s in order]
        if self._offset and not self._limit:
            found = skip(found, order, self._offset)
        else:
            found = found.orderBy(*(s.ordering() for s in order))
            if self._limit:
                found = found.offset(self._offset).limit(self._limit)
        return found.select(*(F.col(f"`{c}`") for c in names)) if found.columns != names else found

    def collect(self, batch: object | None = None) -> list:
        return self.to_df(batch).collect()

    def _after_sorted(self, found: DataFrame) -> DataFrame:
        """Drops all rows up to the one with the cursor's primary key, if that is there: its sort keys, one row, are joined to all."""
        pk = self.table.primary_key
        keys = [*self._order, *(Sort(c) for c in pk)]
        here = found
        for c in pk:
            here = here.filter(F.col(c) == F.lit(self._after[c]))
        cursor = here.select(*(s.column().alias(f"__after{k}") for k, s in enumerate(keys))).limit(1)
        parts = [Part(s, (f"__after{k}",)) for k, s in enumerate(keys)]
        beyond = compare(parts, {}, True, strict=True, value=lambda p: F.col(p.names[0]))
        last = F.col(f"__after{len(keys) - 1}")
        return found.join(F.broadcast(cursor), F.lit(True), "left").filter(last.isNull() | beyond)

    def _intersected(self, df: DataFrame) -> DataFrame:
        for q in self._others:
            for bad, what in ((q._filter is not None, "filter"), (q._order, "order"), (q._after is not None, "after"), (q._offset, "offset"), (q._limit, "limit"), (q._others, "intersects")):
                if bad:
                    raise ValueError(f"a query to intersect with must not have {what}")
            if q.table.name != self.table.name:
                raise ValueError("queries of different tables don't intersect")
        pk = list(self.table.primary_key)
        for q in (self, *self._others):
            if q._index is not None and q._index.multi_key is not None:
                keys, _ = select(self.table, q._index, q._selector, df)
                df = df.join(keys.select(*pk).distinct(), pk, "left_semi")
            else:
                df = df.filter(membership(self.table, q._index, q._selector))
        return df
