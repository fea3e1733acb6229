"""A table: reads through its indexes, and writes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.query import Query
from ..plans.schema import IndexDef, TableDef
from ..plans.selector import Point, Points, Range, Ranges, Selector
from ..sources.catalog import Catalog
from ..sources.frames import local_frame
from . import merge
from .batch import Batch, Step

Rows = DataFrame | Iterable[dict | tuple | Row]


class NotFound(LookupError):
    """No such record."""


class AlreadyExists(ValueError):
    """A record with this key is there."""


class Table:
    """definition over a catalog's snapshot, or over any DataFrame, which is then read-only."""

    def __init__(self, definition: TableDef, source: Catalog | DataFrame):
        self.definition = definition
        self.catalog = source if isinstance(source, Catalog) else None
        self._source = source
        self._pk = list(definition.primary_key)

    @property
    def name(self) -> str:
        return self.definition.name

    @property
    def table_id(self) -> int:
        return self.definition.table_id

    # reads

    def df(self, batch: Batch | None = None, keys: list[dict] | None = None) -> DataFrame:
        """The rows as last committed, and as a readable batch leaves them. With keys, maybe only the buckets that can hold those."""
        if self.catalog is None:
            base = self._source
        else:
            base = self.catalog.load(self.name, buckets=None if keys is None else self._buckets(self._key_frame(keys)))
        if batch is None:
            return base
        if not batch.readable:
            raise ValueError("the batch is write-only; reads need a readable one")
        return batch.overlay(self.name, base, self._pk)

    def _key_frame(self, records: Iterable[dict | Row]) -> DataFrame:
        return local_frame(self.catalog.spark, [tuple(r[c] for c in self._pk) for r in records], StructType([self.definition.schema[c] for c in self._pk]))

    def _buckets(self, keys: DataFrame) -> list[int]:
        """The hash buckets of these keys: at most as many numbers as the table has buckets."""
        return sorted(r.b for r in keys.select(self.catalog.bucket(self.definition).alias("b")).distinct().collect())

    def query(self) -> Query:
        return Query(self.definition, self.df)

    def get(self, selector: Selector, batch: Batch | None = None) -> DataFrame:
        """By primary key. A point must exist, else NotFound; points give a row per point, in their order, null where none is; ranges as in scans."""
        if isinstance(selector, Point):
            found = self._exactly(self.df(batch, [selector.record]), selector.record)
            if found.isEmpty():
                raise NotFound("record not found")
            return found
        if isinstance(selector, Points):
            return self._positional(self.df(batch, list(selector.records)), selector)
        return self.query().with_(None, selector).to_df(batch)

    def get_point(self, record: dict, batch: Batch | None = None) -> Row:
        row = self._exactly(self.df(batch, [record]), record).head()
        if row is None:
            raise NotFound("record not found")
        return row

    def exist(self, record: dict, batch: Batch | None = None) -> bool:
        return not self._exactly(self.df(batch, [record]), record).isEmpty()

    def exist_flags(self, keys: DataFrame, batch: Batch | None = None) -> DataFrame:
        """keys with a column exists: one join instead of many probes."""
        there = self.df(batch).select(*self._pk).withColumn("__there", F.lit(True))
        return keys.join(there, self._pk, "left").select(*keys.columns, F.coalesce("__there", F.lit(False)).alias("exists"))

    def _exactly(self, df: DataFrame, record: dict) -> DataFrame:
        for c in self._pk:
            df = df.filter(F.col(c) == F.lit(record[c]))
        return df

    def _positional(self, df: DataFrame, points: Points) -> DataFrame:
        kinds = StructType([StructField("__at", LongType()), *(StructField(f"__{c}", self.definition.schema[c].dataType) for c in self._pk)])
        asked = local_frame(df.sparkSession, [(k, *(r[c] for c in self._pk)) for k, r in enumerate(points.records)], kinds)
        on = [F.col(c) == F.col(f"__{c}") for c in self._pk]
        return (F.broadcast(asked) if len(points.records) <= 10_000 else asked).join(df, on, "left").orderBy("__at").select(*df.columns)

    def scan(self, reverse: bool = False, batch: Batch | None = None) -> DataFrame:
        q = self.query()
        return (q.reverse() if reverse else q).to_df(batch)

    def scan_index(self, index: str | IndexDef | None, selector: Selector, reverse: bool = False, batch: Batch | None = None) -> DataFrame:
        q = self.query().with_(index, selector)
        return (q.reverse() if reverse else q).to_df(batch)

    def scan_for_each(self, f: Callable[[Row], bool], reverse: bool = False, batch: Batch | None = None) -> None:
        """Calls f with row after row until it returns False; rows come a partition at a time."""
        self._each(self.scan(reverse, batch), f)

    def scan_index_for_each(self, index: str | IndexDef | None, selector: Selector, f: Callable[[Row], bool], reverse: bool = False, batch: Batch | None = None) -> None:
        self._each(self.scan_index(index, selector, reverse, batch), f)

    @staticmethod
    def _each(df: DataFrame, f: Callable[[Row], bool]) -> None:
        for row in df.toLocalIterator(prefetchPartitions=False):
            if f(row) is False:
                break

    def iterate(self, index: str | IndexDef | None, selector: Selector, batch: Batch | None = None) -> Iterator[Row]:
        return self.scan_index(index, selector, batch=batch).toLocalIterator()

    def covering(self, index: str | IndexDef, selector: Selector | None = None) -> DataFrame:
        """Only what the index itself holds: its key, order and primary key columns. Nothing else is read."""
        i = self.definition.index(index) if isinstance(index, str) else index
        q = self.query().with_(i, selector) if selector is not None else None
        rows = q.to_df() if q is not None else self.df()
        return self.projection_rows(i, rows)

    # writes

    def _staged(self, rows: Rows) -> DataFrame:
        """The table's columns and SEQ, the order of the input."""
        spark, names = self.catalog.spark, self.definition.schema.names
        if isinstance(rows, DataFrame):
            cols = [F.col(c).cast(self.definition.schema[c].dataType).alias(c) for c in names]
            seq = F.col(merge.SEQ) if merge.SEQ in rows.columns else F.monotonically_increasing_id()
            return rows.select(*cols, seq.alias(merge.SEQ))
        listed = []
        for k, r in enumerate(rows):
            r = r.asDict() if isinstance(r, Row) else r
            listed.append((*((r.get(c) for c in names) if isinstance(r, dict) else r), k))
        return local_frame(spark, listed, StructType([*self.definition.schema.fields, StructField(merge.SEQ, LongType())]))

    def _run(self, batch: Batch | None, step: Callable[[Batch], Step]) -> None:
        if self.catalog is None:
            raise ValueError("the table is read-only")
        own = batch is None
        batch = Batch(self.catalog) if own else batch
        with self.catalog.writing():
            batch.steps.append(step(batch))
            if own:
                batch.commit()

    def _now(self, batch: Batch, keys: DataFrame) -> DataFrame:
        """The buckets of these keys, as the batch leaves them."""
        return batch.overlay(self.name, self.catalog.load(self.name, buckets=self._buckets(keys)), self._pk)

    def insert(self, rows: Rows, batch: Batch | None = None) -> None:
        """New rows; AlreadyExists if a key is in the table or comes twice, and then nothing is written."""

        def step(b: Batch) -> Step:
            new = self._staged(rows).drop(merge.SEQ)
            twice = new.groupBy(*self._pk).count().filter("count > 1").select(*self._pk)
            there = new.join(self._now(b, new).select(*self._pk), self._pk, "left_semi").select(*self._pk)
            if (bad := twice.unionByName(there).head()) is not None:
                raise AlreadyExists(f"record {bad.asDict()} already exist")
            return Step(self.name, new.select(*self._pk), new, True)

        self._run(batch, step)

    def update(self, rows: Rows, batch: Batch | None = None) -> None:
        """Rows that are there; NotFound if a key isn't. Of rows with one key the last counts."""

        def step(b: Batch) -> Step:
            new = merge.last_wins(self._staged(rows), self._pk)
            if (bad := merge.without(new.select(*self._pk), self._now(b, new), self._pk).head()) is not None:
                raise NotFound(f"record {bad.asDict()} not found")
            return Step(self.name, new.select(*self._pk), new, False)

        self._run(batch, step)

    def upsert(self, rows: Rows, on_conflict: merge.OnConflict = "replace", batch: Batch | None = None) -> None:
        """Inserts, or merges with what is stored; rows with one key are merged one after the other."""

        def step(b: Batch) -> Step:
            given = self._staged(rows)
            new = merge.upserted(self._now(b, given), given, self._pk, on_conflict)
            return Step(self.name, new.select(*self._pk), new, False)

        self._run(batch, step)

    def delete(self, rows: Rows, batch: Batch | None = None) -> None:
        """By primary key; keys that aren't there don't matter."""

        def step(b: Batch) -> Step:
            if isinstance(rows, DataFrame):
                keys = rows.select(*self._pk)
            else:
                keys = self._key_frame(rows)
            return Step(self.name, keys.distinct(), None, False)

        self._run(batch, step)

    def unsafe_insert(self, rows: Rows, batch: Batch | None = None) -> None:
        """Puts rows over whatever is there, unchecked; the last of a key counts."""

        def step(b: Batch) -> Step:
            new = merge.last_wins(self._staged(rows), self._pk)
            return Step(self.name, new.select(*self._pk), new, False)

        self._run(batch, step)

    def unsafe_update(self, rows: Rows, old: Rows, batch: Batch | None = None) -> None:
        """As unsafe_insert(); old must have as many rows. Indexes here are derived, so the old rows aren't used."""
        rows, old = (x if isinstance(x, DataFrame) else list(x) for x in (rows, old))
        n, m = (x.count() if isinstance(x, DataFrame) else len(x) for x in (rows, old))
        if n != m:
            raise ValueError("params need to be of equal size")
        self.unsafe_insert(rows, batch)

    # indexes

    def add_index(self, *indexes: IndexDef) -> None:
        """An index is declared, not stored, so all rows are in it at once."""
        self.definition = self.definition.with_indexes(*indexes)

    def projection_rows(self, index: IndexDef, rows: DataFrame | None = None) -> DataFrame:
        """The index's key, order and primary key columns of its rows."""
        entries = index.entries(self.df() if rows is None else rows)
        order = [s.column().alias(s.expr if isinstance(s.expr, str) else f"order{k}") for k, s in enumerate(index.order)]
        cols = {c: F.col(c) for c in index.key}
        cols |= {(s.expr if isinstance(s.expr, str) else f"order{k}"): order[k] for k, s in enumerate(index.order)}
        cols |= {c: F.col(c) for c in self._pk}
        return entries.select(*cols.values())

    def reindex(self, *names: str) -> None:
        """Writes (again) the sorted projections of indexes, for readers that want only their columns, range by range."""
        with self.catalog.writing():
            for i in [self.definition.index(n) for n in names] or self.definition.indexes:
                parts = self.definition.order_parts(i)
                rows = self.projection_rows(i)
                rows = rows.orderBy(*(p.sort.ordering() for p in parts))
                new = self.catalog.write_projection(self.definition, i, rows)
                t = self.catalog.state["tables"][self.name]
                t = {**t, "projections": {**t["projections"], str(i.index_id): new}}
                self.catalog.publish({**self.catalog.state, "version": self.catalog.version + 1, "tables": {**self.catalog.state["tables"], self.name: t}})

    def projection(self, index: str) -> DataFrame:
        """What reindex() wrote last. Later writes are not in it."""
        i = self.definition.index(index)
        p = self.catalog.state["tables"][self.name]["projections"].get(str(i.index_id))
        if p is None:
            raise NotFound(f"index {index} has no projection; call reindex()")
        return self.catalog.spark.read.parquet(f"{self.catalog.root}/{p['path']}")


__all__ = ["AlreadyExists", "NotFound", "Point", "Points", "Range", "Ranges", "Table"]
