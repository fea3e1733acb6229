"""The store: immutable Parquet snapshots of tables under one root, published by one pointer file.

A table is a list of parts; a part is a folder of Parquet files, partitioned by a hash bucket of the primary key, of
which some buckets are live. An insert adds a part. Updates and deletes rewrite the buckets that hold their keys and
leave the others where they are. A commit writes its parts first and then replaces the pointer, for all tables at once.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.schema import IndexDef, TableDef
from .fs import Files

FORMAT = 1
POINTER, BUCKET = "_CURRENT", "__bucket"


class Closed(RuntimeError):
    """The catalog has been closed."""


class Catalog:
    """Opens, or makes, the store at root. buckets: how many hash buckets new tables have; choose it so that one bucket fits a task."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.files, self.buckets = spark, root.rstrip("/"), Files(spark), buckets
        self.lock = threading.RLock()
        self._tables: dict = {}
        self._closing: list[Callable[[], None]] = []
        self._closed = False
        pointer = f"{self.root}/{POINTER}"
        if self.files.exists(pointer):
            self.state = self.files.read_json(pointer)
            if self.state["format_version"] != FORMAT:
                raise ValueError(f"the store has format version {self.state['format_version']}; this is {FORMAT}")
        else:
            self.state = {"format_version": FORMAT, "version": 0, "uuid": uuid.uuid4().hex, "tables": {}}
            self.files.mkdirs(self.root)
            self.publish(self.state)

    # lifecycle

    @property
    def version(self) -> int:
        """Of the data; each commit adds one."""
        return self.state["version"]

    def on_close(self, f: Callable[[], None]) -> None:
        self._closing.append(f)

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            for f in reversed(self._closing):
                f()

    def __enter__(self) -> Catalog:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def publish(self, state: dict) -> None:
        self.files.replace(f"{self.root}/{POINTER}", json.dumps(state, sort_keys=True).encode())
        self.state = state

    @contextlib.contextmanager
    def writing(self):
        if self._closed:
            raise Closed("the catalog is closed")
        with self.lock:
            yield

    # tables

    def table(self, definition: TableDef):
        """Opens a table, making it if it isn't there. Its indexes belong to the program, not to the store."""
        from ..operators.table import Table

        with self.writing():
            for name, t in self.state["tables"].items():
                if t["table_id"] == definition.table_id and name != definition.name:
                    raise ValueError(f"table id {definition.table_id} is taken by {name}")
            there = self.state["tables"].get(definition.name)
            if there is None:
                new = {"table_id": definition.table_id, "schema": definition.schema.jsonValue(), "primary_key": list(definition.primary_key), "buckets": self.buckets, "parts": [], "projections": {}}
                self.publish({**self.state, "version": self.version + 1, "tables": {**self.state["tables"], definition.name: new}})
            elif there["table_id"] != definition.table_id or there["primary_key"] != list(definition.primary_key) or StructType.fromJson(there["schema"]) != definition.schema:
                raise ValueError(f"table {definition.name} exists with another id, key or schema")
            self._tables[definition.name] = out = Table(definition, self)
            return out

    def tables(self) -> list[str]:
        return sorted(self.state["tables"])

    def opened(self, name: str):
        if name not in self._tables:
            raise KeyError("table not found")
        return self._tables[name]

    def load(self, name: str, state: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, of the given buckets only if any are given."""
        t = (state or self.state)["tables"][name]
        schema = StructType.fromJson(t["schema"])
        paths = [f"{self.root}/{p['path']}/{BUCKET}={b}" for p in t["parts"] for b in p["live"] if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def bucket(self, definition: TableDef) -> Column:
        n = self.state["tables"][definition.name]["buckets"]
        return F.pmod(F.xxhash64(*definition.primary_key), F.lit(n)).cast("int")

    def write_part(self, definition: TableDef, rows: DataFrame) -> dict:
        """Writes rows as a part, one file or a few per bucket; its live buckets are those that have rows."""
        path = f"{definition.name}/part-{uuid.uuid4().hex}"
        rows = rows.select(*definition.schema.names).withColumn(BUCKET, self.bucket(definition))
        rows.repartition(BUCKET).sortWithinPartitions(BUCKET, *definition.primary_key).write.partitionBy(BUCKET).parquet(f"{self.root}/{path}")
        live = [int(n.partition("=")[2]) for n in self.files.names(f"{self.root}/{path}") if n.startswith(f"{BUCKET}=")]
        return {"path": path, "live": sorted(live)}

    def compact(self, name: str | None = None) -> None:
        """Rewrites tables into one part each, sorted by primary key within buckets."""
        with self.writing():
            for n in [name] if name else list(self._tables):
                definition = self._tables[n].definition
                part = self.write_part(definition, self.load(n))
                t = {**self.state["tables"][n], "parts": [part] if part["live"] else []}
                self.publish({**self.state, "version": self.version + 1, "tables": {**self.state["tables"], n: t}})

    def vacuum(self) -> list[str]:
        """Deletes parts that the current state doesn't name. Readers of older states lose them."""
        gone = []
        with self.writing():
            used = {p["path"] for t in self.state["tables"].values() for p in [*t["parts"], *t["projections"].values()]}
            for n in self.state["tables"]:
                for p in self.files.names(f"{self.root}/{n}"):
                    if f"{n}/{p}" not in used and self.files.delete(f"{self.root}/{n}/{p}"):
                        gone.append(f"{n}/{p}")
        return gone

    # materialised index projections

    def write_projection(self, definition: TableDef, index: IndexDef, rows: DataFrame) -> dict:
        path = f"{definition.name}/index-{index.index_id}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        return {"path": path, "version": self.version}

    # dump and restore

    def dump(self, folder: str, tables: list[str] | None = None, with_index: bool = True) -> None:
        """A consistent copy of tables (all by default), and of their index projections, as plain Parquet."""
        state = self.state
        names = tables or sorted(state["tables"])
        for n in names:
            self.load(n, state).write.parquet(f"{folder}/{n}/rows")
            for i in self._tables[n].definition.indexes if with_index and n in self._tables else ():
                self._tables[n].projection_rows(i, self.load(n, state)).write.parquet(f"{folder}/{n}/index-{i.index_id}")
        self.files.write(f"{folder}/_DUMP", json.dumps({"format_version": FORMAT, "tables": {n: {k: v for k, v in state["tables"][n].items() if k not in ("parts", "projections")} for n in names}}).encode())

    def restore(self, folder: str, tables: list[str] | None = None, with_index: bool = True) -> None:
        """Replaces tables by a dump's, matched by their whole names."""
        meta = self.files.read_json(f"{folder}/_DUMP")
        if meta["format_version"] != FORMAT:
            raise ValueError(f"the dump has format version {meta['format_version']}; this is {FORMAT}")
        names = tables or sorted(meta["tables"])
        if missing := [n for n in names if n not in meta["tables"]]:
            raise ValueError(f"the dump lacks {missing}")
        with self.writing():
            new = dict(self.state["tables"])
            for n in names:
                m = meta["tables"][n]
                definition = TableDef(n, m["table_id"], StructType.fromJson(m["schema"]), m["primary_key"])
                new[n] = {**m, "parts": [], "projections": {}}
                self.state = {**self.state, "tables": {**self.state["tables"], n: new[n]}}
                part = self.write_part(definition, self.spark.read.schema(definition.schema).parquet(f"{folder}/{n}/rows"))
                new[n]["parts"] = [part] if part["live"] else []
            self.publish({**self.state, "version": self.version + 1, "tables": new})
        for n in names:
            if with_index and n in self._tables and self._tables[n].definition.indexes:
                self._tables[n].reindex()
