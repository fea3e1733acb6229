"""Atomic sets of writes."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.catalog import BUCKET, Catalog

_ids = itertools.count(1)


@dataclass
class Step:
    """A staged write: the keys that it touches and the state of its table after it."""

    table: str
    keys: DataFrame
    rows: DataFrame | None  # the new rows of these keys; None for a delete
    adds_only: bool


class Batch:
    """Stages writes of any tables; commit() publishes all of them or none. Reads that are given a readable batch see its writes."""

    def __init__(self, catalog: Catalog, readable: bool = True):
        self.catalog, self.readable, self.id = catalog, readable, next(_ids)
        self.steps: list[Step] = []
        self._hooks: dict[str, list[Callable]] = {k: [] for k in ("commit", "committed", "error", "close")}
        self._closed = False

    def __len__(self) -> int:
        return len(self.steps)

    @property
    def empty(self) -> bool:
        return not self.steps

    def count(self) -> int:
        return len(self.steps)

    def on_commit(self, f: Callable[[Batch], None]) -> None:
        """Runs before the commit; an exception aborts it."""
        self._hooks["commit"].append(f)

    def on_committed(self, f: Callable[[Batch], None]) -> None:
        self._hooks["committed"].append(f)

    def on_error(self, f: Callable[[Batch, Exception], None]) -> None:
        self._hooks["error"].append(f)

    def on_close(self, f: Callable[[Batch], None]) -> None:
        self._hooks["close"].append(f)

    def reset(self) -> None:
        """Forgets writes and callbacks."""
        self.steps.clear()
        for h in self._hooks.values():
            h.clear()

    def apply(self, other: Batch) -> None:
        """Takes over another batch's writes; its commit callbacks run, and its committed ones after this batch's commit."""
        for f in other._hooks["commit"]:
            f(other)
        self.steps += other.steps
        for f in other._hooks["committed"]:
            self.on_committed(lambda _, f=f: f(other))

    def overlay(self, table: str, base: DataFrame, pk: list[str]) -> DataFrame:
        """base as the batch's writes leave it."""
        out = base
        for s in self.steps:
            if s.table == table:
                if not s.adds_only:
                    out = out.join(s.keys, pk, "left_anti").select(*base.columns)
                if s.rows is not None:
                    out = out.unionByName(s.rows.select(*base.columns))
        return out

    def commit(self) -> None:
        """Nothing staged, nothing done."""
        if self.empty:
            return
        try:
            for f in list(self._hooks["commit"]):
                f(self)
            self._write()
        except Exception as e:
            for f in list(self._hooks["error"]):
                f(self, e)
            raise
        self.steps.clear()
        for f in list(self._hooks["committed"]):
            f(self)

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            for f in list(self._hooks["close"]):
                f(self)

    def _write(self) -> None:
        cat = self.catalog
        with cat.writing():
            tables = dict(cat.state["tables"])
            for name in dict.fromkeys(s.table for s in self.steps):
                definition = cat.opened(name).definition
                pk, mine = list(definition.primary_key), [s for s in self.steps if s.table == name]
                parts = list(tables[name]["parts"])
                if all(s.adds_only for s in mine):
                    rows = mine[0].rows
                    for s in mine[1:]:
                        rows = rows.unionByName(s.rows)
                else:
                    bucket = cat.bucket(definition)
                    touched: set[int] = set()  # at most as many numbers as the table has buckets
                    for s in mine:
                        touched |= {r.b for r in s.keys.select(bucket.alias("b")).distinct().collect()}
                    rows = self.overlay(name, cat.load(name, buckets=sorted(touched)), pk)
                    parts = [{**p, "live": [b for b in p["live"] if b not in touched]} for p in parts]
                part = cat.write_part(definition, rows)
                tables[name] = {**tables[name], "parts": [p for p in [*parts, part] if p["live"]]}
            cat.publish({**cat.state, "version": cat.version + 1, "tables": tables})


class SyncBatch:
    """Lets threads take turns with a batch."""

    def __init__(self, batch: Batch):
        self._batch, self._lock = batch, threading.Lock()

    def with_sync(self, f: Callable[[Batch], object]) -> object:
        with self._lock:
            return f(self._batch)


__all__ = ["BUCKET", "Batch", "Step", "SyncBatch"]
