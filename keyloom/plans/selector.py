"""Selectors and their compilation to predicates.

A selector is an interval, or a list of intervals, of an index's total order. Its records are dicts of columns; a column
that a record leaves out is unbounded on that side, and so are all that follow it in the order. Predicates are plain
comparisons of columns with literals, which reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.frames import local_frame
from .schema import MISSING, IndexDef, Part, TableDef


@dataclass(frozen=True)
class Selector:
    def segments(self) -> list[tuple[dict, dict | None]]:
        """(lower, upper) records; upper None for a point."""
        raise NotImplementedError


@dataclass(frozen=True, init=False)
class Point(Selector):
    """Rows with the record's index key, from the record on in the index's order. On the primary index: all rows from it on."""

    record: dict

    def __init__(self, record: dict | None = None, **columns):
        object.__setattr__(self, "record", {**(record or {}), **columns})

    def segments(self):
        return [(self.record, None)]


@dataclass(frozen=True, init=False)
class Points(Selector):
    """Several points, in this order and as often as listed. On the primary index a point is exactly one key."""

    records: tuple[dict, ...]

    def __init__(self, *records: dict):
        object.__setattr__(self, "records", tuple(records))

    def segments(self):
        return [(r, None) for r in self.records]


@dataclass(frozen=True)
class Range(Selector):
    """From lower to upper in the index's order, both included; it may span several keys."""

    lower: dict
    upper: dict

    def segments(self):
        return [(self.lower, self.upper)]


@dataclass(frozen=True, init=False)
class Ranges(Selector):
    """Several ranges, in this order; rows in the overlap of two come twice."""

    ranges: tuple[tuple[dict, dict], ...]

    def __init__(self, *ranges: tuple[dict, dict]):
        if any(len(r) != 2 for r in ranges):
            raise ValueError("a range has a lower and an upper record")
        object.__setattr__(self, "ranges", tuple(ranges))

    def segments(self):
        return list(self.ranges)


def compare(parts: Sequence[Part], record: dict, after: bool, strict: bool = False, value=None) -> Column | None:
    """Rows at or after (or, not `after`, at or before) the record in the order of parts; None if it bounds nothing.

    The comparison is spelled out part by part, with the first part's own bound in front: that form is pushed down, a
    comparison of structs isn't.
    """
    bounds: list[tuple[Part, Column]] = []
    for p in parts:
        v = p.value(record) if value is None else value(p)
        if v is MISSING:
            break
        bounds.append((p, F.lit(v) if value is None else v))
    if not bounds:
        return None
    out = F.lit(not strict)
    for k, (p, v) in reversed(list(enumerate(bounds))):
        c, up = p.sort.column(), after != p.sort.descending
        beyond = (c > v) if up else (c < v)
        last = k == len(bounds) - 1
        if last:
            out = beyond if strict else ((c >= v) if up else (c <= v))
        else:
            out = beyond | ((c == v) & out)
            if k == 0:
                out = ((c >= v) if up else (c <= v)) & out
    return out


def _all(parts: list[Column | None]) -> Column:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out & p
    return F.lit(True) if out is None else out


def segment_predicates(table: TableDef, index: IndexDef | None, selector: Selector) -> list[Column]:
    """A predicate over the index's entries for each segment."""
    out = []
    for lower, upper in selector.segments():
        if upper is not None:
            parts = table.order_parts(index)
            out.append(_all([compare(parts, lower, True), compare(parts, upper, False)]))
        elif index is None:
            parts = table.key_parts(None)
            if isinstance(selector, Points):
                out.append(_equal(parts, lower))
            else:
                out.append(_all([compare(parts, lower, True)]))
        else:
            out.append(_all([_equal(table.key_parts(index), lower), compare(table.tail_parts(index), lower, True)]))
    return out


def _equal(parts: list[Part], record: dict) -> Column | None:
    if not parts:
        return None
    missing = [p.names[0] for p in parts if p.value(record) is MISSING]
    if missing:
        raise ValueError(f"a point needs a value for {missing}")
    return _all([p.sort.column() == F.lit(p.value(record)) for p in parts])


def _ascending(table: TableDef, index: IndexDef | None, selector: Selector) -> bool:
    """Whether the segments are points of different keys in the index's order, so that one sort puts them right."""
    if not isinstance(selector, Points):
        return False
    parts = table.order_parts(index)
    n = len(parts) - len(table.tail_parts(index)) if index is not None else len(parts)
    keys = [tuple(p.value(r) for p in parts[:n]) for r in selector.records]
    try:
        return n > 0 and all(a < b for a, b in zip(keys, keys[1:], strict=False))
    except TypeError:
        return False


SEGMENT = "__segment"
#: More points than this are joined as a table instead of being spelled out.
SPELLED = 64


def select(table: TableDef, index: IndexDef | None, selector: Selector, df: DataFrame) -> tuple[DataFrame, bool]:
    """The entries of df that the selector covers; whether there is a column of segment numbers to sort by first."""
    entries = index.entries(df) if index is not None else df
    segments = selector.segments()
    if len(segments) > SPELLED and isinstance(selector, Points) and (joined := _join_points(table, index, selector, entries)) is not None:
        return joined, True
    preds = segment_predicates(table, index, selector)
    if not preds:
        return entries.filter(F.lit(False)), False
    either = preds[0]
    for p in preds[1:]:
        either = either | p
    entries = entries.filter(either)
    if len(preds) == 1 or _ascending(table, index, selector):
        return entries, False
    numbers = F.filter(F.array(*(F.when(p, F.lit(k)) for k, p in enumerate(preds))), lambda x: x.isNotNull())
    return entries.withColumn(SEGMENT, F.explode(numbers)), True


def _join_points(table: TableDef, index: IndexDef | None, selector: Points, entries: DataFrame) -> DataFrame | None:
    parts = table.key_parts(index) + (table.tail_parts(index) if index is not None else [])
    n = len(table.key_parts(index))
    shapes = {tuple(p.value(r) is not MISSING for p in parts) for r in selector.records}
    if len(shapes) != 1 or n == 0 or not all(next(iter(shapes))[:n]) or any(p.is_length for p in parts):
        return None
    given = [p for p, there in zip(parts, next(iter(shapes)), strict=True) if there]
    names = list(dict.fromkeys(p.names[0] for p in given))
    kinds = {f.name: f.dataType for f in entries.schema.fields}
    if any(c not in kinds for c in names):
        return None
    rows = [(k, *(r[c] for c in names)) for k, r in enumerate(selector.records)]
    points = local_frame(entries.sparkSession, rows, StructType([StructField(SEGMENT, IntegerType()), *(StructField(f"__p_{c}", kinds[c]) for c in names)]))

    def value(p: Part):
        return F.col(f"__p_{p.names[0]}") if p in given else MISSING

    on = _all([p.sort.column() == value(p) for p in parts[:n]] + [compare(parts[n:], {}, True, value=value)])
    return entries.join(F.broadcast(points) if len(rows) <= 10_000 else points, on).drop(*(f"__p_{c}" for c in names))


def membership(table: TableDef, index: IndexDef | None, selector: Selector) -> Column:
    """Whether a row (not an entry) has an entry that the selector covers."""
    preds = segment_predicates(table, index, selector)
    either = F.lit(False)
    for p in preds:
        either = either | p
    if index is None:
        return either
    if index.multi_key is not None:
        raise NotImplementedError("see semi_join")
    return either if index.where is None else index.condition() & either
