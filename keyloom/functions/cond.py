"""Row predicates with two-valued logic: a comparison with null, or with NaN, is false, and its negation true."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ordered(x: str | Column, v: object, op: str) -> Column:
    c = _col(x)
    out = getattr(c, op)(F.lit(v))
    return out & ~F.isnan(c.cast("double")) if isinstance(v, float) else out


def eq(x: str | Column, v: object) -> Column:
    """Equal; null equals null, NaN equals nothing."""
    c = _col(x)
    return (c.eqNullSafe(F.lit(v)) & ~F.isnan(F.coalesce(c.cast("double"), F.lit(0.0)))) if isinstance(v, float) else c.eqNullSafe(F.lit(v))


def gt(x: str | Column, v: object) -> Column:
    return _ordered(x, v, "__gt__")


def gte(x: str | Column, v: object) -> Column:
    return _ordered(x, v, "__ge__")


def lt(x: str | Column, v: object) -> Column:
    return _ordered(x, v, "__lt__")


def lte(x: str | Column, v: object) -> Column:
    return _ordered(x, v, "__le__")


def and_(*conds: Column) -> Column:
    """All of them; true of none."""
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def or_(*conds: Column) -> Column:
    """Any of them; false of none."""
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def not_(cond: Column) -> Column:
    return ~F.coalesce(cond, F.lit(False))


def func(f: Callable[[dict], bool], *columns: str) -> Column:
    """A Python predicate over the named columns, a row at a time. It blocks pushdown: prefer expressions."""
    names = list(columns)
    return F.udf(lambda *v: bool(f(dict(zip(names, v, strict=True)))), BooleanType())(*(F.col(c) for c in names))
