"""Writes as joins and aggregates of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ = "__seq"
#: Of a stored and a new row: the columns that change, as expressions. Or, for each column, "sum", "min", "max" or "replace".
RULES = ("sum", "min", "max", "replace")
OnConflict = Callable[[Column, Column], dict[str, Column]] | dict[str, str] | str


def last_wins(rows: DataFrame, pk: list[str]) -> DataFrame:
    """One row per key: the last by SEQ."""
    names = [c for c in rows.columns if c != SEQ]
    return rows.groupBy(*pk).agg(F.max_by(F.struct(*names), SEQ).alias("r")).select("r.*")


def without(base: DataFrame, keys: DataFrame, pk: list[str]) -> DataFrame:
    return base.join(keys.select(*pk), pk, "left_anti").select(*base.columns)


def replaced(base: DataFrame, rows: DataFrame, pk: list[str]) -> DataFrame:
    """base with rows (unique keys) put over it."""
    return without(base, rows, pk).unionByName(rows.select(*base.columns))


def upserted(base: DataFrame, rows: DataFrame, pk: list[str], on_conflict: OnConflict) -> DataFrame:
    """The new state of all keys that rows has.

    Per-column rules are ordinary aggregates and so combine before the shuffle, whatever the repeats of a key. A function
    is folded from the left over a key's rows in their order, which gathers them: it is for keys with a bounded number.
    """
    names = base.columns
    if isinstance(on_conflict, str):
        on_conflict = dict.fromkeys((c for c in names if c not in pk), on_conflict)
    if isinstance(on_conflict, dict):
        if bad := {c: r for c, r in on_conflict.items() if c not in names or c in pk or r not in RULES}:
            raise ValueError(f"no rules: {bad}; they are {RULES}, of columns outside the primary key")
        if set(on_conflict.values()) <= {"replace"}:
            return last_wins(rows, pk)
    old = base.join(rows.select(*pk).distinct(), pk, "left_semi")
    if isinstance(on_conflict, dict):
        both = old.select(*names).withColumn(SEQ, F.lit(-1).cast("long")).unionByName(rows.select(*names, F.col(SEQ).cast("long")))
        how = {"sum": F.sum, "min": F.min, "max": F.max}
        out = []
        for c in names:
            if c not in pk:
                rule = on_conflict.get(c, "replace")
                out.append((how[rule](c).cast(base.schema[c].dataType) if rule in how else F.max_by(c, SEQ)).alias(c))
        return both.groupBy(*pk).agg(*out).select(*names) if out else both.select(*pk).distinct()
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in base.schema.fields) + ">"

    def fold(acc: Column, new: Column) -> Column:
        changed = on_conflict(acc, new)
        if bad := [c for c in changed if c in pk or c not in names]:
            raise ValueError(f"on_conflict can't set {bad}")
        return F.struct(*(((changed[c].cast(base.schema[c].dataType)) if c in changed else (acc[c] if c in pk else new[c])).alias(c) for c in names)).cast(kind)

    given = rows.groupBy(*pk).agg(F.array_sort(F.collect_list(F.struct(F.col(SEQ), F.struct(*names).cast(kind).alias("r")))).alias("news"))
    stored = old.select(*pk, F.struct(*names).cast(kind).alias("old"))
    news = F.transform("news", lambda x: x["r"])
    start = F.coalesce(F.col("old"), news[0])
    rest = F.when(F.col("old").isNull(), F.slice(news, F.lit(2), F.greatest(F.size(news) - 1, F.lit(0)))).otherwise(news)
    return given.join(stored, pk, "left").select(F.aggregate(rest, start, fold).alias("r")).select("r.*")
