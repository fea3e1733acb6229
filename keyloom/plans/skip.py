"""The rest of an ordered DataFrame after its first n rows, as a plan in which no task takes all rows.

An offset without a limit would gather everything in one task to count. Here a sort of the keys alone counts them by
blocks; of the block that the n-th row falls into, the keys are numbered; the rows before that row's key are filtered away
before whole rows are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schema import Sort

#: As a power of 2: the keys counted together, which is also how many one task numbers, besides rows of equal keys.
BLOCK_BITS = 16


def precedes(order: Sequence[Sort], a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether key a comes before key b, as sorts place them: nulls are least. Never null."""
    out = F.lit(False)
    for s, x, y in reversed(list(zip(order, a, b, strict=True))):
        low, high = (y, x) if s.descending else (x, y)
        out = F.coalesce(low < high, low.isNull() & high.isNotNull()) | (x.eqNullSafe(y) & out)
    return out


def skip(found: DataFrame, order: Sequence[Sort], n: int) -> DataFrame:
    """found in this order, without the first n rows. Of rows with equal keys, which the order leaves open, any may go; never more than n rows."""
    names = [f"__key{k}" for k in range(len(order))]
    own = [s.column() for s in order]
    keys = found.select(*(c.alias(k) for c, k in zip(own, names, strict=True)))
    here, by = [F.col(k) for k in names], [Sort(k, s.descending).ordering() for k, s in zip(names, order, strict=True)]

    def of(key: str) -> list[Column]:
        return [F.col(f"{key}.{k}") for k in names]

    # the upper bits of a row's number are its partition, so blocks are in the order of the keys
    at, every = F.col("__at"), Window.partitionBy(F.lit(0)).orderBy("__block")
    blocks = keys.orderBy(*by).withColumn("__at", F.monotonically_increasing_id())
    blocks = blocks.groupBy(F.shiftright(at, BLOCK_BITS).alias("__block")).agg(
        F.count("*").alias("__n"), F.collect_list(F.when(at.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == 0, F.struct(*here)))[0].alias("__first")
    )
    blocks = blocks.select("__first", F.lead("__first").over(every).alias("__next"), "__n", F.sum("__n").over(every).alias("__end"))
    block = blocks.filter((F.col("__end") > n) & (F.col("__end") - F.col("__n") <= n)).select("__first", "__next")
    # rows before the block are counted anew: those with the block's first key may stand in two blocks
    upto = keys.join(F.broadcast(block), F.col("__next").isNull() | ~precedes(order, of("__next"), here))
    earlier = precedes(order, here, of("__first"))
    page = upto.agg(F.count_if(earlier).alias("__before"), F.collect_list(F.when(~earlier, F.struct(*here))).alias("__page"))
    page = page.select("__before", F.explode("__page").alias("__cut"))
    within = Window.partitionBy(F.lit(0)).orderBy(*(Sort(f"__cut.{k}", s.descending).ordering() for k, s in zip(names, order, strict=True)))
    page = page.select("__cut", (F.col("__before") + F.row_number().over(within)).alias("__row"), (F.row_number().over(within) - F.rank().over(within)).alias("__ties"))
    cut = page.filter(F.col("__row") == n + 1).select("__cut", "__ties")
    rest = found.join(F.broadcast(cut), ~precedes(order, own, of("__cut"))).orderBy(*(s.ordering() for s in order))
    # rows with the cut's key come first and in one partition, the first: a sort doesn't part equal keys
    return rest.filter(F.monotonically_increasing_id() >= F.col("__ties")).drop("__cut", "__ties")
