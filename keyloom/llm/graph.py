"""Connected components of links, as joins and aggregates that follow the links' number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and root (the smallest id of its component) of every id that a link names.

    Each round takes the smallest root among an id's neighbours, then the root's own root, until none changes; both
    halves are partial aggregates and joins, so a hub isn't gathered in one task. Rounds are kept as tables in the shared
    folder: a checkpoint would hand the plan's constraints on, which double from round to round.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to")).where("id IS NOT NULL AND to IS NOT NULL")
    edges = written(both.unionByName(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).where("id != to").distinct(), "edges")
    roots = edges.groupBy("id").agg(F.min("to").alias("near")).select("id", F.least("id", "near").alias("root"))
    roots = written(roots, "roots")
    while True:
        seen = edges.join(roots.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("root").alias("near"))
        hung = roots.join(seen, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        jumped = written(hung.join(up, "root", "left").select("id", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
        changed = not jumped.where("old != root").isEmpty()
        roots = jumped.select("id", "root")
        if not changed:
            return roots
