"""Chat formatting: cumulative-snapshot collapse, with DataFrame functions only.

A log that stores a conversation after each exchange holds its earlier states too. Every turn gets a hash of all turns
up to it (the XOR of one hash per place, role and text, running over the conversation); a conversation whose last hash
stands at an inner turn of another is a prefix of that one. An anti-join drops those, one of equal conversations stays,
and only then are texts put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _turn_hash(salt: int, role: str, text: str) -> Column:
    parts = [p for c in (role, text) for p in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return F.xxhash64(F.lit(salt), F.col("pos"), *parts)


def maximal_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns (conv, pos from 1, role, text, n_turns, n_copies) of the conversations that no longer one begins with.

    Of equal conversations the one with the smallest id stays and n_copies counts them. Turns are ordered by turn number
    (null first), role and text; a turn logged twice, all four alike, counts once. Rows without a conversation id are
    one conversation. Null and empty texts differ. Other columns are ignored.
    """
    rows = turns.select(conv, turn, role, text).dropDuplicates()
    w = Window.partitionBy(conv).orderBy(turn, role, text)
    rows = rows.withColumn("pos", F.row_number().over(w)).withColumn("inner", F.lead(F.lit(True)).over(w).isNotNull())
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.bit_xor(_turn_hash(k, role, text)).over(running).alias(f"h{k}") for k in (1, 2)))
    at = ["pos", "h1", "h2"]
    ends = rows.where("NOT inner").groupBy(*at).agg(F.min(conv).alias("kept"), F.count("*").alias("n_copies"))
    kept = ends.join(rows.where("inner").select(*at).distinct(), at, "left_anti").select("kept", F.col("pos").alias("n_turns"), "n_copies")
    return rows.join(kept, F.col(conv).eqNullSafe(F.col("kept"))).select(conv, "pos", role, text, "n_turns", "n_copies")


def render(turns: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of maximal_turns(): conv, n_turns, n_copies and chat, its turns between role markers.

    A null role is rendered as `unknown`, a null text as empty. A conversation's chat is one value, so a conversation is
    the unit that must fit a task.
    """
    turn = F.struct("pos", F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("unknown")), F.lit("|>\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n<|end|>\n")).alias("x"))
    both = turns.groupBy(conv, "n_turns", "n_copies").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return both.select(conv, F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.concat_ws("", F.col("t.x")).alias("chat"))
