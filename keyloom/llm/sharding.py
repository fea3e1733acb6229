"""Sharding by fixed virtual slots, with DataFrame functions only.

Records hash into SLOTS slots, never more or fewer; a versioned map says which shard owns each slot. Bytes are summed
per slot, and rebalancing edits the map: it moves or swaps slots between the fullest and the emptiest shard until no
edit brings them closer, and leaves the others where they are. The map has SLOTS entries whatever the data, so it goes
into the plan as a literal.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    owner: tuple[int, ...]  # of each slot

    @staticmethod
    def first(shards: int) -> SlotMap:
        return SlotMap(1, shards, tuple(s % shards for s in range(SLOTS)))

    def rebalanced(self, load: list[int], shards: int | None = None) -> SlotMap:
        """The next version for these loads of the slots; more shards begin empty and are filled by the same edits."""
        shards = self.shards if shards is None else shards
        if shards < self.shards:
            raise ValueError("shards can be added only")
        owned: list[list[int]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(self.owner):
            owned[shard].append(slot)
        total = [sum(load[s] for s in own) for own in owned]
        for _ in range(64 * SLOTS):
            full, low = max(range(shards), key=lambda k: (total[k], -k)), min(range(shards), key=lambda k: (total[k], k))
            gap = total[full] - total[low]
            if gap <= 1:
                break
            # the move, or the swap against a smaller slot, whose difference is nearest to half the gap
            a = sorted((load[s], s) for s in owned[full])
            b = [(0, -1), *sorted((load[s], s) for s in owned[low])]
            best, j = None, 0
            for x, s in a:
                while j + 1 < len(b) and 2 * (x - b[j][0]) > gap and x - b[j + 1][0] > 0:
                    j += 1
                for y, t in b[max(0, j - 1) : j + 1]:
                    d = x - y
                    if 0 < d < gap and (best is None or abs(2 * d - gap) < best[0]):
                        best = (abs(2 * d - gap), s, t, d)
            if best is None:
                break
            _, s, t, d = best
            owned[full].remove(s)
            owned[low].append(s)
            if t >= 0:
                owned[low].remove(t)
                owned[full].append(t)
            total[full] -= d
            total[low] += d
        owner = [0] * SLOTS
        for shard, own in enumerate(owned):
            for s in own:
                owner[s] = shard
        return SlotMap(self.version + 1, shards, tuple(owner))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Adds this version to the map's table; an existing version is an error."""
        spark.range(1).select(F.lit(self.shards).alias("shards"), F.posexplode(lookup_array(self.owner, "array<int>")).alias("slot", "shard")).coalesce(1).write.parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """That version, or the latest."""
        table = spark.read.parquet(folder)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("slot").collect()
        return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def lookup_array(values, kind: str) -> Column:
    """A literal array, short in the plan."""
    return F.from_json(F.lit(json.dumps(list(values))), kind)


def slot_loads(rows: DataFrame, slot: Column, size: str) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot (SLOTS numbers each)."""
    load, count = [0] * SLOTS, [0] * SLOTS
    for r in rows.groupBy(slot.alias("s")).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect():
        load[r.s], count[r.s] = r.b, r.n
    return load, count


def shard(docs: DataFrame, shards: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Places every row by the law `bytes`: the shards' sizes are near equal.

    Returns key, size (UTF-8 bytes of the text, 0 if null, plus 1), text_crc32 (of the text; of '' if null), law, shard,
    slot (the row's place in its shard, gapless from 0), grown_shard (null: this law moves rows between old shards),
    virtual_slot and map_version. Both map versions, before and after rebalancing, are saved under `folder`.

    Equal texts share a virtual slot, hence a shard. The one exception are rows of a text that together have more bytes
    than a shard's even part, so that no shard could hold them: they, and no other rows of their slot, are dealt to the
    virtual slots by their keys. Rows that agree in key and text always share a virtual slot. Null keys are hashed as
    such; a null and an empty text are one. A text may be of any length. An empty table gives none.
    """
    spark = docs.sparkSession
    x = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(x) + 1).cast("long").alias("size"), F.crc32(x).alias("text_crc32"), F.xxhash64(x).alias("h"))
    by_text = F.pmod(F.col("h"), F.lit(SLOTS)).cast("int")
    load, count = slot_loads(rows, by_text, "size")
    full = [s for s in range(SLOTS) if load[s] * shards > sum(load)]  # fewer than shards
    virtual = by_text
    if full:
        by_h = rows.where(by_text.isin(full)).groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        hot = [r.h for r in by_h.where((F.col("b") * shards > sum(load)) & (F.col("n") > 1)).collect()]
        virtual = F.when(F.col("h").isin(hot), F.pmod(F.xxhash64(F.lit(1), F.col(key), F.col("h")), F.lit(SLOTS)).cast("int")).otherwise(by_text)
        load, count = slot_loads(rows, virtual, "size")
    before = SlotMap.first(shards)
    before.save(spark, folder)
    before.rebalanced(load).save(spark, folder)
    now = SlotMap.load(spark, folder)
    begin, filled = [0] * SLOTS, [0] * shards
    for s in range(SLOTS):
        begin[s] = filled[now.owner[s]]
        filled[now.owner[s]] += count[s]
    placed = rows.withColumn("virtual_slot", virtual)
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "h")) - 1
    return placed.select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), F.get(lookup_array(now.owner, "array<int>"), "virtual_slot").alias("shard"),
        (F.get(lookup_array(begin, "array<bigint>"), "virtual_slot") + place).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(now.version).alias("map_version"),
    )
