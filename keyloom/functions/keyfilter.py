"""A bucketed Bloom filter of keys, as a table of 64-bit words.

Keys are dealt to buckets by hash; each bucket is a Bloom filter sized for `expected` keys at rate `fpp`. Building,
adding and asking are aggregates and joins in Spark; the filter is as many rows as it has words that aren't zero.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fs import Files


@dataclass(frozen=True)
class FilterStats:
    asked: int = 0
    absent: int = 0
    maybe: int = 0


class KeyFilter:
    """Answers `absent` only for keys that were never added. Keys are never removed: rebuild it from the table instead."""

    def __init__(self, words: DataFrame, keys: list[str], expected: int, fpp: float, buckets: int):
        self.words, self.keys, self.expected, self.fpp, self.buckets = words, list(keys), expected, fpp, buckets
        self.bits = max(64, math.ceil(-expected * math.log(fpp) / math.log(2) ** 2 / 64) * 64)
        self.hashes = max(1, round(self.bits / expected * math.log(2)))
        self.stats = FilterStats()
        self.pending: set[int] = set()

    @staticmethod
    def build(df: DataFrame, keys: list[str], expected: int, fpp: float = 0.01, buckets: int = 16) -> KeyFilter:
        """Of all rows of df. expected: keys in one bucket."""
        if expected < 1 or buckets < 1 or not 0 < fpp < 1:
            raise ValueError("expected and buckets are at least 1, fpp is between 0 and 1")
        f = KeyFilter(df.sparkSession.createDataFrame([], "bucket int, word int, bits bigint"), keys, expected, fpp, buckets)
        f.words = f._words(df)
        return f

    def _place(self) -> tuple[Column, Column]:
        """Of a key: bucket, and the array of its bits."""
        bucket = F.pmod(F.crc32(F.concat_ws("\u0001", *(F.col(k).cast("string") for k in self.keys))), F.lit(self.buckets)).cast("int")
        a, b = F.xxhash64(*self.keys), F.xxhash64(F.lit(1), *self.keys)
        at = F.array(*(F.pmod(F.pmod(a, F.lit(self.bits)) + F.lit(k) * F.pmod(b, F.lit(self.bits)), F.lit(self.bits)).cast("int") for k in range(self.hashes)))
        return bucket, at

    def _words(self, df: DataFrame) -> DataFrame:
        bucket, at = self._place()
        bits = df.select(bucket.alias("bucket"), F.explode(at).alias("at"))
        return bits.groupBy("bucket", F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, at & 63))").alias("bits"))

    def add(self, df: DataFrame) -> None:
        new = self._words(df)
        self.pending |= {r.bucket for r in new.select("bucket").distinct().collect()}
        self.words = self.words.unionByName(new).groupBy("bucket", "word").agg(F.expr("bit_or(bits)").alias("bits"))

    def may_contain(self, df: DataFrame) -> DataFrame:
        """df with a column may_contain; False means certainly not added. df's keys should be unique."""
        bucket, at = self._place()
        asked = df.withColumn("__bucket", bucket).withColumn("__at", at)
        probes = asked.select(*self.keys, "__bucket", F.explode("__at").alias("at")).withColumn("word", F.shiftright("at", 6))
        hit = probes.join(self.words, (F.col("__bucket") == F.col("bucket")) & (probes.word == self.words.word), "left")
        is_set = F.coalesce(F.expr("getbit(bits, at & 63) = 1"), F.lit(False))
        answers = hit.groupBy(*self.keys).agg(F.min(is_set).alias("may_contain"))
        return df.join(answers, self.keys, "left")

    def probe(self, df: DataFrame) -> DataFrame:
        """As may_contain(), counted in stats."""
        out = self.may_contain(df)
        n = {r.may_contain: r["count"] for r in out.groupBy("may_contain").count().collect()}
        self.stats = FilterStats(self.stats.asked + sum(n.values()), self.stats.absent + n.get(False, 0), self.stats.maybe + n.get(True, 0))
        return out

    def pending_buckets(self) -> int:
        """How many buckets have changed since save()."""
        return len(self.pending)

    def save(self, folder: str) -> None:
        """Writes all buckets the first time, then only those that changed; a bucket's latest generation counts."""
        files = Files(self.words.sparkSession)
        meta = files.read_json(f"{folder}/_FILTER") if files.exists(f"{folder}/_FILTER") else None
        generation = meta["generations"] + 1 if meta else 1
        rows = self.words.where(F.col("bucket").isin(sorted(self.pending))) if meta else self.words
        rows.write.parquet(f"{folder}/generation={generation}")
        files.replace(f"{folder}/_FILTER", json.dumps({"keys": self.keys, "expected": self.expected, "fpp": self.fpp, "buckets": self.buckets, "generations": generation}).encode())
        self.pending.clear()

    @staticmethod
    def load(spark: SparkSession, folder: str, buckets: int | None = None) -> KeyFilter:
        meta = Files(spark).read_json(f"{folder}/_FILTER")
        if buckets is not None and buckets != meta["buckets"]:
            raise ValueError(f"the stored filter has {meta['buckets']} buckets, not {buckets}")
        rows = spark.read.option("basePath", folder).parquet(*(f"{folder}/generation={g}" for g in range(1, meta["generations"] + 1)))
        latest = rows.groupBy("bucket").agg(F.max("generation").alias("latest"))
        words = rows.join(latest, "bucket").where("generation = latest").select("bucket", "word", "bits")
        return KeyFilter(words, meta["keys"], meta["expected"], meta["fpp"], meta["buckets"])

    @staticmethod
    def clear(spark: SparkSession, folder: str) -> None:
        Files(spark).delete(folder)
