"""Benchmark decontamination: prefix-filtered set join, with DataFrame functions only.

A window of an item's words occurs in a document only if all its words do, so of each window one necessary prefix
token suffices: its rarest word by counts over the whole corpus. A fixed bitmap (2**BITS bits, as a literal) lets
through the document words that may be such a token; each is joined to its windows with the words around it, bounded by
the window's place and length, and the words are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import checkpointed
from .sharding import lookup_array

WINDOW, BITS = 10, 20
#: Document words that may be prefix tokens are dealt to so many salts, windows repeated for each: a passage that many documents share doesn't meet in one task.
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; of null, none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _APART, -1), "")


def _place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(1 << BITS))


def _bitmap(words_: DataFrame) -> Column:
    """Literal words of 64 bits, one bit set for each value of column `word`."""
    found = words_.select(_place(F.col("word")).alias("p")).groupBy(F.shiftright("p", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("bits")).collect()
    out = [0] * (1 << BITS - 6)
    for r in found:
        out[r.k] = r.bits
    return lookup_array(out, "array<bigint>")


def _may_be(word: Column, bitmap: Column) -> Column:
    p = _place(word)
    return F.getbit(F.get(bitmap, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1


def item_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """item and window (an array of words) for each different window of each item."""
    w = items.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(WINDOW)).alias("window")).distinct()


def rarest_words(windows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """window, word (the rarest in the corpus; of equally rare ones the first by code points), offset of its first place."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    known = _bitmap(vocabulary)
    seen = docs.select(F.explode(words(F.col(text))).alias("word")).where(_may_be(F.col("word"), known)).groupBy("word").agg(F.count("*").alias("n"))
    places = windows.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word"))
    best = places.join(seen, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("b"))
    return best.select("window", "b.word", "b.offset")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, text_id (xxhash64 of the text, 42 for null), n_words, n_hit (words inside occurring windows), items (sorted array of the ids, as strings, of items with occurring windows), one row per row of docs.

    A null text has no words, an item without words no windows; a null item id is not listed, its windows count. Windows
    that several items share are searched for once. Rows with equal key and text get equal results. Either table may be
    empty.
    """
    windows = checkpointed(item_windows(items, item, item_text))
    necessary = checkpointed(rarest_words(windows, docs, text).withColumn("id", F.xxhash64("window")))
    wanted = _bitmap(necessary.select("word"))
    around = WINDOW - 1
    # place 0 holds an empty word, which is no document word: it carries the row itself
    split = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_id"), words(F.col(text)).alias("w")).select("key", "text_id", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word"))
    first = F.greatest(F.col("pos") - around, F.lit(1))
    context = F.when(F.col("pos") > 0, F.slice("w", first, F.col("pos") + around - first + 1))
    found = checkpointed(split.where((F.col("pos") == 0) | _may_be(F.col("word"), wanted)).select("key", "text_id", F.size("w").cast("long").alias("n_words"), "pos", "word", first.alias("first"), context.alias("near")))
    rows = found.where("pos = 0").select("key", "text_id", "n_words")
    start = F.col("pos") - F.col("offset")
    bounded = (start >= 1) & (start + F.size("window") - 1 <= F.col("n_words"))
    same = F.slice("near", F.when(bounded, start - F.col("first") + 1).otherwise(1), F.size("window")) == F.col("window")
    dealt = found.where("pos > 0").withColumn("salt", F.pmod(F.xxhash64("text_id", "pos"), F.lit(SALTS)).cast("int"))
    salted = necessary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = dealt.join(salted, ["word", "salt"]).where(bounded & same).select("key", "text_id", start.alias("s"), (start + F.size("window")).alias("e"), "id", "window").distinct()
    hits = checkpointed(hits)
    doc = ["key", "text_id"]
    before = F.max("e").over(Window.partitionBy(*doc).orderBy("s", "e", "id").rowsBetween(Window.unboundedPreceding, -1))
    covered = hits.select(*doc, "s", "e", "id").withColumn("before", before).groupBy(*doc).agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("before", "s")))).cast("long").alias("n_hit"))
    listed = hits.select(*doc, "window").distinct().join(windows, "window").groupBy(*doc).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    each = covered.join(listed, (covered.key.eqNullSafe(listed.key)) & (covered.text_id == listed.text_id), "left").select(covered.key.alias("k"), covered.text_id.alias("t"), "n_hit", "items")
    joined = rows.join(each, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_id") == F.col("t")), "left")
    return joined.select(F.col("key").alias(key), "text_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
