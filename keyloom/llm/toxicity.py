"""Toxicity: class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts, are compared by the mean over a text's words of
log P(word | word before, toxic) - log P(word | word before, ordinary). Each is interpolated Kneser-Ney: discounted
bigram counts, then discounted continuation counts of its own class (in how many different contexts a word follows),
then the continuation counts that both classes share. Under a word stand its first letters (STEMS): all words that share
them share their counts, so an inflected form that was hardly ever seen is smoothed to its stem. A count is of
documents, so a text that repeats itself counts once, and each of n copies counts for 1/n: those are texts that agree in
both of two minima over the hashes of their word pairs.

A word takes the ratio of the longest expression there is: bigram, word, or stem from the longest on. Its counts in the
two classes must differ beyond what chance makes of any expression of its kind, and its shares of their texts by more than
FACTOR, as each class's mix of languages and lengths shifts all words a little; else it is smoothed to the backoff, and
where nothing is left, to the counts that the classes share: a ratio of 0. In that test an expression counts no oftener
than the number of different words that stand before it (read off 64 bits that they set), so passages copied many times
count as one. A logistic curve, fitted on labelled texts that the counts haven't seen, makes a score of 0 to 1 of the mean.

Counting and the estimates run in Spark over every training text: all labelled ones up to LABELLED of them. The driver
and the broadcast model hold only the expressions beyond chance, 12 bytes each, however many there are: their number
follows the labelled vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discarded, free_name, written
from ._text import mix64, segment_sums, stem_hashes

#: Numbers of first letters whose words share counts.
STEMS = (5,)
#: Labelled texts that a model is fitted on at most; beyond it, a sample of them by the hash of their keys.
LABELLED = 200_000
#: Twice the log-likelihood ratio that an expression must show at least: what chance exceeds once in 1000.
BEYOND_CHANCE = 10.83
#: By how much an expression's share of the texts must differ between the classes.
FACTOR = 3.0
DISCOUNT = 0.75
#: The weight of a text that has no copies; an integer, so that sums don't depend on their order.
WHOLE = 1 << 20
#: Codes counted together at most.
_TOGETHER = 2_000_000
_START = 0  # stands before a text's first word; 31 bits name a word
_WORD = -1  # in codes, before a word counted without context; -2 and so on before a stem


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes (a row for the bigrams, one for the words, one for each of STEMS, -1 where there is none), contexts (a bit
    number of what stands before each), whether a code is there, and where each text's words begin."""
    h, off, cut = stem_hashes(texts, STEMS)
    w = (h >> np.uint64(33)).astype(np.int64) | 1
    v = np.empty_like(w)
    v[1:] = w[:-1]
    u = np.empty_like(w)
    u[2:] = w[:-2]
    full = off[:-1][off[1:] > off[:-1]]
    v[full] = _START
    u[full] = _START
    second = full + 1
    u[second[second < len(u)]] = _START
    codes = [v << 32 | w, np.int64(_WORD) << 32 | w]
    codes += [np.int64(_WORD - 1 - k) << 32 | (c >> np.uint64(33)).astype(np.int64) for k, c in enumerate(cut)]
    before = mix64((v << 32 | w).astype(np.uint64))
    context = [mix64(u.astype(np.uint64)), mix64(v.astype(np.uint64)), *[before] * len(STEMS)]
    there = np.ones((len(codes), len(w)), bool)
    there[2:] = cut != 0
    return np.stack(codes), (np.stack(context) >> np.uint64(58)).astype(np.uint8), there, off


@dataclass(frozen=True)
class ToxicityModel:
    code: np.ndarray  # sorted codes of the expressions beyond chance
    ratio: np.ndarray  # their log-ratios
    slope: float = 1.0
    bias: float = 0.0

    def means(self, texts: list[str | None]) -> np.ndarray:
        """Length-normalised log-likelihood ratio of each text; 0 for one without words."""
        codes, _, there, off = _codes(texts)
        r = np.zeros(codes.shape[1])
        if len(self.code):
            open_ = np.arange(len(r))
            for code, has in zip(codes, there, strict=True):
                x = code[open_]
                at = np.minimum(np.searchsorted(self.code, x), len(self.code) - 1)
                known = (self.code[at] == x) & has[open_]
                r[open_[known]] = self.ratio[at[known]]
                open_ = open_[~known]
        return segment_sums(r, off) / np.maximum(np.diff(off), 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.means(texts) + self.bias, -500, 500)))


def copies(bigrams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A number for each text, equal for those that are likely to be copies of one another: of two minima over the hashes of its bigrams."""
    out = np.zeros(len(off) - 1, np.uint64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        first, second = (np.minimum.reduceat(mix64(bigrams.astype(np.uint64) ^ np.uint64(k)), off[full]) for k in (0, 1 << 63))
        out[full] = mix64(first + mix64(second))
    return out.view(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            codes, *_, off = _codes(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(copies(codes[0], off)), part.column(1)], ["f", "y"])


def _count(batches: Iterator[pa.RecordBatch], groups: Broadcast) -> Iterator[pa.RecordBatch]:
    """v, w and y, in how many texts with that label they stand (by weight), and 64 bits set by what stands before them."""
    held: tuple[list, list] = ([], [])
    size = [0, 0]
    group, weighs = groups.value

    def emit(y: int) -> pa.RecordBatch:
        code, doc, bit, weight = (np.concatenate(x) for x in zip(*held[y], strict=True))
        held[y].clear()
        size[y] = 0
        order = np.argsort(code, kind="stable")  # documents stay in order
        code, doc = code[order], doc[order]
        begin = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
        first = weight[order].astype(np.int64)
        first[1:] *= (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        mask = np.bitwise_or.reduceat(np.uint64(1) << bit[order].astype(np.uint64), begin)
        found = code[begin]
        cols = [found >> 32, found & 0xFFFFFFFF, np.full(len(found), y), np.add.reduceat(first, begin), mask.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int8(), pa.int64(), pa.int64()), strict=True)], ["v", "w", "y", "n", "m"])

    at = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            codes, bits, there, off = _codes(part.column(0).to_pylist())
            doc = np.repeat(np.arange(at, at + part.num_rows, dtype=np.int32), np.diff(off))
            label = part.column(1).to_numpy(zero_copy_only=False)[doc - at]
            f = copies(codes[0], off)
            where = np.searchsorted(group[:-1], f)
            weight = np.where(group[where] == f, weighs[where], WHOLE).astype(np.int32)[doc - at]
            at += part.num_rows
            for y in (0, 1):
                here = there & (label == y)
                if here.any():
                    held[y].append((codes[here], np.broadcast_to(doc, here.shape)[here], bits[here], np.broadcast_to(weight, here.shape)[here]))
                    size[y] += int(here.sum())
                    # boolean indexing goes row after row: of one part, documents are in order within each row
                    if size[y] > _TOGETHER:
                        yield emit(y)
    for y in (0, 1):
        if held[y]:
            yield emit(y)


def contexts(mask: Column) -> Column:
    """About how many different words set these bits; unbounded where all are set."""
    ones = F.bit_count(mask)
    return F.when(ones < 64, -64.0 * F.log(1 - ones / 64.0)).otherwise(F.lit(float("inf")))


def _gain(t: Column, o: Column, toxic: float, ordinary: float) -> Column:
    """Twice the log-likelihood ratio of counts t and o against their parting by the numbers of texts."""
    n = t + o + 1e-12
    return 2 * (t * F.log((t + 1e-9) * (toxic + ordinary) / (n * toxic)) + o * F.log((o + 1e-9) * (toxic + ordinary) / (n * ordinary)))


def _estimate(counts: DataFrame, toxic: float, ordinary: float, gate: float | None) -> ToxicityModel:
    """counts: v, w and in how many texts of either class they stand, t and o, and their contexts' bits, mt and mo; also the numbers of texts."""
    none = ToxicityModel(np.empty(0, np.int64), np.empty(0))
    if not toxic or not ordinary:
        return none
    d = DISCOUNT
    kind = F.least("v", F.lit(0))
    of_kind = {r.kind: r for r in counts.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), *(F.sum(x).alias(f"sum_{x}") for x in "to"), *(F.sum((F.col(x) > 0).cast("long")).alias(f"types_{x}") for x in "to")).collect()}
    if 0 not in of_kind or not of_kind[0].types_t or not of_kind[0].types_o:
        return none

    def by_kind(value) -> Column:
        """A number that depends on the kind; there are no more kinds than stems and two."""
        out = F.lit(0.0)
        for k, r in of_kind.items():
            out = F.when(kind == k, F.lit(float(value(r)))).otherwise(out)
        return out

    least = by_kind(lambda r: max(BEYOND_CHANCE, 2 * log(r.n)) if gate is None else gate)
    t, o = (F.least(F.col(x).cast("double"), contexts(F.col(f"m{x}"))) for x in "to")
    far = F.abs(F.log((t + 0.5) / (toxic + 0.5) * (ordinary + 0.5) / (o + 0.5))) > (log(FACTOR) if gate is None else -1)
    telling = written(counts.where(F.col("t") + F.col("o") > 1).where(far & (_gain(t, o, toxic, ordinary) > least)).select("v", "w", "t", "o"), "telling")

    # of the words and contexts that are named there, how often they continue and are continued
    pairs, one = counts.where("v >= 0"), of_kind[_WORD]
    types = [F.sum((F.col(x) > 0).cast("long")).alias(f"c{x}") for x in "to"]
    named = telling.where(f"v >= {_WORD}").select("w").distinct()
    of_word = pairs.join(named, "w", "left_semi").groupBy("w").agg(*types, F.count("*").alias("shared"))
    before = telling.where("v >= 0").select("v").distinct()
    of_before = pairs.join(before, "v", "left_semi").groupBy("v").agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), *(F.sum((F.col(x) > 0).cast("long")).alias(f"f{x}") for x in "to"))

    total, tokens = of_kind[0], {"t": of_kind[0].types_t, "o": of_kind[0].types_o}
    low = F.col("shared") / total.n

    def word(x: str) -> Column:
        """The continuation probability of a word in class x, interpolated with the one that the classes share."""
        seen = one.types_t if x == "t" else one.types_o
        return (F.greatest(F.col(f"c{x}") - d, F.lit(0.0)) + d * seen * low) / tokens[x]

    def pair(x: str) -> Column:
        n = F.col(f"n{x}")
        return F.when(n > 0, (F.greatest(F.col(x) - d, F.lit(0.0)) + d * F.col(f"f{x}") * word(x)) / n).otherwise(word(x))

    def stem(x: str) -> Column:
        """The share of a stem among all words, interpolated with the share that it has of the words of both classes."""
        every = {y: one[f"sum_{y}"] for y in "to"}
        both = (F.col("t") + F.col("o")) / (every["t"] + every["o"])
        return (F.greatest(F.col(x) - d, F.lit(0.0)) + d * by_kind(lambda r: max(r[f"types_{x}"], 1)) * both) / every[x]

    code = (F.shiftleft(F.col("v").cast("long"), 32) + F.col("w")).alias("code")
    ratio = [F.log(of("t") / of("o")).alias("ratio") for of in (word, pair, stem)]
    found = telling.where(f"v = {_WORD}").join(of_word, "w").select(code, ratio[0])
    found = found.unionByName(telling.where("v >= 0").join(of_word, "w").join(of_before, "v").select(code, ratio[1]))
    found = found.unionByName(telling.where(f"v < {_WORD}").select(code, ratio[2])).where("isnotnull(ratio)").toArrow()
    discarded(telling)
    codes, ratios = found.column("code").to_numpy(), found.column("ratio").to_numpy()
    order = np.argsort(codes)
    return ToxicityModel(codes[order], ratios[order])


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and bias, by Newton's method with a slight penalty, for n cases of x with label y.

    The rarer class weighs more, by the root of the classes' ratio: 0.5 lies between where errors of either class count by
    their number and where they count by their share of the class.
    """
    if not n[y == 1].sum():
        return 0.0, -20.0
    if not n[y == 0].sum():
        return 0.0, 20.0
    n = np.where(y == 1, n * np.sqrt(n[y == 0].sum() / n[y == 1].sum()), n)
    if not x.any():
        return 0.0, float(np.log(n[y == 1].sum() / n[y == 0].sum()))
    scale = np.sqrt(np.average(x**2, weights=n)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
        grad = z.T @ (n * (y - p)) - 1e-3 * b
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), grad)
        b += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def with_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = LABELLED) -> DataFrame:
    """key, text and label of the documents that have one: of all, or, if there are over `most` labels, of a sample of nearly that many.

    The labels that are used, 16 bytes each, are broadcast once they have been counted to be within `most`, so texts stay
    where they are. A document labelled twice counts twice.
    """
    known = labels.select(F.col(key).alias(key), F.col(toxic).alias(toxic)).where(F.col(key).isNotNull() & F.col(toxic).isNotNull())
    n = known.count()
    if n > most:
        share = int(0.95 * most / n * 2**32)
        known = known.where(F.pmod(F.xxhash64(key), F.lit(2**32)) < share)
        n = known.count()
    return docs.select(key, text).join(F.broadcast(known) if n <= most else known, key)


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", tune: Column | None = None, gate: float | None = None) -> ToxicityModel:
    """Learns from all rows with a text and a label 0 or 1. `tune` says which rows fit the curve instead of the counts.

    Without rows of one class (or any), every score is 0 or 1 for the class that is there (0 if none). Rows whose text
    or label is null are not used. The curve sees the means rounded to 1/1024 (a histogram of bounded size). `gate` stands for
    the least gain of an expression, whatever its factor; None: FACTOR, and twice the logarithm of the number of its kind, BEYOND_CHANCE at least.
    """
    spark = labelled.sparkSession
    tune = F.pmod(F.xxhash64(text), F.lit(4)) == 0 if tune is None else tune
    rows = labelled.select(F.col(text).alias("x"), F.col(toxic).cast("int").alias("y"), tune.alias("tune")).where("x IS NOT NULL AND y IN (0, 1)")
    counted = rows.where("NOT tune").select("x", "y")
    of_class = [F.count(F.when(F.col("y") == y, 1)).alias(f"n{y}") for y in (0, 1)]
    marked = counted.mapInArrow(_marked, "f bigint, y int").groupBy("f").agg(*of_class)
    groups = written(marked.withColumn("weight", F.floor(F.lit(WHOLE) / (F.col("n0") + F.col("n1"))).cast("int")), "copies")
    texts = [x / WHOLE for x in groups.agg(*(F.coalesce(F.sum(F.col(f"n{y}") * F.col("weight")), F.lit(0)) for y in (0, 1))).first()]
    # 12 bytes for each group of copies: half of the labelled texts at most, which with_labels() bounds
    many = groups.where("n0 + n1 > 1").select("f", "weight").orderBy("f").toArrow()
    many = [np.append(many.column(x).to_numpy(), 0) for x in ("f", "weight")]
    counting = partial(_count, groups=spark.sparkContext.broadcast(many))
    sums = [(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) / WHOLE).alias(x) for y, x in ((1, "t"), (0, "o"))]
    bits = [F.bit_or(F.when(F.col("y") == y, F.col("m")).otherwise(0)).alias(f"m{x}") for y, x in ((1, "t"), (0, "o"))]
    counts = written(counted.mapInArrow(counting, "v int, w int, y tinyint, n bigint, m bigint").groupBy("v", "w").agg(*sums, *bits), "expressions")
    model = _estimate(counts, texts[1], texts[0], gate)
    discarded(counts)
    discarded(groups)
    shared = spark.sparkContext.broadcast(model)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                m = np.clip(np.round(shared.value.means(part.column(0).to_pylist()) * 1024), -30_000, 30_000)
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), part.column(1)], ["m", "y"])

    bins = rows.where("tune").select("x", "y").mapInArrow(means, "m int, y int").groupBy("m", "y").agg(F.count("*").alias("n")).toArrow()
    m, y, n = (bins.column(x).to_numpy() for x in ("m", "y", "n"))
    slope, bias = _logistic(m / 1024, y, n)
    return replace(model, slope=slope, bias=bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5 on) of every whole text.

    A text that is null or has no words has a mean of 0 and so the curve's score there. Repeated rows get equal scores,
    null ids don't matter, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    source = docs.select(*keep, F.col(text).alias(free_name(kept.columns, "text")))
    names = source.columns[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                s = shared.value.scores(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64()), pa.array(s >= 0.5).cast(pa.int32())], [*names, "score", "predicted"])

    return source.mapInArrow(run, schema + "score double, predicted int")
