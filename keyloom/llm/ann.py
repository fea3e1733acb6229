"""Approximate nearest neighbours by shifted space-filling curves.

A random rotation is cut into TABLES groups of DIMS coordinates; each group, shifted at random, orders all vectors along
a Hilbert curve. A table's keys are range-partitioned in Spark into BLOCKS equal ranges. A query looks into its own range
and the two beside it, in every table; what the tables find is merged and ranked by the exact measure. Equal vectors are
one point of the curve with the smallest TOP + 1 of their ids, which is all that any answer can name, so a vector that
a third of the rows share doesn't weigh. Ranges are dealt to tasks in chunks of CHUNK vectors and QUERIES queries.

The largest inner product becomes the nearest point: a vector gets one more coordinate that lifts it to the length of the
longest, a query is scaled to that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import checkpointed
from .sharding import lookup_array

TABLES, DIMS, BITS, BLOCKS, TOP = 10, 8, 7, 20, 20
CHUNK, QUERIES = 4096, 1024
#: Rows that the scale of the projections is read off, those with the smallest hashes.
SAMPLE = 4096


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """The places along the Hilbert curve of integer points (rows) with `bits` bits a coordinate (Skilling's transform)."""
    x = grid.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def usable(embedding: str) -> Column:
    """Not null, not all zero, and no component null or not finite."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


class Curves:
    """The curves for vectors of one length: a rotation, shifts, and the scale read off a sample."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.longest = longest
        d = sample.shape[1] + 1
        per = max(1, min(DIMS, d))
        cols: list[np.ndarray] = []
        while sum(c.shape[1] for c in cols) < TABLES * per:
            r = np.linalg.qr(rng.standard_normal((d, d)))[0]
            cols.append(r[:, : d // per * per])
        self.axes = np.concatenate(cols, 1)[:, : TABLES * per]
        y = self.lifted(sample) @ self.axes
        self.centre, self.spread = y.mean(0), np.maximum(y.std(0), 1e-12)
        self.shift, self.per = rng.uniform(-0.1, 0.1, TABLES * per), per

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(self.longest**2 - (v**2).sum(1), 0))[:, None]], 1)

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v * (self.longest / np.sqrt((v**2).sum(1)))[:, None], np.zeros((len(v), 1))], 1)

    def keys(self, points: np.ndarray) -> np.ndarray:
        """rows x TABLES."""
        y = (points @ self.axes - self.centre) / self.spread * 0.13 + 0.5 + self.shift
        grid = np.clip(y * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert_keys(grid[:, t * self.per : (t + 1) * self.per], BITS) for t in range(TABLES)], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _keyed(points: DataFrame, curves: Curves, query: bool) -> DataFrame:
    """A row for each table: tab and key beside the point's columns."""
    names = points.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = np.array(part.column(names.index("v")).to_pylist(), np.float64)
                k = curves.keys(curves.scaled(v) if query else curves.lifted(v))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(v), t), pa.int32()), pa.array(k[:, t], pa.int64())], [*names, "tab", "key"])

    return points.mapInArrow(run, f"{schema}, tab int, key bigint")


def _best(group: pd.DataFrame) -> pd.DataFrame:
    """Each query's TOP + 1 best ids in one chunk; ties to the smaller id."""
    ask, have = group[group["query"]], group[~group["query"]]
    out: list[tuple[np.ndarray, ...]] = []
    if len(ask) and len(have):
        ids = np.concatenate(have.ids.to_numpy())
        row = np.repeat(np.arange(len(have)), have.ids.map(len))
        v = np.array(have.v.tolist(), np.float64)
        q = np.array(ask.v.tolist(), np.float64)
        qid = ask.point.to_numpy()
        for at in range(0, len(q), 256):
            s = (q[at : at + 256] @ v.T)[:, row]
            if s.shape[1] > TOP + 1:
                least = np.partition(s, s.shape[1] - TOP - 1, axis=1)[:, -TOP - 1]
                i, j = np.nonzero(s >= least[:, None])
            else:
                i, j = (x.ravel() for x in np.indices(s.shape))
            order = np.lexsort((ids[j], -s[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[rank <= TOP], j[rank <= TOP]
            out.append((qid[at : at + 256][i], ids[j], s[i, j]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pd.DataFrame({"point": cols[0], "vec_id": cols[1], "score": cols[2]})


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the TOP nearest found of each query row, among all rows but itself.

    Nearness is the inner product of the original components in double precision; ties go to the smaller id. Vectors that
    aren't usable(), have no id, or differ in length from most (the shorter of equally common lengths counts) take no part,
    as queries or answers. Rows that repeat an id and vector count once. Too few rows give fewer answers, none give none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("query")).where(usable("v") & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == lengths[0].n)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = rows.agg(F.max(square)).first()[0] ** 0.5
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], np.float64)
    curves = Curves(sample, longest)

    # a point: a different vector, named by its smallest id
    first = Window.partitionBy("v").orderBy("id")
    distinct = rows.select("v", "id").groupBy("v", "id").agg(F.lit(1).alias("one"))
    points = checkpointed(distinct.withColumn("k", F.row_number().over(first)).where(F.col("k") <= TOP + 1).groupBy("v").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids")))
    asking = checkpointed(rows.where("query").select("v", "id").groupBy("v", "id").agg(F.lit(1).alias("one")).join(points.select("v", "point"), "v").select("id", "point"))
    queries = points.join(asking.select("point").distinct(), "point", "left_semi").select("point", F.array().cast("array<bigint>").alias("ids"), "v")

    have = checkpointed(_keyed(points.select("point", "ids", "v"), curves, False))
    # a range holds TOP + 1 points at least, so that a query always sees TOP others, or all there are
    blocks = max(1, min(BLOCKS, points.count() // (TOP + 1)))
    cuts = {r.tab: r.q for r in have.groupBy("tab").agg(F.percentile_approx("key", [k / blocks for k in range(1, blocks)] or [0.0], 10_000).alias("q")).collect()}
    bounds = lookup_array([cuts[t] if blocks > 1 else [] for t in range(TABLES)], "array<array<bigint>>")
    block = F.size(F.filter(F.get(bounds, F.col("tab")), lambda c: c <= F.col("key")))
    have = have.withColumn("block", block)
    ask = _keyed(queries, curves, True).withColumn("own", block).withColumn("block", F.explode(F.sequence(F.greatest(F.col("own") - 1, F.lit(0)), F.least(F.col("own") + 1, F.lit(blocks - 1)))))
    ask = checkpointed(ask.drop("own"))
    # how many chunks each range is dealt to: at most TABLES * blocks numbers
    many = {(r.tab, r.block): r.n for r in have.groupBy("tab", "block").count().withColumnRenamed("count", "n").collect()}
    asked = {(r.tab, r.block): r.n for r in ask.groupBy("tab", "block").count().withColumnRenamed("count", "n").collect()}

    def parts(counts: dict, size: int) -> Column:
        flat = F.array(*(F.lit(max(1, -(-counts.get((t, b), 0) // size))) for t in range(TABLES) for b in range(blocks)))
        return F.get(flat, F.col("tab") * blocks + F.col("block"))

    own, every = (lambda n: F.pmod(F.xxhash64("point"), n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    chunks, groups = parts(many, CHUNK), parts(asked, QUERIES)
    left = have.withColumn("chunk", own(chunks)).withColumn("part", every(groups)).withColumn("query", F.lit(False))
    right = ask.withColumn("part", own(groups)).withColumn("chunk", every(chunks)).withColumn("query", F.lit(True))
    cols = ["tab", "block", "chunk", "part", "query", "point", "ids", "v"]
    found = left.select(*cols).unionByName(right.select(*cols)).groupBy("tab", "block", "chunk", "part").applyInPandas(_best, "point bigint, vec_id bigint, score double")

    merged = found.groupBy("point", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    merged = merged.withColumn("k", F.row_number().over(Window.partitionBy("point").orderBy(*order))).where(F.col("k") <= TOP + 1)
    answers = asking.join(merged, "point").where("id != vec_id").select(F.col("id").alias("query_id"), "vec_id", "score")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= TOP)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
