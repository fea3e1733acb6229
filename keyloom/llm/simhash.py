"""SimHash near-duplicates by random bit sampling.

Every text becomes the set of its five-word shingles and that a signature of 256 bits. Equal sets are collapsed first.
Several tables group the remaining signatures by sampled coordinates: so many that AVERAGE unrelated texts share a bucket,
and so many tables that a pair at the threshold meets in one of them with a chance of RECALL, whatever the corpus's size
(see layout()). A bucket of over CAP members is cut by additional bits, as many as its size asks for, in as many ways as
RECALL asks for, and all its members are also held against its first one, so a large group of near copies stays
together. Inside a bucket signatures are compared, and its closest pairs proposed: up to
SURE bits apart they are linked; up to MAYBE the link is kept if the shingle sets themselves, read again, are similar
enough. Then every other pair of a bucket up to MAYBE is settled too whose members aren't yet in one component, so that
none is lost because closer pairs failed. Classes are the connected components of the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import checkpointed, free_name, written
from ._text import mix64, word_hashes
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: Of 256 bits. A similarity of 0.8 makes 39 of them differ, give or take 6; 0.9 makes 27.
SURE, EXPECTED, MAYBE = 20, 39, 54
#: Members that an average bucket of unrelated texts has, and the chance that EXPECTED bits apart share one of the tables' buckets.
AVERAGE, RECALL = 64, 0.97
#: Bits that a table samples, at least and at most, members beyond which a bucket is cut, and bits that cut it at most.
LEAST_BITS, MOST_BITS, CAP, MORE_BITS = 8, 40, 1024, 16
#: Links that each member of a bucket proposes at first, besides a spanning forest.
NEAREST = 2
#: Members of a bucket that are dealt to a task together when all its pairs are settled.
BLOCK = 512
#: Hot buckets are joined by broadcast up to so many, else by a shuffle.
FEW = 10_000
_SIG = ["s0", "s1", "s2", "s3"]
_PROPOSED = ["a", "b", "d", "g"]
_SALTS = np.random.default_rng(8).integers(1, 2**63, 4, np.uint64)


def repeats(bits: int) -> int:
    """How often so many bits must be sampled for RECALL."""
    return ceil(log(1 - RECALL) / log(1 - (1 - EXPECTED / 256) ** bits))


def layout(n: int) -> tuple[int, int]:
    """The number of tables and of bits that each samples, for n signatures. The tables grow with n to the power of 0.24."""
    bits = min(max(ceil(log2(max(n, 1) / AVERAGE)), LEAST_BITS), MOST_BITS)
    return repeats(bits), bits


def _sampled(tables: int, bits: int) -> np.ndarray:
    rng = np.random.default_rng(88)
    return np.stack([rng.permutation(256)[:bits] for _ in range(tables)])


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's five-word shingles; all words of a shorter text are one shingle."""
    h, off = word_hashes(texts)
    out = []
    for i in range(len(texts)):
        w = h[off[i] : off[i + 1]]
        n = max(len(w) - SHINGLE + 1, min(len(w), 1))
        k = min(len(w), SHINGLE)
        s = np.full(n, np.uint64(k))
        for j in range(k):
            s = mix64(s + w[j : j + n])
        out.append(np.unique(s))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """256 bits as four 64-bit words: each the majority over the shingles of that bit of their hashes."""
    ones = np.zeros(256, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = mix64(shingles[at : at + (1 << 14), None] ^ _SALTS)
        ones += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(shingles)).view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], n: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        texts = part.column(1).to_pylist()
        sets = shingle_sets(texts)
        sig = np.zeros((len(sets), 4), np.uint64)
        ident = np.zeros((len(sets), 2), np.uint64)
        for i, s in enumerate(sets):
            if len(s):
                sig[i] = signature(s)
                ident[i] = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s ^ _SALTS[0]))
            elif texts[i] is not None:  # without words: the text itself
                ident[i] = np.frombuffer(hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).digest()[:16], np.uint64)
        cols = [pa.array([-1 if t is None else len(s) for t, s in zip(texts, sets, strict=True)], pa.int64()), *(pa.array(x.view(np.int64)) for x in np.ascontiguousarray(np.concatenate([ident, sig], 1).T))]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["key", "n", "e0", "e1", *_SIG])


def _bucketed(batches: Iterator[pa.RecordBatch], tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each table: bucket (table and sampled bits), rep and its signature."""
    places = _sampled(tables, bits)
    first = 1 << np.arange(bits).astype(np.int64)
    for part in _slices(batches, 2048):
        sig = np.stack([part.column(1 + k).to_numpy() for k in range(4)], 1)
        unpacked = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1)
        for t in range(tables):
            yield pa.RecordBatch.from_arrays([pa.array((t << bits) + unpacked[:, places[t]].astype(np.int64) @ first), *part.columns], ["bucket", "rep", *_SIG])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _link_group(rep: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: a minimum spanning forest of its distances up to MAYBE, and each member's NEAREST others: a few links a member, not all pairs.

    Last, the members with more others up to MAYBE: both members of any pair that isn't proposed are among them.
    """
    n = len(rep)
    far = MAYBE + 1
    gap, parent, waiting = np.full(n, far), np.full(n, -1), np.ones(n, bool)
    i, edges, crowded = 0, [], np.zeros(n, bool)
    for _ in range(n):
        waiting[i] = False
        d = _apart(sig, sig[i])
        d[i] = far
        near = np.argpartition(d, NEAREST)[:NEAREST] if n > NEAREST else np.arange(n)
        edges += [(i, int(j), int(d[j])) for j in near if d[j] <= MAYBE]
        crowded[i] = np.count_nonzero(d <= MAYBE) > NEAREST
        closer = waiting & (d < gap)
        gap[closer], parent[closer] = d[closer], i
        left = np.flatnonzero(waiting)
        if not len(left):
            break
        i = int(left[np.argmin(gap[left])])
        if gap[i] <= MAYBE:
            edges.append((i, int(parent[i]), int(gap[i])))
    x = np.array(edges, np.int64).reshape(-1, 3)
    return rep[x[:, 0]], rep[x[:, 1]], x[:, 2], rep[crowded]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, of rows sorted by their first column. Holds one group beyond a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[batch.num_rows - 1].as_py()
        held.append(batch)
        if last == held[0].column(0)[0].as_py():
            continue  # still the same group
        t = pa.Table.from_batches(held)
        cut = int(np.searchsorted(t.column(0).to_numpy(), last))
        yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _starts(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    begin = np.flatnonzero(np.diff(g, prepend=g[0] - 1)) if len(g) else np.empty(0, np.int64)
    return begin, np.diff(np.append(begin, len(g)))


def _linked(batches: Iterator[pa.RecordBatch], most: int = 8 * CAP) -> Iterator[pa.RecordBatch]:
    """Rows (g, rep, signature) come sorted by g. Gives pairs (a, b, d), and (a, g) for the crowded members of a bucket.

    A bucket of over `most` is linked in slices at first, and all its members count as crowded.
    """
    small = 8

    def run(g: np.ndarray, rep: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin, n = _starts(g)
        size = np.repeat(n, n)
        found, crowded = [], []
        for step in range(1, small):
            i = np.flatnonzero((g[:-step] == g[step:]) & (size[:-step] <= small)) if len(g) > step else ()
            if len(i):
                d = _apart(sig[i], sig[i + step])
                near = d <= MAYBE
                found.append((rep[i[near]], rep[i[near] + step], d[near]))
        for at, k in zip(begin[n > small], n[n > small], strict=True):
            for c in range(at, at + k, most):
                part = slice(c, min(c + most, at + k))
                *links, more = _link_group(rep[part], sig[part])
                if k > most:
                    more = rep[part]  # the others of a pair may be in another slice
                found.append(links)
                crowded.append((more, np.full(len(more), g[at])))
        if found:
            a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d), pa.nulls(len(a), pa.int64())], _PROPOSED)
        if crowded:
            a, at = (np.concatenate(x) for x in zip(*crowded, strict=True))
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), none, none, pa.array(at)], _PROPOSED)

    for t in _whole(batches):
        cols = [t.column(x).to_numpy() for x in ("g", "rep", *_SIG)]
        yield from run(cols[0], cols[1], np.stack(cols[2:], 1).view(np.uint64))


def _settle(part: np.ndarray, inner: bool, rep: np.ndarray, root: np.ndarray, sig: np.ndarray, sets: pa.ListArray) -> list[tuple[int, int]]:
    """The links that join the components of some members: every pair up to MAYBE is verified unless its members are in one by then.

    Where not inner, only pairs of different parts: those of one part are compared elsewhere.
    """
    own = np.unique(root, return_inverse=True)[1]
    size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.append(0, np.cumsum(size))
    word, links = None, []
    for i in range(len(rep) - 1):
        j = i + 1 + np.flatnonzero((own[i + 1 :] != own[i]) & (inner | (part[i + 1 :] != part[i])))
        if not len(j):
            continue
        d = _apart(sig[j], sig[i])
        j, d = j[d <= MAYBE], d[d <= MAYBE]
        ok = d <= SURE
        if not ok.all():
            if word is None:
                word = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
                mark = np.zeros(len(word) and word.max() + 1, bool)
            mine = word[at[i] : at[i + 1]]
            mark[mine] = True
            rows = np.concatenate([word[at[k] : at[k + 1]] for k in j])
            both = np.add.reduceat(mark[rows], np.append(0, np.cumsum(size[j]))[:-1], dtype=np.int64)
            mark[mine] = False
            ok |= both >= SIMILARITY * (size[i] + size[j] - both)
        for k in j[ok]:
            if own[k] != own[i]:
                links.append((int(rep[i]), int(rep[k])))
                own[own == own[k]] = own[i]
    return links


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, part, inner, rep, root, signature, shingles) come sorted by unit."""
    for t in _whole(batches):
        unit, part, inner, rep, root, *sig = (t.column(x).to_numpy() for x in ("unit", "part", "inner", "rep", "root", *_SIG))
        sig = np.stack(sig, 1).view(np.uint64)
        sets = t.column("shingles").combine_chunks()
        links = []
        for at, k in zip(*_starts(unit), strict=True):
            x = slice(at, at + k)
            links += _settle(part[x], bool(inner[at]), rep[x], root[x], sig[x], sets[x])
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _distance(x: list[Column], y: list[Column]) -> Column:
    d = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y, strict=True)]
    return d[0] + d[1] + d[2] + d[3]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        sets = [(s >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in shingle_sets(part.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], ["id", "shingles"])


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a < b and d: pairs of representatives up to MAYBE bits apart, a number of them that follows the rows'. signed: rep and signature.

    Second, g and rep: the members of each bucket between which there may be further such pairs.
    """
    tables, bits = layout(signed.count())
    rows = signed.select("rep", *_SIG).mapInArrow(partial(_bucketed, tables=tables, bits=bits), "bucket bigint, rep bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    hot = checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > CAP))
    few = hot.limit(FEW + 1).count() <= FEW
    near = F.broadcast if few else (lambda df: df)
    # so many more bits that a bucket of unrelated members would fall to half of CAP; each way takes them elsewhere in the signature
    extra = F.least(F.lit(MORE_BITS), F.ceil(F.log2(F.col("size") / CAP)).cast("int") + 1)
    ways = F.get(F.array(*(F.lit(1 if not k else repeats(k)) for k in range(MORE_BITS + 1))), F.coalesce("extra", F.lit(0)))
    marked = rows.join(near(hot.withColumn("extra", extra)), "bucket", "left").withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1)))
    at = F.expr("cast(pmod(way div 4 * extra, 65 - extra) AS int)")
    word = F.get(F.array(*_SIG), F.expr("way % 4"))
    cut = F.call_function("shiftrightunsigned", word, at).bitwiseAND(F.expr("shiftleft(1L, extra) - 1"))
    g = F.when(F.col("extra").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "way", cut))
    grouped = marked.select(g.alias("g"), "rep", *_SIG).repartition("g").sortWithinPartitions("g")
    found = written(grouped.mapInArrow(partial(_linked, most=8 * CAP), ", ".join(f"{c} bigint" for c in _PROPOSED)), "proposed")
    inside = found.where("b IS NOT NULL").select("a", "b", "d")

    own = rows.join(near(hot), "bucket", "left_semi")
    pivot = own.groupBy("bucket").agg(F.min(F.struct("rep", *_SIG)).alias("p"))
    held = own.join(near(pivot), "bucket").where(F.col("rep") != F.col("p.rep"))
    held = held.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"), _distance([F.col(x) for x in _SIG], [F.col(f"p.{x}") for x in _SIG]).cast("bigint").alias("d")).where(F.col("d") <= MAYBE)
    return inside.unionByName(held).groupBy("a", "b").agg(F.min("d").alias("d")), found.where("b IS NULL").select("g", F.col("a").alias("rep"))


def unsettled(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (unit, part, inner, rep, root) of the buckets with several components: each pair of a bucket's members meets in one unit.

    A bucket is dealt in parts of about BLOCK members, and every two parts are a unit, so a large one isn't compared in one task.
    """
    rooted = crowded.join(found.select(F.col("id").alias("rep"), "root"), "rep", "left").select("g", "rep", F.coalesce("root", "rep").alias("root"))
    several = rooted.groupBy("g").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rooted.join(several.select("g", parts.alias("parts")), "g").withColumn("part", F.expr("pmod(xxhash64(rep), parts)").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = F.xxhash64("g", F.least("part", "other"), F.greatest("part", "other"))
    return dealt.select(unit.alias("unit"), "part", (F.col("part") == F.col("other")).alias("inner"), "rep", "root")


def roots(pairs: DataFrame, crowded: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """id and root of every representative that is linked. reps: rep and signature. texts: id and x, the text of each representative.

    Of the pairs that aren't sure, each member's closest is verified first. The others need it only where that hasn't made
    one class of their members, so the texts of a large group are hardly compared beyond its first links. At last the
    crowded members of a bucket that are still in different classes are compared, all pairs.
    """
    pairs = written(pairs.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))), "pairs")
    unsure = pairs.where(F.col("d") > SURE)
    named = unsure.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowded.select(F.col("rep").alias("id"))).distinct()
    sets = written(texts.join(named.hint("merge"), "id", "left_semi").select("id", "x").dropDuplicates(["id"]).mapInArrow(_sets, "id bigint, shingles array<int>"), "shingles")
    both = F.size(F.array_intersect("of_a", "of_b"))
    similar = both >= SIMILARITY * (F.size("of_a") + F.size("of_b") - both)

    def verified(some: DataFrame) -> DataFrame:
        of = [sets.select(F.col("id").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab"]
        return some.select("a", "b").join(of[0], "a").join(of[1], "b").where(similar).select("a", "b")

    links = written(pairs.where(F.col("d") <= SURE).select("a", "b").unionByName(verified(unsure.where("k = 1"))), "links")
    found = components(links)
    of = [found.select(F.col("id").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab"]
    apart = unsure.where("k > 1").join(of[0], "a", "left").join(of[1], "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    more = written(verified(apart), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)
    rows = unsettled(crowded, found).join(reps.select("rep", *_SIG), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    dealt = rows.select("unit", "part", "inner", "rep", "root", *_SIG, "shingles").repartition("unit").sortWithinPartitions("unit")
    rest = written(dealt.mapInArrow(_settled, "a bigint, b bigint").distinct(), "links")
    return found if rest.isEmpty() else components(links.unionByName(rest))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (the smallest key of the class) and n_shingles, one row per row of docs whose key is a 64-bit integer.

    Texts without words are of one class if they are equal. A null text is a class of its own, as is a row with a null key
    (class null). Rows that repeat a key are one document if their texts are equal; else its class is that of the smaller.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("x"))
    signed = rows.mapInArrow(_signed, "key bigint, n bigint, e0 bigint, e1 bigint, " + ", ".join(f"{s} bigint" for s in _SIG))
    signed = checkpointed(signed)
    with_text = signed.where("n >= 0 AND key IS NOT NULL")
    reps = checkpointed(with_text.groupBy("n", "e0", "e1").agg(F.min("key").alias("rep"), *(F.first(s).alias(s) for s in _SIG)))
    members = with_text.select("key", "n", "e0", "e1").join(reps.select("n", "e0", "e1", "rep"), ["n", "e0", "e1"]).select("key", "rep")
    worded = reps.where("n > 0")
    near = roots(*candidates(worded), worded, rows.select(F.col("key").alias("id"), "x"))
    of = members.groupBy("key").agg(F.min("rep").alias("rep"))
    of = of.join(near.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("key").alias("k"), F.coalesce("root", "rep").alias("class_id"))
    return signed.join(of, F.col("key") == F.col("k"), "left").select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.greatest("n", F.lit(0).cast("long")).alias("n_shingles"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all columns: that with its smallest key.

    Rows with a null key stay, as do rows with null texts and different keys. Of rows that agree in key and text one stays;
    which, if other columns differ, isn't defined. Rows of one key with different texts share their class's fate.
    """
    named = free_name(docs.columns, "gone")
    gone = classes(docs, key, text).where(F.col("class_id") != F.col(key)).select(F.col(key).alias(named)).distinct()
    kept = docs.join(gone, F.col(key) == F.col(named), "left_anti")
    at, x = free_name(docs.columns, "key"), free_name(docs.columns, "text")
    same = docs.where(F.col(key).isNotNull()).select(F.col(key).alias(at), F.xxhash64(text).alias(x))
    again = written(same.groupBy(at, x).agg(F.count("*").alias("n")).where("n > 1").select(at, x), "repeated")
    if again.isEmpty():
        return kept
    repeated = (F.col(key) == F.col(at)) & (F.xxhash64(text) == F.col(x))
    return kept.join(again, repeated, "left_anti").unionByName(kept.join(again, repeated).dropDuplicates([at, x]).select(*(F.col(f"`{c}`") for c in docs.columns)))
