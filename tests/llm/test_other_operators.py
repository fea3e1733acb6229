"""Neighbours, sharding, chats, near-duplicates, archives and the pipeline."""

import hashlib
import io
import struct
import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import ann, chat, graph, sharding, simhash, warc
from keyloom.llm._shared import fresh_path

# nearest neighbours


def exact(rows, queries, top=20):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in queries:
        s = v @ v[np.flatnonzero(ids == q)[0]]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:top]
        out[q] = [(int(ids[k]), float(s[k])) for k in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 24)).astype(np.float32)
    v[100:400] = v[100]  # a hot vector
    v *= rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(k, v[k].tolist()) for k in range(3000)]
    bad = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (5080, [1.0]), (None, [1.0] * 24), (5100, [float("inf")] * 24)]
    df = spark.createDataFrame([*rows, *bad, rows[20]], "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact(rows, range(0, 3000, 20))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q in (120, 140):  # ties go to the smaller ids
        assert [a for a, _ in got[q] if 100 <= a < 400] == [k for k in range(100, 400) if k != q][: sum(100 <= a < 400 for a, _ in got[q])]
    assert all(abs(s - float(v[q].astype(float) @ v[a].astype(float))) < 1e-9 for q in (0, 20) for a, s in got[q])


def test_few_or_no_neighbours(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = ann.search(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(few.where("false"), F.lit(True)).count() == 0
    assert ann.search(few.limit(1), F.lit(True)).count() == 0


def test_hilbert_curve_is_one():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    k = ann.hilbert_keys(side, 3)
    assert sorted(k) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(k)], axis=0)).sum(1) == 1).all()


# sharding


def test_sharding(spark):
    docs = [(k, "x" * (k % 97)) for k in range(3000)] + [(k, "the same text " * 5) for k in range(3000, 4500)] + [(9000, None), (None, "n"), (9001, ""), (9001, "")]
    folder = fresh_path(spark, "slots")
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("slot", F.lit("own")), 8, folder).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    total, places = defaultdict(int), defaultdict(list)
    for r in rows:
        total[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(total) == set(range(8)) and max(total.values()) - min(total.values()) <= 0.01 * sum(total.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    first, last = sharding.SlotMap.load(spark, folder, 1), sharding.SlotMap.load(spark, folder)
    assert (first.version, last.version) == (1, 2) and first == sharding.SlotMap.first(8)
    equal = defaultdict(set)
    for r in rows:
        equal[r.size, r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in equal.values()) == 1  # the text that fills more than a shard
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard(spark.createDataFrame(docs[::-1], "doc_id bigint, text string"), 8, fresh_path(spark, "slots")).collect()}
    assert all(again[r.doc_id, r.text_crc32] == r.shard for r in rows)
    none = sharding.shard(spark.createDataFrame([], "doc_id bigint, text string"), 8, fresh_path(spark, "slots"))
    assert none.count() == 0


@pytest.mark.parametrize("n", [40, 1000])
def test_equal_texts_share_a_shard(spark, n):
    rng = np.random.default_rng(n)
    docs = [(k, "word " * int(rng.integers(0, 50)) + str(int(rng.integers(0, n // 3)))) for k in range(n)] + [(5000, "x" * 3_000_000), (5001, None), (5002, "")]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("h", F.lit(1)), 8, fresh_path(spark, "slots")).collect()
    shards, text = defaultdict(set), dict(docs)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        shards[raw].add(r.shard)
    assert len(rows) == len(docs) and all(len(s) == 1 for s in shards.values())


def test_rebalancing_edits_the_map():
    rng = np.random.default_rng(0)
    load = rng.integers(0, 1000, sharding.SLOTS).tolist()
    m = sharding.SlotMap.first(4).rebalanced(load)
    grown = m.rebalanced(load, 5)
    sums = [sum(load[s] for s in range(sharding.SLOTS) if grown.owner[s] == k) for k in range(5)]
    assert max(sums) - min(sums) <= 2 and grown.version == 3
    assert sum(a != b for a, b in zip(m.owner, grown.owner, strict=True)) < 0.35 * sharding.SLOTS
    assert m.rebalanced(load).owner == m.owner
    with pytest.raises(ValueError):
        grown.rebalanced(load, 4)


# chats


def test_chats(spark):
    talk = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["b"], 6: [None, "z"], 7: ["", "z"], 8: ["a"]}
    rows = [(c, t, "user" if t % 2 == 0 else None, x) for c, texts in talk.items() for t, x in enumerate(texts)]
    rows += [rows[0], (None, 5, "user", "lost"), (9, None, "user", "a"), (9, 1, None, "x")]
    got = chat.render(chat.maximal_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit(0))))
    by = {r.conv_id: r for r in got.collect()}
    assert set(by) == {2, 4, 5, 6, 7, None}
    assert by[2].n_copies == 2 and by[4].n_copies == 2 and by[2].n_turns == 3
    assert by[2].chat == "<|user|>\na\n<|end|>\n<|unknown|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert chat.maximal_turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# near-duplicates


def brute_classes(docs):
    sets = simhash.shingle_sets([t for _, t in docs])
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            n = len(np.intersect1d(a, b))
            if (len(a) and len(b) and n >= 0.8 * (len(a) + len(b) - n)) or (docs[i][1] is not None and docs[i][1] == docs[j][1]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    return {k: min(g) for g in groups.values() for k in g}


def near_copies(seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(3000)]
    docs, key = [], 0
    for _ in range(40):
        base = rng.choice(words, 200).tolist()
        for c in range(int(rng.integers(1, 6))):
            t = list(base)
            if c:
                t[int(rng.integers(0, 200))] = "edit"
            docs.append((key, " ".join(t)))
            key += 3
    return docs


def test_near_duplicates(spark):
    docs = near_copies()
    docs += [(1000, None), (1001, None), (1002, ""), (1003, ""), (1004, "?!"), (1005, "one two"), (1006, "One, two!"), (1007, "one three"), (1008, docs[0][1].upper()), (1009, "long " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in simhash.classes(df).collect()}
    want = brute_classes(docs)
    assert got == want
    kept = simhash.keep_one(df.withColumn("class_id", F.lit("own")).withColumn("key", F.lit(0)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == ["doc_id", "text", "class_id", "key"]


def test_near_duplicates_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", 16)
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(300)]
    docs = [(k, " ".join([*base[: (p := int(rng.integers(0, 300)))], f"e{k}", *base[p + 1 :]])) for k in range(400)]
    docs += [(1000 + k, " ".join(f"u{k}x{j}" for j in range(100))) for k in range(50)]
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert {got[k] for k in range(400)} == {0} and all(got[1000 + k] == 1000 + k for k in range(50))


def linked_in_buckets(docs, cap=1024):
    """Classes by every pair that shares a bucket (none over cap) up to MAYBE bits apart and is sure or similar enough."""
    sets = simhash.shingle_sets([t for _, t in docs])
    sig = np.stack([simhash.signature(s) for s in sets])
    bits = np.unpackbits(sig.view(np.uint8), axis=1)
    n, words = len(docs), [set(s.tolist()) for s in sets]
    near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=-1)
    shared = np.zeros((n, n), bool)
    for places in simhash._sampled(*simhash.layout(n)):
        b = bits[:, places] @ (1 << np.arange(len(places)))
        same = b[:, None] == b[None]
        assert same.sum(axis=1).max() <= cap
        shared |= same
    own = np.arange(n)
    for i, j in zip(*np.nonzero(np.triu(shared & (near <= simhash.MAYBE), 1)), strict=True):
        both = len(words[i] & words[j])
        if own[i] != own[j] and (near[i, j] <= simhash.SURE or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
            x, y = sorted((own[i], own[j]))
            own[own == y] = x
    return {k: docs[own[i]][0] for i, (k, _) in enumerate(docs)}


def similar_family(pairs=60, others=600, seed=5):
    """Texts of one template, about 0.75 alike, and pairs among them that are about 0.82 alike."""
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(1000)]

    def edited(words, n, mark):
        out = list(words)
        for j, p in enumerate(rng.choice(len(out) // 5, n, replace=False)):
            out[5 * p] = f"{mark}x{j}"
        return out

    texts = [edited(base, 15, f"o{k}") for k in range(others)]
    for k in range(pairs):
        one = edited(base, 15, f"p{k}")
        texts += [one, edited(one, 20, f"q{k}")]
    return [(int(k), " ".join(texts[i])) for k, i in enumerate(rng.permutation(len(texts)))]


def test_near_duplicates_among_merely_similar_texts(spark):
    docs = similar_family()
    want = linked_in_buckets(docs)
    assert len(set(want.values())) > 500 and sum(k != v for k, v in want.items()) > 30
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == want


def test_near_duplicates_across_slices_of_a_bucket(spark):
    rng = np.random.default_rng(6)
    sig = np.tile(rng.integers(0, 2, 256).astype(np.uint8), (36, 1))
    for k in range(1, 36):  # a chain: each is sure to be alike to the last, and less alike to those before
        sig[k] = sig[k - 1]
        sig[k, rng.choice(256, 18, replace=False)] ^= 1
    words = np.packbits(sig, axis=1).view(np.int64).tolist()
    order = [*range(0, 36, 2), *range(1, 36, 2)]  # neighbours of the chain come in different slices
    reps = spark.createDataFrame([(0, k, *words[k]) for k in order], "g bigint, rep bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint").coalesce(1)
    found = reps.mapInArrow(partial(simhash._linked, most=8), ", ".join(f"{c} bigint" for c in simhash._PROPOSED)).cache()
    texts = spark.createDataFrame([(k, f"own{k} words{k}") for k in order], "id bigint, x string")
    got = simhash.roots(found.where("b IS NOT NULL").select("a", "b", "d"), found.where("b IS NULL").selectExpr("g", "a AS rep"), reps, texts)
    assert {r.id: r.root for r in got.collect()} == dict.fromkeys(range(36), 0)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.class_id) for r in simhash.classes(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]
    kept = simhash.keep_one(df.selectExpr("*", "1 AS __gone", "2 AS __key", "text AS `__Text`"))
    assert kept.columns == ["doc_id", "text", "__gone", "__key", "__Text"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, None]
    assert simhash.classes(df.where("false")).count() == 0


def close_pairs(pairs=300, least=0.8, most=0.85, seed=12):
    """Pairs of texts that are `least` to `most` alike, and otherwise unlike any other."""
    rng = np.random.default_rng(seed)
    docs = []
    for k in range(pairs):
        while True:
            words = [f"p{k}w{j}" for j in range(200)]
            other = list(words)
            for j, p in enumerate(rng.choice(200, int(rng.integers(3, 6)), replace=False)):
                other[int(p)] = f"e{k}x{j}"
            a, b = simhash.shingle_sets([" ".join(words), " ".join(other)])
            both = len(np.intersect1d(a, b))
            if least <= both / (len(a) + len(b) - both) < most:
                break
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    return docs


@pytest.mark.parametrize("texts", [600, 2_000_000, 16_000_000])
def test_recall_near_the_threshold(spark, monkeypatch, texts):
    """Also with the tables and bits of so many texts."""
    layout = simhash.layout(texts)
    if texts > 600:
        assert layout[1] > 14
        monkeypatch.setattr(simhash, "layout", lambda n: layout)
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(close_pairs(), "doc_id bigint, text string")).collect()}
    assert all(got[k] in (k, k - 1) for k in range(1, 600, 2)) and sum(got[k] == k - 1 for k in range(1, 600, 2)) >= 0.9 * 300


def test_recall_in_cut_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", 4)  # nearly all buckets are cut by more bits
    monkeypatch.setattr(simhash, "LEAST_BITS", 2)
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(close_pairs(), "doc_id bigint, text string")).collect()}
    assert sum(got[k] == k - 1 for k in range(1, 600, 2)) >= 0.9 * 300


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, int(x)) for x in rng.integers(200, 300, 50)] + [(5, 5), (1, None)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 100 for k in range(100, 141)) and {got[b] for a, b in edges if a == 7} == {7}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# archives


def test_warc_round_trip(spark, monkeypatch):
    big = "é" * 600
    pages = [(1, "http://a/\r\nb c", big), (2, "http://b", big), (9, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", "<p>\r\n\r\n" + "z" * 3_000_000)]
    pages += [(100 + k, f"u{k}", f"<html><body>page {k} " + "some common words here " * 40) for k in range(300)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit(0))
    folder = fresh_path(spark, "warc")
    got = warc.round_trip(spark, df.repartition(2), folder, payloads=True).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    for key, _, html in pages:
        raw = (html or "").encode()
        assert (by[key].payload_bytes, by[key].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert by[key].payload == (raw if by[key].record_type == "response" else None)
    assert [by[k].refers_to for k in (1, 2, 9, None, 5, 6)] == [9, 9, None, 9, None, None]
    assert {k for k, r in by.items() if r.record_type == "revisit"} == {1, 2, None}
    assert warc.round_trip(spark, df.where("false"), fresh_path(spark, "warc")).count() == 0


def frame(content, **k):
    return zstandard.ZstdCompressor(**k).compress(content)


def record(headers="WARC-Type: response", block=b"HTTP/1.1 200 OK\r\n\r\nhi", length=None):
    digest = "sha1:YIW6J7U3B3KTNUMAXR3ISL5C5QMQBVLR"
    head = f"WARC/1.1\r\n{headers}\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: x\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_warc_reader_takes_raw_and_packed_dictionaries():
    rng = np.random.default_rng(1)
    samples = [bytes(rng.choice(list(b"abcdefgh <>"), 400)) + b"common tail of every page" * 5 for _ in range(300)]
    d = zstandard.train_dictionary(4096, samples)
    for raw in (d.as_bytes(), frame(d.as_bytes())):
        data = struct.pack("<II", 0x184D2A5D, len(raw)) + raw + b"".join(frame(s, dict_data=d) for s in samples)
        assert list(warc._frames(io.BytesIO(data))) == samples
    assert list(warc._frames(io.BytesIO(b"".join(map(frame, samples))))) == samples
    assert list(warc._frames(io.BytesIO(b""))) == []
    for cut in (20, len(data) - 3):
        with pytest.raises(warc.WarcError):
            list(warc._frames(io.BytesIO(data[:cut])))
    with pytest.raises(warc.WarcError):
        list(warc._frames(io.BytesIO(b"no archive at all")))


@pytest.mark.parametrize("bad", [b"", b"WARC/9\r\n\r\n", record(length=3), record(length=99), record("Other: 1"), record("WARC-Type: revisit"), record("no colon\r\nWARC-Type: response"), record(), record("WARC-Type: response") + b"x"])
def test_warc_records_are_validated(bad):
    with pytest.raises(warc.WarcError):
        warc.parse_record(bad)


# pipeline


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n=120: " ".join(rng.choice(words, n))
    item = " ".join(f"bench{k}" for k in range(30))
    docs, labels = [], []
    for k in range(300):
        toxic = int(k % 6 == 0)
        docs.append((k, text() + (" scum idiot scum moron idiot scum" if toxic else ""), "en", "s", 1))
        labels.append((k, 1, toxic))
    docs += [(1000, docs[1][1], "en", "s", 1), (1001, docs[2][1] + " edit", "en", "s", 1), (1002, text(40) + " " + item + " " + text(40), "en", "s", 1), (1003, None, None, None, None), (1004, text() + " scum idiot scum moron idiot scum scum", "en", "s", 1)]
    notice = "all of this text may be copied by anyone who keeps this notice"
    docs += [(1010 + k, text() + "\n" + notice, "en", "s", 1) for k in range(5)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    clean = {k for k in range(300) if k % 6} | {1003} | {1010 + k for k in range(5)}
    assert set(got) == clean
    assert got[1003].n_tokens == 0 and got[1010].n_tokens > got[1011].n_tokens
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
