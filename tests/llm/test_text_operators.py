"""Toxicity, language, BPE, decontamination and line dedup on small tables, against brute force and at the edges."""

import base64
import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import bpe, decontam, langid, linededup, queries, toxicity
from keyloom.llm._text import char_slots, word_hashes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, score double, lines string"
ODD = [(1, None, "en", 0.1, "x"), (2, "", None, 0.2, None), (3, "!!! ---", "en", None, "y"), (None, "one two three", "en", 0.3, "z"), (4, "a b c", "en", 0.0, ""), (4, "a b c", "en", 0.0, ""), (5, "word " * 300_000, "en", 1.0, "q")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# words and n-grams


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_word_hashes_follow_words(texts):
    h, off = word_hashes(texts)
    known: dict[str, int] = {}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        words = "".join(c if c.isalnum() else " " for c in low).split(" ")
        words = [w for w in words if w]
        assert off[i + 1] - off[i] == len(words)
        for w, x in zip(words, h[off[i] : off[i + 1]].tolist(), strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_long_texts_are_cut_beside_words():
    word = "abcdefg "
    h, off = word_hashes(["x", word * 400_000, "y"])
    assert off.tolist() == [0, 1, 400_001, 400_002] and len(set(h[1:400_001].tolist())) == 1
    n = sum(len(s) for s in char_slots("a" * 3_000_000, (1, 2, 3), 15))
    assert n == sum(3_000_002 - k + 1 for k in (1, 2, 3))


# BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def as_ids(reference, t):
    return np.array(reference.encode_ordinary(t), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeinrstüéß \n\t'1$中ा\x1c\x85　😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_equals_the_library(coder, reference, text):
    (out,) = coder.encode_batch([text])
    assert out == as_ids(reference, text) and coder.decode(out) == text.encode()


def test_bpe_repeats_and_forgetting(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    monkeypatch.setattr(bpe, "LONG", 1000)
    texts = ["some words " * 300, "a" * 3000, " " * 2000 + "x", "ab" * 1500, "thing" * 700, None, "", "\n" * 999, "<|endoftext|>"]
    for _ in range(2):
        assert coder.encode_batch(texts) == [as_ids(reference, t or "") for t in texts]


def test_bpe_frames(spark, odd, empty, reference):
    done = bpe.encode_decode(odd.withColumn("decoded", F.lit(1)), PATH, public_tokenizers.PATTERN)
    assert done.columns == [*odd.columns, "token_ids", "decoded"]
    rows = bpe.digests(done).collect()
    for r, d in zip(rows, ODD, strict=True):
        ids = as_ids(reference, d[1] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest())
    assert bpe.encode_decode(empty, PATH, public_tokenizers.PATTERN).count() == 0


# language


def test_language(spark, odd, empty):
    rows = [(f"the house and the {k}", "en") for k in range(30)] + [(f"das Haus und der Üb{k}", "de") for k in range(30)] + [("x", None), (None, "fr")]
    m = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert m.langs == ("de", "en")
    assert m.predict("the mouse and the cat")[0] == "en" and m.predict("der Hund und das Üb")[0] == "de"
    for t in (None, "", "123 !!"):
        assert m.predict(t) == ("und", 0.0)
    out = langid.predict(odd, m, keep=tuple(odd.columns[:3])).collect()
    assert [r.lang_pred for r in out][:3] == ["und"] * 3 and len(out) == len(ODD) and out[4] == out[5]
    assert langid.predict(empty, m).count() == 0
    none = langid.fit(empty)
    assert langid.predict(odd, none).where("lang_pred <> 'und'").count() == 0


def test_language_equals_naive_bayes(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOGETHER", 5000)
    monkeypatch.setattr(langid, "HELD", 2)
    rng = np.random.default_rng(8)
    text = lambda: "".join(rng.choice(list("abcdéß  1"), int(rng.integers(1, 60))))
    rows = [(text(), f"l{int(rng.integers(0, 1500))}") for _ in range(3000)]  # well over a thousand languages
    m = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    langs = sorted({x for _, x in rows})
    assert list(m.langs) == langs and len(langs) > 1000
    slots = lambda t: np.bincount(np.concatenate(list(char_slots(t, (1, 2, 3), 15))), minlength=1 << 15)
    counts, prior = np.zeros((len(langs), 1 << 15)), np.zeros(len(langs))
    for t, x in rows:
        counts[langs.index(x)] += slots(t)
        prior[langs.index(x)] += 1
    logp = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * (1 << 15)))
    ask = ["a" + text() for _ in range(40)]
    for t, (name, score) in zip(ask, m.predict_batch(ask), strict=True):
        total = np.log(prior / prior.sum()) + logp @ slots(t)
        best = int(total.argmax())
        assert name == langs[best] and score == pytest.approx(1 / np.exp(total - total[best]).sum(), rel=1e-6)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_language_held_out(spark):
    truth = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language(spark, DIR)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    held = got.join(truth, "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() > 0.9 * held.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())


# toxicity


def sample(n=600):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(n):
        words = rng.choice(vocabulary, rng.integers(5, 60)).tolist()
        toxic = int(k % 8 == 0)
        if toxic:
            for _ in range(2):
                words.insert(int(rng.integers(0, len(words))), ["scum", "idiot", "moron"][k % 3])
        rows.append((k, " ".join(words), toxic))
    return rows


def test_toxicity(spark, odd, empty):
    rows = sample()
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    m = toxicity.fit(labelled.where("doc_id % 5 <> 0"), tune=F.col("doc_id") % 5 == 4)
    got = {r.doc_id: r for r in toxicity.score(labelled, m).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[k].predicted == y for k, _, y in held) >= 0.97 * len(held)
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())
    out = toxicity.score(odd, m, keep=(F.struct("*").alias("row"),))
    assert out.select("row.*").columns == odd.columns and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    a, b, c = (r.score for r in out.orderBy("row.doc_id").where("row.doc_id <= 3").collect())
    assert a == b == c < 0.5
    assert toxicity.score(empty, m).count() == 0
    for only in (labelled.where("toxic = 0"), labelled.where("false")):
        n = toxicity.fit(only)
        assert toxicity.score(labelled, n).where("predicted = 1").count() == 0
    assert toxicity.score(labelled, toxicity.fit(labelled.where("toxic = 1"))).where("predicted = 0").count() == 0


def test_toxicity_labels_within_a_bound(spark):
    docs = spark.createDataFrame([(k, "t") for k in range(500)] + [(None, "t")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(7, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.with_labels(docs, labels).count() == 400
    assert 100 < toxicity.with_labels(docs, labels, most=200).count() <= 200


def test_toxicity_equals_kneser_ney(spark):
    """Every bigram, word and stem held: the ratios are those of the two models, computed by hand."""
    vocabulary = [f"word{chr(97 + k // 10)}{k}ending" for k in range(60)]
    for seed in range(20):
        rng = np.random.default_rng(seed)
        docs = [(k, " ".join(rng.choice(vocabulary, 25)), int(k % 3 == 0)) for k in range(240)]
        codes, *_, off = toxicity._codes([t for _, t, _ in docs])
        if len(np.unique(toxicity.copies(codes[0], off))) == len(docs):  # none taken for copies by chance
            break
    m = toxicity.fit(spark.createDataFrame(docs, "doc_id bigint, text string, toxic int"), tune=F.lit(False), gate=-1e9)
    bigrams, alone = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for _, t, y in docs:
        w = t.split()
        for pair in set(zip(["", *w], w)):
            bigrams[y][pair] += 1
        for x in set(w):
            alone[y][x] += 1
    every, d = set(bigrams[0]) | set(bigrams[1]), 0.75
    p = []
    for y in (0, 1):
        n, follow, cont = defaultdict(int), defaultdict(int), defaultdict(int)
        for (v, w), c in bigrams[y].items():
            n[v] += c
            follow[v] += 1
            cont[w] += 1
        word = {w: (max(cont[w] - d, 0) + d * len(alone[y]) * sum(b == w for _, b in every) / len(every)) / sum(cont.values()) for w in vocabulary}
        p.append({(v, w): (max(bigrams[y][v, w] - d, 0) + d * follow[v] * word[w]) / n[v] if n[v] else word[w] for v, w in every})
    # a bigram of one text has no ratio of its own and takes its word's
    several = {x for x in every if bigrams[0][x] + bigrams[1][x] > 1}
    for v, w in sorted(several)[:200]:
        text = f"{v} {w}".strip()
        codes, *_ = toxicity._codes([text])
        at = np.searchsorted(m.code, codes[0, -1])
        assert m.code[at] == codes[0, -1] and m.ratio[at] == pytest.approx(np.log(p[1][v, w] / p[0][v, w]), rel=1e-9)


def test_toxicity_of_inflected_forms_and_copies(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    text = lambda: " ".join(word() for _ in range(40))
    rows = [(k, text() + (f" vilest{word()} nasty{word()}" if k % 6 == 0 else ""), int(k % 6 == 0)) for k in range(900)]
    copied = text()
    rows += [(1000 + k, copied, 1) for k in range(60)]  # one mislabelled text, copied
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    m = toxicity.fit(labelled.where("doc_id % 5 <> 0"), tune=F.col("doc_id") % 5 == 4)
    got = {r.doc_id: r.predicted for r in toxicity.score(labelled.selectExpr("*", "1 AS __text"), m, keep=("doc_id", "__text")).collect()}
    held = [r for r in rows if r[0] % 5 == 0 and r[0] < 1000]
    assert sum(got[k] == y for k, _, y in held) >= 0.95 * len(held)
    unseen = [copied.split()[k] + " " + text() for k in range(30)]
    assert m.means(unseen) == pytest.approx(np.zeros(30))


# decontamination


def brute_contamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, tuple(w[s : s + 10])) for i, t in items for w in [split(t)] if w for s in range(max(len(w) - 9, 1))]
    out = []
    for key, t in docs:
        w, hit, found = split(t), set(), set()
        for i, x in windows:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    found |= {str(i)} if i is not None else set()
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["The", "é", "É", "a1", "x", "ß", "Of", "und"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(1, text(25)), (2, "Of the x"), (3, text(12)), (10, None), (11, "?!"), (None, text(14)), (4, "of THE x")]
    docs = [(k, text(int(rng.integers(0, 60)))) for k in range(60)]
    docs += [(100, items[0][1].upper()), (101, "zz " + items[0][1] + "!" + items[0][1]), (102, None), (103, ""), (104, "...")]
    docs += [(None, "of the x"), (105, items[5][1] + " " + items[2][1]), (105, items[5][1] + " " + items[2][1]), (106, "q " * 50_000 + items[0][1])]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=str) == brute_contamination(docs, items)


def test_decontamination_of_nothing(spark, odd, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contamination(odd, none).where("n_hit > 0").count() == 0
    assert decontam.contamination(odd, none).count() == len(ODD)
    assert decontam.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0


# line dedup


def test_line_dedup(spark):
    lic = "Released under licence version {} by all of the usual people involved"
    docs = [(3, f"first line is here\n{lic.format(1)}\nshort"), (5, f"{lic.format(2)}\nsecond text has this"), (9, f"{lic.format(77)}\nshort"), (4, "short\nthird text has that"), (7, None), (8, ""), (10, f"{lic.format(2)}\nsecond text has this")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.drop_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[3] == (docs[0][1], 0)
    assert got[5] == got[10] == ("second text has this", 1)
    assert got[9] == ("short", 1)
    assert got[4] == (docs[3][1], 0) and got[7] == (None, 0) and got[8] == ("", 0)


def test_line_dedup_varying_span(spark):
    base = [f"tok{chr(97 + k)}" for k in range(15)]
    other = base[:7] + ["other", "words"] + base[9:]
    far = base[:3] + ["x"] * 12
    texts = [" ".join(x) for x in (base, other, [*base[:-1], "z"], far)]
    got = [r.text for r in linededup.drop_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == texts  # no template is in three of them: two spans each hold the differences
    again = [*texts[:2], " ".join([*base[:8], "third", *base[9:]]), texts[3]]
    got = [r.text for r in linededup.drop_lines(spark.createDataFrame(list(enumerate(again)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == [texts[0], "", "", texts[3]]
    passage = " ".join(f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(50))
    two = [(1, f"{passage}\nfirst own line here"), (2, f"second own line here\n{passage}"), (3, texts[0]), (4, texts[0] + "\nmore")]
    got = [r.text for r in linededup.drop_lines(spark.createDataFrame(two, "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == [two[0][1], "second own line here", two[2][1], two[3][1]]
    same = [(k, f"{texts[0]}\nown text number {chr(97 + k)} here") for k in range(6)]
    got = [r.text for r in linededup.drop_lines(spark.createDataFrame(same, "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got[0] == same[0][1] and all(g == s[1].split("\n")[1] for g, s in zip(got[1:], same[1:], strict=True))


def test_line_dedup_edges(odd, empty):
    out = linededup.drop_lines(odd.withColumn("n_dropped", F.lit("own")), dropped=None)
    assert out.columns == [*odd.columns, "n_dropped"] and out.count() == len(ODD)
    assert linededup.drop_lines(empty).count() == 0
    clash = odd.selectExpr("*", "7 AS __id", "8 AS __lines", "9 AS __here", "10 AS `__THERE`")
    assert {(r["__id"], r["__lines"], r["__here"], r["__THERE"]) for r in linededup.drop_lines(clash).collect()} == {(7, 8, 9, 10)}
