"""The corpus operators as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, langid, linededup, sharding, simhash, toxicity, warc
from ._shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % folds


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labelled documents outside fold 0 of 5; the curve from fold 4."""
    labelled = toxicity.with_labels(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity.fit(labelled, tune=fold("doc_id", 5) == 4)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")), keep=("doc_id", held))


def encoded(docs: DataFrame) -> DataFrame:
    done = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(done)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs, model, keep=("doc_id", held))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontam.contamination(docs, items)
    listed = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 8, fresh_path(spark, "slot-map"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.maximal_turns(_table(spark, sf_dir, "conversations")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_dropped, n_chars and sha256 of each text without its repeated lines."""
    done = linededup.drop_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark, _table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_bpe": op3_bpe,
    "op4_neighbours": op4_neighbours,
    "op5_language": op5_language,
    "op6_sharding": op6_sharding,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM p LEFT JOIN k USING (h)""",
    "op2_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS x, least(10, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
h AS (SELECT r, s, n, item_id FROM dw JOIN bw USING (x, n)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM h)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""",
    "op7_chat": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS m FROM t GROUP BY conv_id),
e AS (SELECT min(conv_id) AS conv_id, m, count(*) AS n_copies FROM c GROUP BY m),
k AS (SELECT * FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE len(b.m) > len(a.m) AND b.m[1] = a.m[1] AND b.m[1:len(a.m)] = a.m))
SELECT conv_id, CAST(len(m) AS BIGINT) AS n_turns, n_copies,
       array_to_string(list_transform(m, lambda y: '<|' || coalesce(y.r, 'unknown') || '|>' || chr(10) || coalesce(y.x, '') || chr(10) || '<|end|>' || chr(10)), '') AS chat FROM k""",
    "op9_line_dedup": r"""
WITH l AS (SELECT DISTINCT text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT text, i, list_filter(regexp_split_to_array(regexp_replace(x, '[^ \t\r]*[0-9][^ \t\r]*', '<*>', 'g'), '[ \t\r]+'), lambda y: y <> '') AS w FROM l),
u AS (SELECT text, i, w, len(w) AS n, CAST(trunc((len(w) - 3) / 3) AS BIGINT) AS d FROM t WHERE len(list_filter(w, lambda y: y <> '<*>')) >= 3),
k AS (SELECT text, i, concat_ws('|', n, j, CASE WHEN n < 9 THEN array_to_string(w, ' ')
        ELSE array_to_string(list_concat(w[1:3 + j * d], w[CASE WHEN j = 2 THEN n ELSE 3 + (j + 1) * d END + 1:]), ' ') END) AS key
      FROM (SELECT *, unnest(CASE WHEN n < 9 THEN [0] ELSE [0, 1, 2] END) AS j FROM u)),
f AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text),
c AS (SELECT key, arg_min(text, doc_id) AS keeper FROM (SELECT DISTINCT key, text FROM k) JOIN f USING (text) GROUP BY key HAVING count(*) >= CASE WHEN CAST(split_part(key, '|', 1) AS BIGINT) >= 50 THEN 2 ELSE 3 END),
g AS (SELECT DISTINCT text, i FROM k JOIN c USING (key) WHERE text <> keeper),
o AS (SELECT text, array_to_string(list(x ORDER BY i), chr(10)) AS kept FROM l ANTI JOIN g USING (text, i) GROUP BY text),
n AS (SELECT text, count(*) AS n FROM g GROUP BY text)
SELECT doc_id, coalesce(n.n, 0) AS n_dropped, length(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) AS n_chars,
       sha256(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) AS text_sha256 FROM documents LEFT JOIN o USING (text) LEFT JOIN n USING (text)""",
}
