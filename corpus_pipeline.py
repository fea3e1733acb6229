"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, linededup, queries, simhash, toxicity
from keyloom.llm._shared import free_name, fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, by a model of the labelled ones among them.

    A null or wordless text has the score of a ratio of 0; with labels of one class only, all or none go. Repeated rows go
    or stay together; a null id has no label. An empty table gives an empty one.
    """
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=(F.struct("*").alias("row"),))
    return scored.where("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars follows the text.

    Null texts stay null, texts may become empty. Of ties, the smallest id keeps its line, null ids last; equal texts, and
    so repeated rows, are treated alike.
    """
    done = linededup.drop_lines(docs, dropped=None)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id; see simhash.keep_one().

    Null texts and null ids stay. Empty texts are copies of one another. Of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts stay; rows with equal id and text share a fate."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    key, text = free_name(docs.columns, "key"), free_name(docs.columns, "text")
    gone = found.select(F.col("doc_id").alias(key), F.col("text_id").alias(text)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[key]) & (F.xxhash64(docs["text"]) == gone[text]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; a null text counts as empty."""
    return queries.encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The toxicity models, SimHash classes and byte-level BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what lies between them is kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
