"""Spark settings for three sizes of job, as functions of the data's size where that matters."""

from __future__ import annotations

_COMMON = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.parquet.filterPushdown": "true", "spark.sql.session.timeZone": "UTC"}
PROFILES = {
    "low": {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.parquet.compression.codec": "snappy", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"},
    "medium": {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.parquet.compression.codec": "snappy", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"},
    "high": {"spark.sql.files.maxPartitionBytes": "256m", "spark.sql.parquet.compression.codec": "zstd", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"},
}


def profile(name: str, input_bytes: int | None = None) -> dict[str, str]:
    """For a session's builder. With input_bytes, as many shuffle partitions as make them about 128 MB, at least 200."""
    out = {**_COMMON, **PROFILES[name]}
    if input_bytes is not None:
        out["spark.sql.shuffle.partitions"] = str(max(200, -(-input_bytes // (128 << 20))))
    return out
