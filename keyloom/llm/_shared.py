"""Where jobs cut their lineage: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of this machine's own only where that is unset, as in tests."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        there = tempfile.mkdtemp(prefix="keyloom-")
        sc.setCheckpointDir(there)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return there


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: a lost executor costs no recomputation, and plans stay short."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint, and read by column. It stays there until the folder's owner clears it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Removes the table that written() made for df, once nothing is to be read of it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def free_name(taken: list[str], like: str) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    known = {c.lower() for c in taken}
    name = f"__{like}"
    while name.lower() in known:
        name += "_"
    return name
