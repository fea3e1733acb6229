"""Streams into tables: each micro-batch is one commit."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.batch import Batch
from ..operators.merge import OnConflict
from ..operators.table import Table


def _start(stream: DataFrame, table: Table, progress: str, write: Callable[[DataFrame, Batch], None], every: str | None) -> StreamingQuery:
    mark = f"{table.catalog.root}/_STREAM_{table.name}"

    def run(rows: DataFrame, number: int) -> None:
        files = table.catalog.files
        done = files.read_json(mark) if files.exists(mark) else {}
        if done.get(progress, -1) >= number:
            return  # written before the stream could note it
        b = Batch(table.catalog)
        write(rows, b)
        b.commit()
        files.replace(mark, json.dumps({**done, progress: number}).encode())

    out = stream.writeStream.option("checkpointLocation", progress).foreachBatch(run)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def upsert_stream(stream: DataFrame, table: Table, progress: str, on_conflict: OnConflict = "replace", every: str | None = None) -> StreamingQuery:
    """Upserts a stream's rows. progress: the folder of its checkpoint. every: the trigger interval; None takes what there is and ends."""
    return _start(stream, table, progress, lambda rows, b: table.upsert(rows, on_conflict, b), every)


def delete_stream(stream: DataFrame, table: Table, progress: str, every: str | None = None) -> StreamingQuery:
    """Deletes the keys that a stream brings."""
    return _start(stream, table, progress, lambda rows, b: table.delete(rows, b), every)
