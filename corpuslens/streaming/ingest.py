"""Incremental ingest: new files of a folder are appended once, the first write of each key winning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Taken:
    """What a micro-batch has read, and how many keys it has seen for the first time."""

    batch: int
    rows: int
    new_keys: int


class _Listener(StreamingQueryListener):
    def __init__(self, name: str, report: Callable[[Taken], None]):
        self.name, self.report = name, report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        at = event.progress
        if at.name == self.name:
            self.report(Taken(at.batchId, at.numInputRows, sum(s.numRowsUpdated for s in at.stateOperators)))

    def onQueryTerminated(self, event) -> None:
        pass


def _first_of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first row of a key that no micro-batch has had, by the time of its file, the file's name and the row's place in it."""
    if state.exists:
        return
    first = None
    for frame in frames:
        for row in frame[["_at", "_file", "_row", "_payload"]].itertuples(index=False, name=None):
            first = row if first is None or row < first else first
    state.update((True,))
    yield pd.DataFrame({"_payload": [first[3]]})


def first_writes(rows: DataFrame, key: str) -> DataFrame:
    """Of a stream of Parquet files the first write of each key, ever.  Which keys were there is the stream's state, so nothing that was
    written is read again; a key of null is a key like others."""
    payload = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    found = rows.select(
        F.coalesce(F.concat(F.lit("of "), F.col(key).cast("string")), F.lit("none")).alias("_key"), F.unix_micros("_metadata.file_modification_time").alias("_at"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), payload.alias("_payload"),
    )
    kept = found.groupBy("_key").applyInPandasWithState(_first_of, "_payload string", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    read = F.from_json("_payload", rows.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return kept.select(read.alias("row")).select("row.*")


def ingest_stream(
    spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, key: str = "article_id",
    report: Callable[[Taken], None] | None = None, files_each: int | None = None,
) -> StreamingQuery:
    """A query that takes what is there and ends; the next one goes on where it ended, or was stopped.  Files count in the order of their
    times, ``files_each`` at most for a micro-batch.  ``target`` belongs to the stream: its log says which files count, so each row is
    there once, whatever fails.  ``report`` hears of every micro-batch."""
    source = spark.readStream.schema(schema)
    rows = (source.option("maxFilesPerTrigger", files_each) if files_each else source).parquet(folder)
    name = f"ingest {target}"
    if report:
        spark.streams.addListener(_Listener(name, report))
    out = first_writes(rows, key).writeStream.queryName(name).format("parquet").outputMode("append")
    return out.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
