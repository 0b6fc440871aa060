"""Incremental ingestion as Structured Streaming: debouncing and change detection with state.

State is one row for each path (time of its last event, last content hash), keyed and spread
by Spark; a path that stays silent for `forget` is dropped from it, so state stays bounded.
Both are equal to their batch versions in `lodestone.operators.watch` as long as events of a
path arrive in order (those of one batch are sorted within it; read a backlog as one batch).

Events without a time are kept as they are and touch no state. Event time for the watermark is
the event's, but 1970-01-01 00:00:01 for all before it, as Spark takes the epoch for late from
the start. Events later than the watermark by more than `forget` are dropped, however old.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.session import hadoop_path, shared_folder

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("path", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("hash", T.StringType())])


def read_events(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream of a Parquet table: a folder of files, or a single file; so many files at a time, or all there are."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    place, files = hadoop_path(spark, path)
    if files.exists(place) and files.getFileStatus(place).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _with_state(events: DataFrame, forget: str, seed: str, kept: Callable[[list[np.ndarray], object], tuple[np.ndarray, object]]) -> DataFrame:
    """Events that `kept` marks; it gets (ids, micros, hashes) of a path in order and its last state, and gives the next one."""
    stay = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Three plain columns are all that is held of a path's events of one batch.
        parts = [(b.event_id.to_numpy(), b.micros.to_numpy(), b.hash.to_numpy(object)) for b in batches]
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort((columns[0], columns[1]))
        columns = [c[order] for c in columns]
        keep, last = kept(columns, state.get[0] if state.exists else None)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(columns[1][-1]) // 1000, 1000) + stay)
        yield pd.DataFrame({"event_id": columns[0][keep], "path": [key[0]] * int(keep.sum())})

    start = F.timestamp_seconds(F.lit(1))
    dated = events.where("ts is not null").select("event_id", "path", "hash", F.unix_micros("ts").alias("micros"), F.greatest("ts", start).alias("seen"))
    path_type = events.schema["path"].dataType.simpleString()
    found = dated.withWatermark("seen", forget).groupBy("path").applyInPandasWithState(step, f"event_id long, path {path_type}", f"last {seed}", "append", GroupStateTimeout.EventTimeTimeout)
    return found.unionByName(events.where("ts is null").select("event_id", "path"))


def debounced(events: DataFrame, gap_micros: int, forget: str = "30 days") -> DataFrame:
    """Events at least the gap after their path's previous one, kept or not."""

    def kept(columns: list[np.ndarray], last: int | None) -> tuple[np.ndarray, int]:
        micros = columns[1]
        since = np.diff(micros, prepend=micros[0] - gap_micros if last is None else last)
        return since >= gap_micros, int(micros[-1])

    return _with_state(events.withColumn("hash", F.lit("")), forget, "long", kept)


def changed(events: DataFrame, forget: str = "30 days") -> DataFrame:
    """Events whose content hash differs from their path's last one; the first always counts, null is a hash of its own."""

    def kept(columns: list[np.ndarray], last: str | None) -> tuple[np.ndarray, str]:
        hashes = np.array(["-" if h is None else "+" + h for h in columns[2]], object)
        before = np.concatenate([np.array([last], object), hashes[:-1]])
        return np.array([a != b for a, b in zip(hashes, before)], bool), hashes[-1]

    return _with_state(events, forget, "string", kept)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Running counters: events by window and path, late ones dropped after `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "path").agg(F.count("*").alias("n"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, run through the stream into a Parquet table in the shared folder.

    In mode `complete` each batch replaces the last one's rows, as running counters do.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        run = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def upsert_to(path: str):
    """A foreachBatch sink: each batch's last row of each key, written as a version of its own.

    Versions are named by batch, so that a batch that is run again writes the same version again.
    """

    def write(rows: DataFrame, batch: int) -> None:
        last = rows.groupBy("path").agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != "path"]), "event_id").alias("r")).select("path", "r.*")
        last.write.mode("overwrite").parquet(f"{path}/version={batch}")

    return write


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """What `upsert_to` has written: each key's row of its last version."""
    versions = spark.read.parquet(path)
    columns = [c for c in versions.columns if c not in ("path", "version")]
    return versions.groupBy("path").agg(F.max_by(F.struct(*columns), "version").alias("r")).select("path", "r.*")
