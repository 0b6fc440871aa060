"""Streaming queries; each is tested against its batch version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.registry import query
from lodestone.sources import tables
from lodestone.streaming import watching


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema: T.StructType = tables.table(spark, sf_dir, "events").schema
    raw = watching.read_events(spark, f"{sf_dir}/events.parquet", schema)
    return raw.select("event_id", F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.sha2("props", 256).alias("hash"))


@query("SELECT event_id, user_id AS path FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL 1 HOUR")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watching.drained(watching.debounced(_events(spark, sf_dir), 3_600_000_000))


@query("SELECT event_id, user_id AS path FROM (SELECT *, lag(sha256(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> sha256(props)")
def stream_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watching.drained(watching.changed(_events(spark, sf_dir)))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id AS path, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters of a day's events by path."""
    counts = watching.drained(watching.windowed_counts(_events(spark, sf_dir)), "complete")
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "path", "n")
