"""Point-in-time reads over the change log, validity and decay. Every function takes its clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RATE = 0.0001


def as_of(deltas: DataFrame, at: Column) -> DataFrame:
    """Every node's state at a time (included): `node_id`, `body`, `confidence`, `valid_time`, `changed_at`.

    An insert or delete starts an epoch; within the last epoch each field takes its latest
    value; updates before any insert, and epochs begun by a delete, give no node. The
    number of epochs is a running sum over a node's own log, then one aggregation.
    """
    w = W.partitionBy("node_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    marked = deltas.where((F.col("ts") <= at) & F.col("op").isNotNull()).withColumn("epoch", F.sum(F.when(F.col("op").isin("insert", "delete"), 1).otherwise(0)).over(w))
    order = F.struct("ts", "seq")

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), order))

    epochs = marked.groupBy("node_id", "epoch").agg(
        F.min_by("op", order).alias("begun"), last("body").alias("body"), last("confidence").alias("confidence"), last("valid_time").alias("valid_time"), F.max("ts").alias("changed_at")
    )
    final = epochs.groupBy("node_id").agg(F.max_by(F.struct("begun", "body", "confidence", "valid_time", "changed_at"), "epoch").alias("e"))
    return final.select("node_id", "e.*").where("begun = 'insert'").drop("begun")


def valid_at(nodes: DataFrame, at: Column) -> DataFrame:
    return nodes.where((F.col("tx_time") <= at) & (F.col("valid_time").isNull() | (F.col("valid_time") > at)))


def changed_between(nodes: DataFrame, begin: Column, end: Column) -> DataFrame:
    return nodes.where(F.col("tx_time").between(begin, end))


def history(deltas: DataFrame) -> DataFrame:
    """The log with each node's changes numbered."""
    w = W.partitionBy("node_id").orderBy("ts", "seq")
    return deltas.where("op is not null").withColumn("version", F.row_number().over(w).cast("bigint"))


def seconds_since(then: Column, now: Column) -> Column:
    """Whole seconds, 0 for what lies ahead."""
    return F.greatest(F.floor((F.unix_micros(now) - F.unix_micros(then)) / 1_000_000), F.lit(0)).cast("double")


def decayed(confidence: Column, tx_time: Column, now: Column, rate: float = RATE) -> Column:
    c = confidence
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c + F.greatest(1 - c, F.lit(0.0)) * F.exp(-rate * seconds_since(tx_time, now))))


def stale(nodes: DataFrame, now: Column, threshold: float, rate: float = RATE) -> DataFrame:
    return nodes.withColumn("decayed", decayed(F.col("confidence"), F.col("tx_time"), now, rate)).where(F.col("decayed") < threshold)
