"""Memory lifecycle: importance from an access log, strength, states and review times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.temporal import seconds_since


@dataclass(frozen=True)
class Config:
    rate: float = 0.0001
    half_life: float | None = None
    archive_below: float = 0.2
    forget_below: float = 0.05
    recency: float = 0.3
    importance: float = 0.4
    confidence: float = 0.3
    active_hours: int = 24

    @property
    def decay(self) -> float:
        """Per second; from the half-life if one is set."""
        import math

        return math.log(2) / self.half_life if self.half_life else self.rate


def factors(access_log: DataFrame) -> DataFrame:
    """Counters of each touched node: `accesses`, `connections`, `edits`, `boost`, `last_accessed`."""
    def times(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    moved = F.max(F.when(F.col("kind").isin("access", "edit"), F.col("ts")))
    return access_log.groupBy("node_id").agg(
        times("access").alias("accesses"),
        times("connect").alias("connections"),
        times("edit").alias("edits"),
        F.least(F.sum(F.when(F.col("kind") == "reinforce", F.col("boost")).otherwise(0.0)), F.lit(1.0)).alias("boost"),
        F.coalesce(F.greatest(moved, F.min("ts")), F.min("ts")).alias("last_accessed"),
    )


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def importance() -> Column:
    a, c, e = F.col("accesses"), F.col("connections"), F.col("edits")
    return clamp(0.4 * F.log1p(a) / 5 + 0.3 * F.sqrt(c) / 10 + 0.2 * F.log1p(e) / 3 + 0.1 * F.col("boost"))


def scored(nodes: DataFrame, touched: DataFrame, now: Column, config: Config = Config()) -> DataFrame:
    """nodes (`id`, `confidence`, `tx_time`) with `recency`, `importance`, `strength` and `state`; untouched ones have 0."""
    joined = nodes.join(touched.withColumnRenamed("node_id", "id"), "id", "left")
    recency = F.when(F.col("last_accessed").isNull(), 0.0).otherwise(F.exp(-config.decay * seconds_since(F.col("last_accessed"), now)))
    known = joined.withColumn("recency", recency).withColumn("importance", F.coalesce(importance(), F.lit(0.0)))
    strength = clamp(config.recency * F.col("recency") + config.importance * F.col("importance") + config.confidence * F.col("confidence"))
    young = F.unix_micros(now) - F.unix_micros("tx_time") < config.active_hours * 3_600_000_000
    state = (
        F.when(young, "active")
        .when(F.col("strength") < config.forget_below, "forgotten")
        .when(F.col("strength") < config.archive_below, "archived")
        .otherwise("consolidated")
    )
    return known.withColumn("strength", strength).withColumn("state", state)


def next_review(accesses: Column, now: Column) -> Column:
    """24 hours, doubled with each access up to six."""
    hours = F.least(24 * F.pow(F.lit(2), F.least(F.coalesce(accesses, F.lit(0)), F.lit(6))), F.lit(2160))
    return F.timestamp_micros(F.unix_micros(now) + (hours * 3_600_000_000).cast("bigint"))


def statistics(states: DataFrame) -> DataFrame:
    """Counts and shares of each state; shares of nothing are 0."""
    names = ("active", "consolidated", "archived", "forgotten")
    total = F.count("*")
    counts = [F.count_if(F.col("state") == s).alias(s) for s in names]
    shares = [F.round(F.coalesce(F.count_if(F.col("state") == s) / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias(f"{s}_ratio") for s in names]
    return states.agg(total.alias("total"), *counts, *shares)
