"""Reciprocal rank fusion and the hybrid search pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """`qid`, `id`, `score`: each ranking (`qid`, `id`, `rank` from 1) adds 1 / (k + rank)."""
    union = rankings[0].select("qid", "id", "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select("qid", "id", "rank"))
    return union.groupBy("qid", "id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 6).alias("score"))


def prefix(scored: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def fused(rankings: list[DataFrame], nodes: DataFrame, k: int, min_confidence: float = 0.0, pre: Column | None = None, post: Column | None = None) -> DataFrame:
    """Rankings fused, the first 2k joined to existing nodes, filtered and cut to k.

    pre filters nodes before the prefix is taken; post afterwards, so it may return fewer than k.
    """
    scored = rrf(rankings)
    if pre is not None:
        scored = scored.join(nodes.where(pre).select("id"), "id", "left_semi")
    first = prefix(scored, 2 * k).drop("rank").join(nodes, "id").where(F.col("confidence") >= min_confidence)
    out = prefix(first, k)
    return out if post is None else out.where(post)


def reranked(fused_rows: DataFrame, scores: DataFrame, window: int, k: int) -> DataFrame:
    """The first `window` rows of each query take their rerank scores, all sort together, k stay."""
    first = prefix(fused_rows, 2**31 - 1).withColumnRenamed("rank", "at")
    joined = first.join(scores.select("qid", "id", F.col("score").alias("again")), ["qid", "id"], "left")
    merged = joined.withColumn("score", F.when((F.col("at") <= window) & F.col("again").isNotNull(), F.col("again")).otherwise(F.col("score")))
    return prefix(merged.drop("at", "again"), k)
