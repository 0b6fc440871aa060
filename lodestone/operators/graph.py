"""Graph traversal over an edge table, as joins.

Each hop joins the frontier to the edges; what it reaches is written to the shared folder. Paths take
links that are made once, dealt by where they begin. An ordered depth-first walk is given as its set, which is `bfs` within the depth.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut

#: Seed sets whose factors are broadcast.
FEW = 100_000


def either_way(edges: DataFrame) -> DataFrame:
    """`from`, `to`: each edge in both directions; equal ones stay as often as they are."""
    ends = F.array(*[F.struct(F.col(a).alias("from"), F.col(b).alias("to")) for a, b in (("source", "target"), ("target", "source"))])
    return edges.select(F.inline(ends))


def both_ways(edges: DataFrame) -> DataFrame:
    return either_way(edges).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """`seed`, `id`, `depth`: everything within so many undirected hops of each seed; seeds: (`seed`).

    A hop looks the frontier up among the edges as they are: each is read, none is sorted or kept
    unless the frontier is too large to broadcast.
    """
    links = either_way(edges)
    seen = frontier = cut(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).cast("bigint").alias("depth")))
    for hop in range(1, depth + 1):
        reached = frontier.join(links, frontier["id"] == links["from"]).select("seed", F.col("to").alias("id")).distinct()
        frontier = cut(reached.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(hop).cast("bigint")))
        seen = seen.unionByName(frontier)
    return seen


def subgraph_edges(edges: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """`seed` and the distinct edges with an end nearer than the depth."""
    inner = seen.where(F.col("depth") < depth).select("seed", "id")
    columns = ["seed", "id", "edge_type", "source", "target", "weight"]
    named = edges.withColumnRenamed("id", "edge_id")
    by_source = inner.join(named, F.col("id") == F.col("source")).drop("id")
    by_target = inner.join(named, F.col("id") == F.col("target")).drop("id")
    return by_source.unionByName(by_target).withColumnRenamed("edge_id", "id").select(columns).distinct()


def shortest_path(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """`from_id`, `to_id`, `path`, `hops`: the shortest undirected path, the least one on ties; pairs: (`from_id`, `to_id`)."""
    links = cut(both_ways(edges).repartition("from"))
    reached = frontier = pairs.select("from_id").distinct().select("from_id", F.col("from_id").alias("id"), F.array("from_id").alias("path"))
    for _ in range(max_depth):
        onward = frontier.join(links, frontier["id"] == links["from"]).select("from_id", F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"))
        nearest = onward.groupBy("from_id", "id").agg(F.min("path").alias("path"))
        frontier = cut(nearest.join(reached, ["from_id", "id"], "left_anti"))
        reached = reached.unionByName(frontier)
    found = pairs.join(reached.withColumnRenamed("id", "to_id"), ["from_id", "to_id"])
    return found.select("from_id", "to_id", "path", (F.size("path") - 1).cast("bigint").alias("hops"))


def pagerank(edges: DataFrame, seeds: DataFrame, walk_prob: float = 0.15, iterations: int = 10) -> DataFrame:
    """`seed_set`, `id`, `score`: personalised rank of each seed set; seeds: (`seed_set`, `seed`).

    Each round walks along weighted edges with walk_prob and returns to the seeds with the
    rest, then scores are normalised; what has no way out is dropped before that. All rounds are
    linear in what lies so many steps from the seeds, so each number of steps is walked once, from
    what the one before reached, and the rounds are made of these parts (`shares`).
    """
    seeds = seeds.distinct()
    share = seeds.join(seeds.groupBy("seed_set").agg(F.count("*").alias("n")), "seed_set").select("seed_set", F.col("seed").alias("id"), (1 / F.col("n")).alias("score"))
    total = F.sum("weight").over(W.partitionBy("source"))
    steps = cut(edges.select("source", "target", (F.col("weight") / total).alias("p")))
    few = seeds.select("seed_set").distinct().limit(FEW + 1).count() <= FEW
    parts = [cut(share)]
    for _ in range(iterations):
        walked = parts[-1].join(steps, parts[-1]["id"] == steps["source"]).select("seed_set", F.col("target").alias("id"), (F.col("score") * F.col("p")).alias("score"))
        parts.append(cut(walked.groupBy("seed_set", "id").agg(F.sum("score").alias("score"))))
    every = functools.reduce(DataFrame.unionByName, [part.withColumn("steps", F.lit(n)) for n, part in enumerate(parts)])
    mass = every.groupBy("seed_set", "steps").agg(F.sum("score").alias("mass")).groupBy("seed_set").agg(F.collect_list(F.struct("steps", "mass")).alias("masses"))
    factors = mass.mapInArrow(functools.partial(shares, walk_prob=walk_prob, iterations=iterations), T.StructType([seeds.schema["seed_set"], T.StructField("factors", T.ArrayType(T.DoubleType()))]))
    weighed = every.join(F.broadcast(factors) if few else factors, "seed_set")
    return weighed.groupBy("seed_set", "id").agg(F.sum(F.col("score") * F.col("factors")[F.col("steps")]).alias("score"))


def shares(batches: Iterator[pa.RecordBatch], walk_prob: float, iterations: int) -> Iterator[pa.RecordBatch]:
    """`seed_set`, `factors`: of what lies 0, 1, ... steps away, in the last round's scores, from its sums (`masses`)."""
    for batch in batches:
        out = []
        for masses in batch.column(1).to_pylist():
            mass = dict.fromkeys(range(iterations + 1), 0.0) | {m["steps"]: m["mass"] for m in masses}
            factors = [1.0]
            for _ in range(iterations):
                factors = [1 - walk_prob, *[f * walk_prob for f in factors]]
                total = sum(f * mass[n] for n, f in enumerate(factors))
                factors = [f / total for f in factors]
            out.append(factors)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["seed_set", "factors"])


def ranked_near(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """`qid`, `id`, `rank`: what lies near the seeds (`qid`, `seed`, `seed_rank`), by seed's rank, depth and id, each node once."""
    near = bfs(edges, seeds.select("seed").distinct(), hops).join(seeds, "seed")
    first = near.groupBy("qid", "id").agg(F.min(F.struct("seed_rank", "depth")).alias("at"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("at", "id")).cast("bigint")).select("qid", "id", "rank")
