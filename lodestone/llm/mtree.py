"""Exact top-k inner-product search (operator 10) over an M-tree of paged nodes.

Vectors are turned to integers, floor(256 x) for each component x as double. For each query
the 5 other vectors of largest inner product are found exactly, ties to the smaller id.

The tree has three levels. Routing objects of the top level are chosen from a bounded sample
(at most `sample` vectors, by hash of the id), the more the more rows there are; every vector is
indexed under its nearest one. A node's rows are dealt to pages of at most `page` vectors, in as many
parts as its size asks for; a page is a node with a routing object of its own (one of its
vectors), a covering radius and each entry's distance to it. Equal vectors, however many, fill as
many pages as they need.

The triangle inequality bounds scores: with r the routing object of a node of radius R,
q.x <= q.r + |q| R for all x under it, and q.x <= q.r + |q| d(x, r) for an entry by its stored
distance, so most entries and nodes are dismissed without a product. Distances are rounded up
where they bound, so nothing is lost to rounding.

1. Each query goes to the top node with the best bound and is answered there: its last score
   is a floor. 2. A block of queries goes on only to those top nodes whose bound reaches the
   floor of one of them. It meets the node's list of pages (routing objects and radii alone) first and
   then those pages whose bound reaches a floor, best bound first, each page by the queries it can still
   improve; floors rise on the way. 3. Results meet by query; each task sends on the best
   few of each block, and Spark limits them again before the shuffle.

Queries travel in blocks of at most `block`, grouped by their top node and a salt; a block meets
a part of a node's pages in one task (`group` pages), so neither a node nor a query set of any size
comes together. Vectors that are null, or hold null or non-finite components, take no part,
as queries and as candidates. Vectors of each length are indexed apart, and a query meets those of
its own. Scores are exact: products of integers below 2^53 are exact as doubles, and a vector
whose square is larger is refused with an error. Rows that repeat an id are rows of their own: a query
skips one row, its own, and an id is asked once per distinct vector; a null id asks and is found
nowhere. An empty table gives an empty one; only `vec_id` and the vectors are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrays import arrow_rows, pieces_of
from lodestone.llm.common import cut, table

K, EVERY = 5, 50
SAMPLE, NODES, PAGE, GROUP, BLOCK, SALTS = 4096, 1024, 512, 16, 512, 8
#: Pages of one list of a node, and squares from which sums are not exact.
LISTED, EXACT = 256, 2.0**53


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """`id`, `v`: integer vectors without null or non-finite components."""
    v = F.col(column)
    wide = F.transform(v, lambda x: x.cast("double"))
    sound = v.isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform(wide, lambda x: F.floor(x * 256).cast("double")).alias("v"), sound.alias("sound")).where(
        "sound and id is not null"
    ).select("id", "v")


def routing_objects(found: DataFrame, size: int, sample: int = SAMPLE, nodes: int = NODES) -> np.ndarray:
    """Vectors of a bounded sample, each the farthest from those chosen before it."""
    rows = found.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    pool = np.array([r["v"] for r in rows], float).reshape(-1, size)
    chosen, far = [0], np.full(len(pool), np.inf)
    while len(chosen) < nodes:
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return pool[chosen]


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of rows, rounded up: integer squares are exact, the root is not."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.nextafter(np.sqrt(np.maximum(squares, 0)), np.inf)


def norms(a: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt((a * a).sum(axis=1)), np.inf)


def dealt(found: DataFrame, routes: Broadcast) -> DataFrame:
    """`id`, `v` and the nearest top node with the distance to it."""
    schema = T.StructType(found.schema.fields + [T.StructField("node", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = routes.value
        for batch in (piece for whole in batches for piece in pieces_of(whole, 2048)):
            if batch.num_rows:
                away = distances(matrix(batch.column(1), centres.shape[1]), centres)
                node = away.argmin(axis=1)
                columns = [*batch.columns, pa.array(node.astype(np.int32)), pa.array(away.min(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(run, schema)


def pages_of(placed: DataFrame, page: int = PAGE, group: int = GROUP) -> DataFrame:
    """Nodes of the lowest level: `node`, `grp`, `radius`, `ids`, `vectors`, `away` as packed numbers.

    The first entry is the page's routing object; entries are sorted by their distance to it.
    """
    types = {"node": pa.int32(), "grp": pa.int64(), "radius": pa.float64(), "ids": pa.binary(), "vectors": pa.binary(), "away": pa.binary()}

    def packed(node: int, ids: np.ndarray, vectors: np.ndarray) -> tuple:
        away = distances(vectors, vectors[:1])[:, 0]
        away[0] = 0.0
        order = np.argsort(away, kind="stable")
        ids, vectors, away = ids[order], vectors[order], away[order]
        return node, 0, float(away[-1]), ids.astype(np.int64).tobytes(), vectors.astype(np.float64).tobytes(), away.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, vectors, made = None, [], [], 0
        for batch in (piece for whole in batches for piece in pieces_of(whole, 2048)):
            out = []
            for i, v, n in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()):
                if ids and (n != node or len(ids) == page):
                    out.append(packed(node, np.array(ids), np.array(vectors)))
                    ids, vectors = [], []
                node = n
                ids.append(i)
                vectors.append(v)
            yield arrow_rows(out, types)
        yield arrow_rows([packed(node, np.array(ids), np.array(vectors))] if ids else [], types)

    # A node's rows are spread by id over as many parts as it needs, then lie near each other by distance.
    sizes = placed.groupBy("node").agg(F.ceil(F.count("*") / (2 * page)).alias("parts"))  # one row a node
    spread = placed.join(F.broadcast(sizes), "node").select("id", "v", "node", "away", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    spread = spread.repartition("node", "part").sortWithinPartitions("node", "part", "away", "id")
    pages = spread.select("id", "v", "node").mapInArrow(run, "node int, grp long, radius double, ids binary, vectors binary, away binary")
    return pages.withColumn("grp", F.xxhash64("ids"))


def page_lists(pages: DataFrame, size: int) -> DataFrame:
    """`node`, `list`: (grp, radius, centre) of at most about LISTED pages of a node."""
    each = pages.select("node", "grp", "radius", F.substring("vectors", 1, 8 * size).alias("centre"))
    parts = F.ceil(F.count("*").over(W.partitionBy("node")) / LISTED)
    return each.withColumn("part", F.pmod(F.xxhash64("grp"), parts)).groupBy("node", "part").agg(F.collect_list(F.struct("grp", "radius", "centre")).alias("list")).drop("part")


def reached(blocks: DataFrame, lists: DataFrame, size: int) -> DataFrame:
    """Blocks with the pages (`grps`) of their node whose bound reaches the floor of one of their queries."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("grps", T.ArrayType(T.LongType()))])
    columns = blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole, 16)):
            kept, grps = [], []
            for at in range(batch.num_rows):
                queries = np.frombuffer(batch.column(columns.index("queries"))[at].as_py()).reshape(-1, size)
                floors = np.frombuffer(batch.column(columns.index("floors"))[at].as_py())
                pages = batch.column(len(columns))[at].as_py()
                centres = np.array([np.frombuffer(p["centre"]) for p in pages])
                bounds = queries @ centres.T + norms(queries)[:, None] * np.array([p["radius"] for p in pages])[None, :]
                near = [p["grp"] for p, on in zip(pages, (bounds >= floors[:, None]).any(axis=0)) if on]
                if near:
                    kept.append(at)
                    grps.append(near)
            chosen = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns[: len(columns)], pa.array(grps, pa.list_(pa.int64()))], names=schema.names)

    return blocks.join(lists, "node").select(*columns, "list").mapInArrow(run, schema)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def search(queries: np.ndarray, floors: np.ndarray, pages: list[tuple], k: int) -> list[tuple[int, int, int]]:
    """(place of the query, id, score): the k best entries of these pages for each query of a block.

    pages: routing object, radius, ids, vectors, stored distances. Floors are scores that k
    other rows are known to reach.
    """
    length, n = norms(queries), len(queries)
    centres = np.array([p[0] for p in pages])
    to_centre = queries @ centres.T
    bounds = to_centre + length[:, None] * np.array([p[1] for p in pages])[None, :]
    kept_scores, kept_ids = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
    floors = floors.copy()
    for p in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
        active = np.flatnonzero(bounds[:, p] >= floors)
        if not len(active):
            continue
        _, _, ids, vectors, away = pages[p]
        # An entry counts for a query if its stored distance lets it reach the floor; entries are sorted by it.
        least = ((floors[active] - to_centre[active, p]) / np.maximum(length[active], 1e-300)).min()
        begin = int(np.searchsorted(away, least * (1 - 1e-12) - 1e-9)) if least > 0 else 0
        if begin == len(ids):
            continue
        scores = queries[active] @ vectors[begin:].T
        reach = np.flatnonzero(scores.max(axis=1) >= floors[active])
        for row in reach.tolist():
            q = active[row]
            some = np.flatnonzero(scores[row] >= max(floors[q], -1e300))
            all_scores = np.concatenate([kept_scores[q], scores[row][some]])
            all_ids = np.concatenate([kept_ids[q], ids[begin:][some]])
            top = best(all_scores, all_ids, k)
            kept_scores[q], kept_ids[q] = all_scores[top], all_ids[top]
            floors[q] = max(floors[q], kept_scores[q, -1])
    return [(q, int(kept_ids[q, j]), int(kept_scores[q, j])) for q in range(n) for j in range(k) if kept_scores[q, j] > -np.inf]


RESULT = {"query_id": pa.int64(), "qkey": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "own": pa.bool_()}
RESULT_SCHEMA = "query_id long, qkey long, vec_id long, score long, own boolean"


def visits(blocks: DataFrame, pages: DataFrame, lists: DataFrame, size: int, k: int, group: int = GROUP) -> DataFrame:
    """Results of each block of queries in each group of pages of its node, `own` where the row may be the query's.

    blocks: `node`, `bid`, `qids`, `qkeys`, `queries`, `floors` (packed). Pages that a block cannot use
    are left out of the join; a task gets rows of a page with a block.
    """
    near = reached(blocks, lists, size).alias("b")
    joined = near.join(pages.alias("p"), (F.col("b.node") == F.col("p.node")) & F.array_contains("b.grps", F.col("p.grp")))
    joined = joined.select("bid", "qids", "qkeys", "queries", "floors", "ids", "vectors", "away", "radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = None, [], None

        def done() -> list[tuple]:
            qids, qkeys, queries, floors = block
            out = []
            for q, i, s in search(queries, floors, held, k):
                own = False
                if i == qids[q]:  # the query's own row, or another one of its id
                    own = any((p[3][p[2] == i] == queries[q]).all(axis=1).any() for p in held if (p[2] == i).any())
                out.append((int(qids[q]), int(qkeys[q]), i, s, own))
            return out

        for batch in (piece for whole in batches for piece in pieces_of(whole, 8)):
            out = []
            for bid, qids, qkeys, queries, floors, ids, vectors, away, radius in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (bid != last or len(held) == group):
                    out += done()
                    held = []
                if bid != last:
                    block = np.frombuffer(qids, np.int64), np.frombuffer(qkeys, np.int64), np.frombuffer(queries).reshape(-1, size), np.frombuffer(floors)
                last = bid
                v = np.frombuffer(vectors).reshape(-1, size)
                held.append((v[0], radius, np.frombuffer(ids, np.int64), v, np.frombuffer(away)))
            yield arrow_rows(out, RESULT)
        yield arrow_rows(done() if held else [], RESULT)

    return joined.mapInArrow(run, RESULT_SCHEMA)


def blocks_of(asked: DataFrame, size: int) -> DataFrame:
    """Packed blocks of at most BLOCK queries of one node; asked: `node`, `id`, `qkey`, `v`, `floor`."""
    types = {"node": pa.int32(), "bid": pa.string(), "qids": pa.binary(), "qkeys": pa.binary(), "queries": pa.binary(), "floors": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, rows = None, []

        def packed() -> tuple:
            ids, keys, floors = (np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, np.int64), (3, np.float64)))
            return node, f"{node}-{keys[0]}-{keys[-1]}-{len(keys)}", ids.tobytes(), keys.tobytes(), np.array([r[2] for r in rows], np.float64).tobytes(), floors.tobytes()

        for batch in (piece for whole in batches for piece in pieces_of(whole, 1024)):
            out = []
            for n, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (n != node or len(rows) == BLOCK):
                    out.append(packed())
                    rows = []
                node = n
                rows.append(row)
            yield arrow_rows(out, types)
        yield arrow_rows([packed()] if rows else [], types)

    dealt_out = asked.select("node", "id", "qkey", "v", "floor").repartition("node", F.pmod(F.col("qkey"), F.lit(SALTS))).sortWithinPartitions("node", "qkey")
    return dealt_out.mapInArrow(run, "node int, bid string, qids binary, qkeys binary, queries binary, floors binary")


def top_of(results: DataFrame, k: int) -> DataFrame:
    """The k best results of each query with their `place` (from 1); few of a task's rows are shuffled."""
    w = W.partitionBy("qkey").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def exact_top_k(vectors: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE, nodes: int = NODES, page: int = PAGE) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` for the rows whose id is divisible by `every`."""
    found = cut(usable(vectors))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    lengths = found.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()  # one row a length
    if any(r["square"] >= EXACT for r in lengths):
        raise OverflowError("vectors whose integer squares reach 2^53 cannot be scored exactly")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for r in sorted(lengths):
        if r["size"]:
            wanted = min(nodes, max(16, round(4 * (r["n"] / page) ** 0.5)))
            out = out.unionByName(_of_length(found.where(F.size("v") == r["size"]), r["size"], k, every, sample, wanted, page))
    return out


def _of_length(found: DataFrame, size: int, k: int, every: int, sample: int, nodes: int, page: int) -> DataFrame:
    """The search among vectors of one length. One result more than k is kept until the query's own row is left out."""
    spark, more = found.sparkSession, k + 1
    centres = routing_objects(found, size, sample, nodes)
    routes = spark.sparkContext.broadcast(centres)
    placed = cut(dealt(found, routes))
    pages = cut(pages_of(placed, page))
    lists = cut(page_lists(pages, size))
    radii = {r["node"]: r["radius"] for r in placed.groupBy("node").agg(F.max("away").alias("radius")).collect()}
    reach = spark.sparkContext.broadcast(np.array([radii.get(n, -np.inf) for n in range(len(centres))]))
    queries = placed.where(F.col("id") % every == 0).select("id", F.xxhash64("id", "v").alias("qkey"), "v").distinct()

    def bounded(batch: pa.RecordBatch) -> np.ndarray:
        q, c = matrix(batch.column(2), size), routes.value
        return q @ c.T + norms(q)[:, None] * reach.value[None, :]

    asked_schema = "node int, id long, qkey long, v array<double>, floor double"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            if batch.num_rows:
                node = bounded(batch).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node), *batch.columns, pa.array(np.full(batch.num_rows, -1e300))], names=["node", "id", "qkey", "v", "floor"])

    seeds = cut(top_of(visits(blocks_of(queries.mapInArrow(first, asked_schema), size), pages, lists, size, more), more))
    floors = seeds.groupBy("qkey").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= more)
    waiting = queries.join(floors, "qkey", "left").select("id", "qkey", "v", F.coalesce("floor", F.lit(-1e300)).alias("floor"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            if batch.num_rows:
                bounds = bounded(batch)
                bounds[np.arange(len(bounds)), bounds.argmax(axis=1)] = -np.inf  # answered already
                rows, node = np.nonzero((bounds >= batch.column(3).to_numpy()[:, None]) & (bounds > -np.inf))
                columns = [c.take(pa.array(rows)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), *columns], names=["node", "id", "qkey", "v", "floor"])

    rest = visits(blocks_of(waiting.mapInArrow(others, asked_schema), size), pages, lists, size, more)
    top = top_of(seeds.drop("place").unionByName(rest), more)
    # One row that may be the query's own goes: of rows that are equal it does not matter which.
    mine = F.min(F.when(F.col("own"), F.col("place"))).over(W.partitionBy("qkey"))
    left = top.withColumn("mine", mine).where("mine IS NULL OR place <> mine")
    rank = F.when(F.col("place") > F.coalesce("mine", F.lit(2**31 - 1)), F.col("place") - 1).otherwise(F.col("place"))
    return left.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op10_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
