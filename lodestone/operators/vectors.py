"""Vector search: exact cosine, sign codes with Hamming distance, two-stage rescoring, recall.

Queries are a table. They go over the vectors in broadcast blocks of at most BLOCK; each
vector is read once a block, tasks multiply blocks of both as matrices, and only the k best of each
query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.vector import cosine, hamming, norm, normalized, sign_code

#: Queries of one broadcast.
BLOCK = 4096
#: Vectors that a task multiplies with a block at a time.
ROWS = 1024


def with_norm(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("norm", norm(F.col("v")))


def with_code(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("code", sign_code(F.col("v")))


def of_dimension(vectors: DataFrame, dims: int) -> DataFrame:
    """Raises where a vector has another length, as an index of fixed dimension does."""
    fits = F.when(F.size("v") == dims, F.col("v")).otherwise(F.raise_error(F.concat(F.lit(f"expected {dims} dimensions, got "), F.size("v").cast("string"))))
    return vectors.withColumn("v", fits)


def latest(versions: DataFrame, key: str, order: Column) -> DataFrame:
    """Upserts: the last version of each key."""
    columns = F.struct(*[F.col(c) for c in versions.columns])
    return versions.groupBy(key).agg(F.max_by(columns, order).alias("last")).select("last.*")


def ranked(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    w = W.partitionBy("qid").orderBy(*order, "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts of bounded size, by hash."""
    n = queries.count()
    parts = -(-n // BLOCK) or 1
    return [queries] if parts == 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(2 * parts)) == i) for i in range(2 * parts)]


def scored(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """`qid`, `id`, `score` of every vector for a few queries; no ranking, so no shuffle."""
    asked = F.broadcast(query.select("qid", "q", norm(F.col("q")).alias("q_norm")))
    score = F.round(cosine(F.col("v"), F.col("q"), F.col("norm"), F.col("q_norm")), 6)
    return with_norm(vectors).select("id", "v", "norm").join(asked).select("qid", "id", score.alias("score"))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Best:
    """The k best rows (scores, ids) of each of n queries, by the query's place."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.rows = k, np.full(n, -np.inf), {}

    def add(self, places: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (lines) for some rows (columns); only what may be among the best is looked at."""
        for line in np.flatnonzero(scores.max(axis=1) >= self.least[places]) if len(ids) else ():
            place, row = int(places[line]), scores[line]
            some = np.flatnonzero(row >= self.least[place])
            row, mine = row[some], ids[some]
            if place in self.rows:
                row, mine = np.concatenate([self.rows[place][0], row]), np.concatenate([self.rows[place][1], mine])
            top = best_of(row, mine, self.k)
            self.rows[place] = row[top], mine[top]
            if len(top) == self.k:
                self.least[place] = row[top[-1]]

    def batches(self, qids: list, dims: dict[int, int]) -> Iterator[pa.RecordBatch]:
        for place, (scores, ids) in self.rows.items():
            columns = [pa.array([qids[place]] * len(ids)), pa.array(ids.tolist()), pa.array(scores, pa.float64()), pa.array([dims[place]] * len(ids), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "id", "score", "dims"])


def by_length(rows: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows whose list has one length, and the lists as a matrix; null and empty lists take no part."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(rows.column(column)), -1))
    for size in np.unique(lengths[lengths > 0]).tolist():
        chosen = rows.take(pa.array(np.flatnonzero(lengths == size)))
        yield size, chosen, chosen.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each line of one matrix with each of the other; 0 where a norm vanishes."""
    length = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
    return np.where(length < 1e-10, 0.0, (q @ v.T) / np.maximum(length, 1e-300))


def asked_by_length(queries: DataFrame) -> tuple[list, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids of a block of queries (`qid`, `q`), and by length of the list their places and a matrix."""
    rows = queries.select("qid", "q").where("q IS NOT NULL").collect()  # a block's rows
    places: dict[int, list[int]] = {}
    for place, r in enumerate(rows):
        places.setdefault(len(r["q"]), []).append(place)
    return [r["qid"] for r in rows], {size: (np.array(mine), np.array([rows[p]["q"] for p in mine])) for size, mine in places.items() if size}


def dealt(vectors: DataFrame) -> DataFrame:
    """Vectors dealt out by id: each costs a product with every query, however few files hold them."""
    return vectors.where("id IS NOT NULL").repartition("id")


def best_rows(stored: DataFrame, queries: DataFrame, k: int, scores_of: Callable) -> DataFrame:
    """`qid`, `id`, `score`, `dims` (the lists' length): the k best of each query and task, in broadcast blocks of queries.

    stored has `id` and a list; `scores_of(queries, lists)`, with places and lists of queries, yields places,
    their scores and the ids these are of. Tasks send on k rows of a query, so what is shuffled
    and sorted does not grow with the pairs.
    """
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", stored.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("dims", T.IntegerType())])
    out = None
    for part in blocks(queries):
        shared = stored.sparkSession.sparkContext.broadcast(asked_by_length(part.select("qid", "q")))

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            qids, sides = shared.value
            best = Best(len(qids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    for size, rows, lists in by_length(batch.slice(at, ROWS), 1):
                        if size in sides:
                            ids = np.array(rows.column(0).to_pylist(), object)
                            for places, scores, some in scores_of(sides[size], lists):
                                best.add(places, scores, ids[some])
            yield from best.batches(qids, {p: size for size, (mine, _) in sides.items() for p in mine.tolist()})

        found = stored.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`qid`, `id`, `score`, `rank`: cosine top-k of each query (`qid`, `q`); zero norms score 0.

    Queries go in broadcast blocks; a task multiplies its vectors with a block as matrices. Vectors
    of another length than a query's do not meet it.
    """

    def scores_of(side: tuple[np.ndarray, np.ndarray], v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
        yield side[0], cosines(side[1].astype(float), v.astype(float)).round(6) + 0.0, slice(None)

    return ranked(best_rows(dealt(vectors.select("id", "v")), queries, k, scores_of).drop("dims"), k, F.desc("score"))


def hamming_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`qid`, `id`, `distance`, `similarity`, `rank` by sign codes; vectors of another length than a query's do not meet it."""

    def words(v: np.ndarray) -> np.ndarray:
        codes = np.packbits(v > 0, axis=1, bitorder="little")
        return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)

    def scores_of(side: tuple[np.ndarray, np.ndarray], v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
        mine, theirs = words(side[1]), words(v)
        yield side[0], -sum(np.bitwise_count(mine[:, i, None] ^ theirs[None, :, i]).astype(float) for i in range(mine.shape[1])), slice(None)

    found = best_rows(dealt(vectors.select("id", "v")), queries, k, scores_of)
    near = ranked(found.select("qid", "id", "dims", (-F.col("score")).cast("bigint").alias("distance")), k, F.col("distance"))
    return near.select("qid", "id", "distance", F.round(1 - F.col("distance") / F.col("dims"), 6).alias("similarity"), "rank")


def rescored_top_k(vectors: DataFrame, queries: DataFrame, k: int, factor: int = 20, candidates: int | None = None) -> DataFrame:
    """Hamming candidates (k * factor, or a number of their own), then exact cosine among them."""
    near = hamming_top_k(vectors, queries, candidates or k * factor).select("qid", "id")
    pairs = near.join(with_norm(vectors).select("id", "v", "norm"), "id").join(queries.select("qid", "q"), "qid")
    score = F.round(cosine(F.col("v"), F.col("q"), F.col("norm"), norm(F.col("q"))), 6)
    return ranked(pairs.select("qid", "id", score.alias("score")), k, F.desc("score"))


def recall(truth: DataFrame, got: DataFrame, k: int) -> DataFrame:
    """`qid`, `recall`: share of the true top-k that was found."""
    hit = truth.select("qid", "id").join(got.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.groupBy("qid").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.lit(k), 6).alias("recall"))


def index_sizes(vectors: DataFrame) -> DataFrame:
    """Number of vectors and bytes of each form of index."""
    dims = F.size("v").cast("bigint")
    return vectors.agg(
        F.count("*").alias("n"),
        F.sum(dims * 4).alias("f32_bytes"),
        F.sum(dims).alias("i8_bytes"),
        F.sum(F.ceil(dims / 8)).alias("code_bytes"),
        (F.count("*") * 4).alias("norm_bytes"),
    )


def ivf_top_k(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 32, share: float = 0.82) -> DataFrame:
    """Approximate top-k: every vector lies in the cell of its nearest centre, a query looks into its nearest `share` of the cells.

    Centres are a bounded sample (`cells` vectors, by hash); every vector is indexed, those of a
    length that no centre has in one cell. Where vectors have no structure, recall is little more
    than the share; where they have, a smaller share does. In a task the vectors of a cell are
    multiplied with the queries that look into it.
    """
    stored = with_norm(vectors).where("norm > 0").select("id", "v")
    chosen = stored.orderBy(F.xxhash64("id"), "id").limit(cells).select(normalized(F.col("v")).alias("c")).collect()
    centres = [np.array(r["c"], float) for r in chosen]
    look = max(1, round(share * cells))

    def nearness(v: np.ndarray) -> np.ndarray:
        return v @ np.array([c for c in centres if len(c) == v.shape[1]] or [np.zeros(v.shape[1])]).T

    def scores_of(side: tuple[np.ndarray, np.ndarray], v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        places, q = side[0], side[1].astype(float)
        v = v.astype(float)
        cell = nearness(v).argmax(axis=1)
        looks = np.argsort(-nearness(q), axis=1, kind="stable")[:, :look]
        for c in np.unique(cell):
            some, mine = np.flatnonzero(cell == c), np.flatnonzero((looks == c).any(axis=1))
            if len(mine):
                yield places[mine], cosines(q[mine], v[some]).round(6) + 0.0, some

    return ranked(best_rows(dealt(stored), queries, k, scores_of).drop("dims"), k, F.desc("score"))


def distances(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """`qid`, `id`, `distance`: Hamming distances of all sign codes to a few queries; no ranking."""
    asked = F.broadcast(query.select("qid", sign_code(F.col("q")).alias("q_code")))
    return with_code(vectors).join(asked).select("qid", "id", hamming(F.col("code"), F.col("q_code")).alias("distance"))
