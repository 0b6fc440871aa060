"""One handle on a knowledge base whose tables are Parquet folders.

Each write adds parts to several tables under one new version (`lodestone.versions`), so a job that
is lost half-way leaves the last version as it was; old rows are not rewritten. Texts are tokenised
once, when they are added: searches read stored postings of their terms and no text.
Every method that stamps a time takes it as `now`; the current time is only its default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import node_type, tokens, utf8_prefix
from lodestone.operators import chunks, fts, fusion, graph, store, vectors
from lodestone.sources import files, pages
from lodestone.versions import Versions

SCHEMAS = {
    "nodes": "id string, node_type string, body string, tags array<string>, confidence double, tx_time timestamp, valid_time timestamp, metadata string",
    "edges": "id string, edge_type string, source string, target string, weight double, tx_time timestamp, metadata string",
    "deltas": "node_id string, ts timestamp, seq bigint, op string, body string, confidence double, valid_time timestamp",
    "vectors": "id string, v array<double>",
    "postings": fts.STORED,
    "lengths": fts.LENGTHS,
    "objects": "object_id string, data binary",
    "kv": "key string, value binary",
    "clusters": "id string, name string, members array<string>",
    "provenance": "node_id string, supports array<string>",
}
KEYS = {"nodes": "id", "edges": "id", "vectors": "id", "postings": "id", "lengths": "id", "objects": "object_id", "kv": "key", "clusters": "id", "provenance": "node_id"}


#: Terms of a search that go into the scan's filter.
FEW = 1000


class NodeNotFound(KeyError):
    """No node has this id."""


def hashed_vectors(rows: DataFrame, column: str, dims: int) -> DataFrame:
    """A deterministic stand-in for an embedding model: tokens hashed to signed dimensions."""
    each = rows.select("id", F.explode(tokens(F.col(column))).alias("t"))
    spot = F.pmod(F.xxhash64("t"), F.lit(dims)).cast("int")
    sign = F.when(F.pmod(F.xxhash64(F.lit(1), "t"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = each.groupBy("id", spot.alias("d")).agg(F.sum(sign).alias("x"))
    filled = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return filled.select("id", v.alias("v"))


@dataclass
class KnowledgeBase:
    spark: SparkSession
    path: str
    dims: int = 384
    embed: object = field(default=hashed_vectors)

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.path, SCHEMAS, KEYS)

    def table(self, name: str, where: str = "true") -> DataFrame:
        """The current version of a table; empty if there is none yet."""
        return self.versions.read(name, where)

    def write(self, **put: DataFrame) -> None:
        """Rows of any tables, in place of those of their keys, in one version."""
        self.versions.write(put)

    def _landed(self, rows: DataFrame) -> DataFrame:
        """Rows as they are written, so that ids and times are drawn once."""
        import uuid

        folder = f"{self.path}/_landing/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _vectors_of(self, rows: DataFrame) -> DataFrame:
        """Vectors of nodes, from the first bytes of their text."""
        return self.embed(rows.select("id", utf8_prefix(F.col("body"), chunks.EMBEDDED).alias("body")), "body", self.dims)

    def add(self, rows: DataFrame, project: str | None = None, now: Column | None = None) -> None:
        """Nodes with `body` and any other node column: upserted, logged, indexed and embedded in bulk.

        Of rows that share an id the one with the last tx_time stays, then the greater text.
        """
        now = F.current_timestamp() if now is None else now
        made = {
            "id": F.uuid(),
            "node_type": F.lit("fact"),
            "tags": F.array().cast("array<string>"),
            "confidence": F.lit(1.0),
            "tx_time": now,
            "valid_time": F.lit(None).cast("timestamp"),
            "metadata": F.lit(None).cast("string"),
        }
        for name, value in made.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, value)
        rows = rows.withColumn("node_type", node_type(F.col("node_type"))).withColumn("__now", now)
        if project:
            rows = rows.withColumn("tags", F.array_union("tags", F.array(F.lit(f"project:{project}"))))
        columns = self.spark.createDataFrame([], SCHEMAS["nodes"]).columns
        new = self._landed(store.last_of(self._landed(rows.select(*columns, "__now")), "id", F.struct("tx_time", "body")))
        log = new.select(F.col("id").alias("node_id"), F.col("__now").alias("ts"), F.unix_micros("__now").alias("seq"), F.lit("insert").alias("op"), "body", "confidence", "valid_time")
        indexed = fts.field_tokens(new, fts.body_and_tags())
        vectors_of = self._vectors_of(new)
        # Nodes without a word or vector still take the place of what they had.
        all_ids = {name: new.select("id") for name in ("postings", "lengths", "vectors")}
        self.versions.write({"nodes": new, "deltas": log, "vectors": vectors_of, "postings": fts.stored_postings(indexed), "lengths": fts.lengths(indexed)}, all_ids)

    def add_files(self, folder: str, project: str | None = None, capped: bool = True) -> None:
        """The wanted text files under a folder as nodes; without the cap large files too."""
        found = files.read_files(self.spark, folder)
        self.add(files.as_nodes(found, project, capped))

    def ingest(self, web_pages: DataFrame, project: str | None = None, now: Column | None = None) -> None:
        """Web pages (`url`, `html`) as nodes named by their URL."""
        self.add(pages.as_nodes(pages.read(web_pages), project), now=now)

    def relate(self, source: str, edge_type: str, target: str, weight: float = 1.0, now: Column | None = None) -> None:
        """One edge; `relate_all` takes any number."""
        row = self.spark.createDataFrame([(edge_type, source, target, float(weight))], "edge_type string, source string, target string, weight double")
        self.relate_all(row, now)

    def relate_all(self, edges: DataFrame, now: Column | None = None) -> None:
        """Edges (`source`, `edge_type`, `target`, and `weight`, `metadata` if there are any) upserted by what they join."""
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        if "metadata" not in edges.columns:
            edges = edges.withColumn("metadata", F.lit(None).cast("string"))
        named = edges.withColumn("id", F.sha2(F.concat_ws("\0", "source", "edge_type", "target"), 256)).withColumn("tx_time", F.current_timestamp() if now is None else now)
        self.versions.write({"edges": store.last_of(self._landed(named), "id", F.struct("tx_time", "weight"))})

    def unrelate(self, edges: DataFrame) -> None:
        """Edges (`id`) go."""
        self.versions.write({}, {"edges": edges.select("id")})

    def edge(self, edge: str):
        """An edge by its id, or None."""
        return self.table("edges").where(F.col("id") == edge).first()

    def get(self, node: str):
        found = self.table("nodes").where(F.col("id") == node).first()
        if found is None:
            raise NodeNotFound(node)
        return found

    def delete(self, nodes: DataFrame, now: Column | None = None) -> None:
        """Nodes (`id`) with their vectors, postings and edges; the log gets a delete for each."""
        gone = self._landed(nodes.select("id").distinct())
        now = F.current_timestamp() if now is None else now
        edges = self.table("edges")
        touching = [edges.join(gone.select(F.col("id").alias(end)), end, "left_semi").select("id") for end in ("source", "target")]
        log = store.deleted({"deltas": self.spark.createDataFrame([], SCHEMAS["deltas"])}, gone, now)["deltas"]
        each = {name: gone for name in ("nodes", "vectors", "postings", "lengths")}
        self.versions.write({"deltas": log}, each | {"edges": touching[0].union(touching[1]).distinct()})

    def reembed(self, nodes: DataFrame) -> None:
        """New vectors for nodes (`id`); unknown ids change nothing, and the text index stays as it is."""
        known = self.table("nodes").join(nodes.select("id"), "id", "left_semi")
        self.versions.write({"vectors": self._vectors_of(known)})

    def put(self, key: str, value: bytes) -> None:
        self.versions.write({"kv": self.spark.createDataFrame([(key, bytearray(value))], SCHEMAS["kv"])})

    def value(self, key: str) -> bytes | None:
        row = self.table("kv").where(F.col("key") == key).first()
        return bytes(row["value"]) if row else None

    def drop(self, key: str) -> None:
        self.versions.write({}, {"kv": self.spark.createDataFrame([(key,)], "key string")})

    def put_objects(self, blobs: DataFrame, column: str) -> DataFrame:
        """Contents by their SHA-256; what is there already stays. Returns their ids."""
        new = store.objects(blobs, column)
        self.versions.write({"objects": new})
        return new.select("object_id")

    def object(self, object_id: str) -> bytes | None:
        row = self.table("objects").where(F.col("object_id") == object_id).first()
        return bytes(row["data"]) if row else None

    def list(self, kind: str | None = None, limit: int = 20, project: str | None = None) -> DataFrame:
        return store.listed(self.table("nodes"), kind, limit, project)

    def keyword_scores(self, terms: DataFrame) -> DataFrame:
        """BM25 of query terms (`qid`, `term`) from stored postings; the terms reach the scan if they are few."""
        some = [r["term"] for r in terms.select("term").distinct().limit(FEW + 1).collect()]
        if len(some) <= FEW:
            found = self.table("postings", fts.term_filter(some))
        else:
            found = self.table("postings").join(terms.select("term").distinct(), "term", "left_semi")
        return fts.bm25_of(found.select("id", "field", "term", "dl", "tf"), fts.statistics_of(self.table("lengths")), terms)

    def find(self, text: str, limit: int = 5) -> DataFrame:
        """The best nodes by keywords alone: nodes with `score` and `rank`; fewer where nodes are gone."""
        best = fts.top(self.keyword_scores(self._terms(text)), limit)
        return best.join(self.table("nodes"), "id")

    def _terms(self, text: str) -> DataFrame:
        asked = self.spark.range(1).select(F.lit(text).alias("body"))
        return asked.select(F.lit("0").alias("qid"), F.explode(F.array_distinct(tokens(F.col("body")))).alias("term"))

    def search(self, text: str, k: int = 10, min_confidence: float = 0.0, project: str | None = None, hops: int = 2) -> DataFrame:
        """Keyword, vector and graph rankings of one query text, fused: nodes with `score` and `rank`."""
        nodes = self.table("nodes")
        by_words = fts.top(self.keyword_scores(self._terms(text)), 3 * k)
        asked = self.spark.range(1).select(F.lit("0").alias("id"), F.lit(text).alias("body"))
        query = self.embed(asked, "body", self.dims).select(F.col("id").alias("qid"), F.col("v").alias("q"))
        by_vector = vectors.batch_top_k(self.table("vectors"), query, 3 * k)
        seeds = by_vector.where("rank <= 3").select("qid", F.col("id").alias("seed"), F.col("rank").alias("seed_rank"))
        by_graph = graph.ranked_near(self.table("edges"), seeds, hops)
        post = F.array_contains("tags", f"project:{project}") if project else None
        return fusion.fused([r.select("qid", "id", "rank") for r in (by_vector, by_words, by_graph)], nodes, k, min_confidence, post=post)

    def subgraph(self, seed: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        """Existing nodes within the depth, and the edges that touch those nearer than it."""
        edges = self.table("edges")
        seen = graph.bfs(edges, self.spark.createDataFrame([(seed,)], "seed string"), depth)
        return self.table("nodes").join(seen.select("id").distinct(), "id", "left_semi"), graph.subgraph_edges(edges, seen, depth)

    def stats(self) -> DataFrame:
        return store.statistics(self.table("nodes"), self.table("edges"), self.table("objects"), self.table("clusters"))
