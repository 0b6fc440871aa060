"""Tables of the store: content-addressed objects, clusters, provenance, key-value pairs, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import utf8_prefix


def objects(blobs: DataFrame, column: str) -> DataFrame:
    """`object_id` (SHA-256 of the content) and `data`, each content once."""
    data = F.col(column).cast("binary")
    return blobs.where(F.col(column).isNotNull()).select(F.sha2(data, 256).alias("object_id"), data.alias("data")).dropDuplicates(["object_id"])


def last_of(new: DataFrame, key: str, order: Column) -> DataFrame:
    """One row of each key: the last one."""
    return new.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in new.columns]), order).alias("r")).select("r.*").select(*new.columns)


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with new ones put in place of those of the same key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def edges_from(edges: DataFrame, node: str, edge_type: str | None = None) -> DataFrame:
    """Edges that begin at a node, of a type if one is given."""
    found = edges.where(F.col("source") == node)
    return found if edge_type is None else found.where(F.col("edge_type") == edge_type)


def edges_to(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("target") == node)


def records(nodes: DataFrame, score: Column | None = None) -> DataFrame:
    """Nodes as they are shown: times in RFC 3339, a score if there is one, and no internal columns."""
    shown = nodes.select("id", "node_type", "body", "tags", "confidence", F.date_format(F.to_utc_timestamp("tx_time", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("tx_time"), *([score.alias("score")] if score is not None else []))
    return shown


def previews(nodes: DataFrame, limit: int = 20, size: int = 100) -> DataFrame:
    """The first nodes by id with the first `size` bytes of their text, `...` where it goes on."""
    cut = utf8_prefix(F.col("body"), size)
    text = F.when(F.octet_length("body") > size, F.concat(cut, F.lit("..."))).otherwise(F.col("body"))
    return nodes.orderBy("id").limit(limit).select("id", "node_type", text.alias("preview"))


def deleted(tables: dict[str, DataFrame], gone: DataFrame, now: Column) -> dict[str, DataFrame]:
    """nodes, vectors and edges without the gone ids (`id`), and the log with a delete for each at a time."""
    out = dict(tables)
    for name in ("nodes", "vectors"):
        if name in out:
            out[name] = out[name].join(gone.select("id"), "id", "left_anti")
    if "edges" in out:
        for end in ("source", "target"):
            out["edges"] = out["edges"].join(gone.select(F.col("id").alias(end)), end, "left_anti")
    if "deltas" in out:
        log = out["deltas"]
        made = {"node_id": F.col("id"), "ts": now, "seq": F.lit(2**62), "op": F.lit("delete")}
        extra = gone.select(*[made.get(c, F.lit(None)).cast(t).alias(c) for c, t in log.dtypes])
        out["deltas"] = log.unionByName(extra)
    return out


def members(clusters: DataFrame) -> DataFrame:
    """`cluster_id`, `node_id` from clusters (`id`, `members`)."""
    return clusters.select(F.col("id").alias("cluster_id"), F.explode("members").alias("node_id"))


def justifications(nodes: DataFrame, provenance: DataFrame) -> DataFrame:
    """Each node's supports; an empty list where none are known."""
    return nodes.join(provenance.withColumnRenamed("node_id", "id"), "id", "left").withColumn("supports", F.coalesce("supports", F.array().cast("array<string>")))


def listed(nodes: DataFrame, node_type: str | None, limit: int, project: str | None = None, post: bool = True) -> DataFrame:
    """The first nodes by id. With a project: post takes 4 * limit first and may return fewer than limit."""
    chosen = nodes if node_type is None else nodes.where(F.col("node_type") == node_type)
    if project is None:
        return chosen.orderBy("id").limit(limit)
    tagged = F.array_contains("tags", f"project:{project}")
    if post:
        return chosen.orderBy("id").limit(4 * limit).where(tagged).orderBy("id").limit(limit)
    return chosen.where(tagged).orderBy("id").limit(limit)


def statistics(nodes: DataFrame, edges: DataFrame, blobs: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Counts of nodes, edges and clusters, bytes of objects, a row each. Each table is aggregated apart."""
    parts = nodes.select(F.lit("nodes").alias("what"), F.lit(1).cast("bigint").alias("n"))
    parts = parts.union(edges.select(F.lit("edges"), F.lit(1).cast("bigint"))).union(blobs.select(F.lit("object_bytes"), F.octet_length("data").cast("bigint")))
    if clusters is not None:
        parts = parts.union(clusters.select(F.lit("clusters"), F.lit(1).cast("bigint")))
    return parts.groupBy("what").agg(F.sum("n").alias("n"))
