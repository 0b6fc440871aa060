"""Workspace visibility as joins of members, shared nodes and workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_nodes(members: DataFrame) -> DataFrame:
    """Nodes that some workspace has shared."""
    return members.where("access = 'shared'").select("node_id").distinct()


def visible(workspaces: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs of asked (`ws_id`, `node_id`) that the workspace sees: shared and reads allowed, own, or its parent's own."""
    spaces = workspaces.select("ws_id", "parent", "allow_shared_reads")
    known = asked.join(spaces, "ws_id")
    by_share = known.where("allow_shared_reads").join(shared_nodes(members), "node_id", "left_semi")
    own = members.select("ws_id", "node_id").distinct()
    owned = known.join(own, ["ws_id", "node_id"], "left_semi")
    inherited = known.join(own.withColumnRenamed("ws_id", "parent"), ["parent", "node_id"], "left_semi")
    pairs = ["ws_id", "node_id"]
    return by_share.select(pairs).union(owned.select(pairs)).union(inherited.select(pairs)).distinct()


def group_visible(workspaces: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """The single workspace's own check: own, shared with reads allowed, or of a group among its tags."""
    shares = members.where("access <> 'private'").select("node_id", F.col("ws_id").alias("owner"), "access", "group_id")
    pairs = ["ws_id", "node_id"]
    own = asked.join(members.select(pairs), pairs, "left_semi")
    tagged = asked.join(workspaces.select("ws_id", "allow_shared_reads", "tags"), "ws_id").join(shares, "node_id")
    group = F.array_contains("tags", F.concat(F.lit("group:"), F.col("group_id").cast("string")))
    lent = tagged.where(((F.col("access") == "shared") & F.col("allow_shared_reads")) | ((F.col("access") == "group") & group))
    return own.select(pairs).union(lent.select(pairs)).distinct()


def within_capacity(members: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Members in order of arrival up to each workspace's capacity (0: any number)."""
    w = W.partitionBy("ws_id").orderBy("added_at", "node_id")
    placed = members.withColumn("place", F.row_number().over(w)).join(workspaces.select("ws_id", "max_nodes"), "ws_id")
    return placed.where((F.col("max_nodes") == 0) | (F.col("place") <= F.col("max_nodes"))).drop("place", "max_nodes")


def created(workspaces: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """workspaces with new ones (`ws_id`, `name` and what is not to be the default)."""
    given = {"parent": F.lit(None).cast("string"), "allow_shared_reads": F.lit(True), "allow_promotion": F.lit(True), "max_nodes": F.lit(10_000), "tags": F.array().cast("array<string>"), "last_accessed": now}
    for name, value in given.items():
        if name not in new.columns:
            new = new.withColumn(name, value)
    return workspaces.unionByName(new.select(*workspaces.columns))


def added(members: DataFrame, workspaces: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Members with new ones (`ws_id`, `node_id`, `access`, `group_id`), and for each new one whether it was taken (`ok`).

    Taken in order of the node's id up to the workspace's capacity (0: any number); a node that is
    there already takes its new access, but only where there is room, as for any other. Nodes of
    unknown workspaces are not taken.
    """
    held = members.groupBy("ws_id").agg(F.count("*").alias("held"))
    once = new.dropDuplicates(["ws_id", "node_id"])
    w = W.partitionBy("ws_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
    old = members.select("ws_id", "node_id", F.lit(True).alias("again"))
    known = once.join(workspaces.select("ws_id", "max_nodes"), "ws_id", "left").join(held, "ws_id", "left").join(old, ["ws_id", "node_id"], "left")
    known = known.withColumn("again", F.coalesce("again", F.lit(False))).withColumn("held", F.coalesce("held", F.lit(0)))
    before = F.col("held") + F.coalesce(F.sum((~F.col("again")).cast("int")).over(w), F.lit(0))
    decided = known.withColumn("ok", F.col("max_nodes").isNotNull() & ((F.col("max_nodes") == 0) | (before < F.col("max_nodes"))))
    taken = decided.where("ok").withColumn("added_at", now).select(*members.columns)
    kept = members.join(taken.select("ws_id", "node_id"), ["ws_id", "node_id"], "left_anti").select(*members.columns)
    return kept.unionByName(taken), decided.select("ws_id", "node_id", "ok")


def removed(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without the gone ones (`ws_id`, `node_id`)."""
    return members.join(gone.select("ws_id", "node_id"), ["ws_id", "node_id"], "left_anti")


def promoted(members: DataFrame, workspaces: DataFrame, asked: DataFrame) -> DataFrame:
    """Members with the asked pairs made shared, where their workspace allows it."""
    may = asked.join(workspaces.where("allow_promotion").select("ws_id"), "ws_id", "left_semi").select("ws_id", "node_id", F.lit(True).alias("up"))
    joined = members.join(may, ["ws_id", "node_id"], "left")
    return joined.withColumn("access", F.when(F.col("up"), "shared").otherwise(F.col("access"))).withColumn("group_id", F.when(F.col("up").isNull(), F.col("group_id"))).drop("up")


def merged(members: DataFrame, source: str, into: str, now: Column) -> DataFrame:
    """Members after one workspace's nodes have moved into another; a node in both takes the moved row."""
    moved = members.where(F.col("ws_id") == source).withColumn("ws_id", F.lit(into)).withColumn("added_at", now)
    kept = members.where(F.col("ws_id") != source).join(moved.select("ws_id", "node_id"), ["ws_id", "node_id"], "left_anti")
    return kept.unionByName(moved)


def stale(workspaces: DataFrame, now: Column, max_idle_hours: int = 24) -> DataFrame:
    return workspaces.where(F.unix_micros(now) - F.unix_micros("last_accessed") > max_idle_hours * 3_600_000_000)


def collected(members: DataFrame, workspaces: DataFrame, now: Column, max_idle_hours: int = 24) -> DataFrame:
    """Members left after stale workspaces are gone."""
    return members.join(stale(workspaces, now, max_idle_hours).select("ws_id"), "ws_id", "left_anti")


def statistics(members: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("access") == a).alias(a) for a in ("private", "shared", "group")]
    return members.groupBy("ws_id").agg(F.count("*").alias("total"), *counts)
