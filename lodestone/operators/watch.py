"""File watching: filters, debouncing and change detection by content hash, over tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What is watched unless said otherwise.
EXTENSIONS = ("md", "txt", "rs", "py", "js", "ts", "json", "yaml", "toml", "html", "css")
IGNORED = (".git", "node_modules", "target", "__pycache__", ".venv", "venv")


def watched(path: Column, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> Column:
    """Is the extension wanted (none given: any), and no part of the path ignored?"""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    kept = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored))) if ignored else F.lit(True)
    return kept & extension.isin(*extensions) if extensions else kept


#: Contents of more bytes have no hash, so that their changes are not told apart.
HASHED = 10 * 1024 * 1024


def debounced(events: DataFrame, gap_micros: int) -> DataFrame:
    """Events at least the gap after the path's previous event, whether that was kept or not; undated ones are kept."""
    w = W.partitionBy("path", F.col("ts").isNull()).orderBy("ts", "event_id")
    since = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    return events.withColumn("since", since).where(F.col("since").isNull() | (F.col("since") >= gap_micros)).drop("since")


def changed(events: DataFrame) -> DataFrame:
    """Events whose content hash differs from the path's previous one; the first and undated ones always count.

    A null hash is a hash of its own.
    """
    w = W.partitionBy("path", F.col("ts").isNull()).orderBy("ts", "event_id")
    marked = events.withColumn("before", F.lag(F.struct("hash")).over(w))
    return marked.where(F.col("ts").isNull() | F.col("before").isNull() | ~F.col("before.hash").eqNullSafe(F.col("hash"))).drop("before")


def file_changes(events: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Changes that a watcher reports: events have `kind` (create, modify, delete, rename), `path`, `ts`, `event_id`, `hash`, `length`.

    Creations, deletions and renames always count. A modification counts if its content's hash
    differs from the last known one of the path; contents over HASHED bytes have none, so a
    modification from one such content to another does not. `scanned` (`path`, `hash`, `length`) is what
    a first scan found: its hashes are known before the first event.
    """
    known = F.when(F.col("length") <= HASHED, F.col("hash"))
    each = events.select(*events.columns, known.alias("known"), F.lit(True).alias("live"))
    if scanned is not None:
        first = scanned.select("path", known.alias("known"), F.lit(False).alias("live"))
        each = each.unionByName(first, allowMissingColumns=True)
    w = W.partitionBy("path").orderBy("live", "ts", "event_id")
    marked = each.withColumn("before", F.lag(F.struct("known")).over(w))
    same = F.col("before").isNotNull() & F.col("before.known").eqNullSafe(F.col("known"))
    return marked.where(F.col("live") & ((F.col("kind") != "modify") | ~same)).select(*events.columns)
