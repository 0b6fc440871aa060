"""Files as nodes: reading folders, filters, and the node that a file becomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import utf8_prefix
from lodestone.operators.watch import EXTENSIONS, IGNORED, watched

LARGEST, BODY_BYTES, HASHED = 1_000_000, 4096, 10 * 1024 * 1024


def read_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """`path`, `modificationTime`, `length`, `content` of the wanted files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(watched(F.col("path"), extensions, ignored))


def count_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> int:
    """Wanted files; hidden folders are passed over. The contents are not read."""
    files = read_files(spark, folder, extensions).select("path")
    return files.where(~F.exists(F.split("path", "/"), lambda p: p.startswith("."))).count()


def fingerprints(files: DataFrame) -> DataFrame:
    """`path`, `hash`: of the content, or of size and time where a file is too large to hash."""
    by_size = F.sha2(F.concat_ws("/", "length", F.unix_micros("modificationTime")), 256)
    return files.select("path", F.when(F.col("length") <= HASHED, F.sha2("content", 256)).otherwise(by_size).alias("hash"))


def as_nodes(files: DataFrame, project: str | None = None, capped: bool = True) -> DataFrame:
    """A node for each file that is neither empty nor (if capped) too large, named by its path, with the text's first bytes."""
    name = F.element_at(F.split("path", "/"), -1)
    tags = [F.concat(F.lit("file:"), name), F.concat(F.lit("ext:"), F.regexp_extract(name, r"\.([^.]+)$", 1)), F.concat(F.lit("path:"), "path")]
    tags += [F.lit(f"project:{project}")] if project else []
    return files.where((F.col("length") > 0) & ((F.col("length") <= LARGEST) if capped else F.lit(True))).select(
        F.sha2("path", 256).alias("id"),
        F.lit("document").alias("node_type"),
        utf8_prefix(F.decode("content", "utf-8"), BODY_BYTES).alias("body"),
        F.array(*tags).alias("tags"),
        F.lit(1.0).alias("confidence"),
        F.col("modificationTime").alias("tx_time"),
    )
