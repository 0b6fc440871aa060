"""Sessions, lineage cuts and the folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName("lodestone")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return (builder.master(master) if master else builder).getOrCreate()


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, deleted when it ends.

    It lies in the folder that the cluster names in spark.checkpoint.dir. Where that is unset it
    lies in the warehouse, which executors see too; only a local master gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    key = f"{spark.sparkContext.applicationId} {top}"
    if key not in _folders:
        if not top:
            local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
            top = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir")
        _folders[key] = f"{top}/lodestone-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        place, files = hadoop_path(spark, _folders[key])
        files.mkdirs(place)
        files.deleteOnExit(place)
    return _folders[key]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it.

    Unlike a checkpoint the table is compressed and has its true size as statistics, so later
    joins are planned well and iterations do not multiply estimates.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
