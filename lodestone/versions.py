"""Tables of several Parquet parts under one version number.

A write adds parts beside the ones there are and then names all tables' parts in one new version
file, so several tables change together and a job that is lost half-way changes nothing: readers
take the highest version. Rows of a key in a later part stand in place of the key's rows in
earlier ones; each part has the list of its keys, which also names those that are gone.
Tables without a key are only appended to. `compact` makes one part of many. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import hadoop_path

#: Parts from which a write makes one part of a table's.
MOST = 16


class Versions:
    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str], keys: Mapping[str, str]):
        self.spark, self.path, self.schemas, self.keys = spark, path, schemas, keys

    def _names(self) -> list[str]:
        place, files = hadoop_path(self.spark, f"{self.path}/_versions")
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def current(self) -> dict[str, list[str]]:
        """The parts of each table, oldest first."""
        names = [n for n in self._names() if n.endswith(".json")]
        if not names:
            return {}
        lines = self.spark.read.text(f"{self.path}/_versions/{names[-1]}").collect()
        return json.loads("".join(r[0] for r in lines))

    def _name_version(self, parts: dict[str, list[str]]) -> None:
        names = [n for n in self._names() if n.endswith(".json")]
        number = int(names[-1].split(".")[0]) + 1 if names else 1
        final, files = hadoop_path(self.spark, f"{self.path}/_versions/{number:012d}.json")
        draft, _ = hadoop_path(self.spark, f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"version {number} was written by another writer")

    def _part(self, name: str, part: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}/{part}")

    def read(self, name: str, where: str = "true") -> DataFrame:
        """The table's rows, of the filter only: it reaches the scan of each part."""
        parts, key = self.current().get(name, []), self.keys.get(name)
        if not parts:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = [self._part(name, p).where(where).withColumn("__order", F.lit(i)) for i, p in enumerate(parts)]
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        if key and len(parts) > 1:
            known = self.spark.createDataFrame([], f"{key} string, __order int")
            for i, p in enumerate(parts):
                known = known.unionByName(self.spark.read.schema(f"{key} string").parquet(f"{self.path}/{name}.keys/{p}").withColumn("__order", F.lit(i)))
            last = known.groupBy(key).agg(F.max("__order").alias("__order"))
            every = every.join(last, [key, "__order"], "left_semi")
        return every.select(*self.spark.createDataFrame([], self.schemas[name]).columns)

    def write(self, put: Mapping[str, DataFrame], gone: Mapping[str, DataFrame] | None = None) -> None:
        """One version: `put` rows in place of those of their keys (appended where a table has none), `gone` keys without rows."""
        parts, gone = self.current(), gone or {}
        for name in dict.fromkeys([*put, *gone]):
            part, key = uuid.uuid4().hex, self.keys.get(name)
            columns = self.spark.createDataFrame([], self.schemas[name]).columns
            rows = put[name].select(*columns) if name in put else self.spark.createDataFrame([], self.schemas[name])
            rows.write.parquet(f"{self.path}/{name}/{part}")
            if key:
                keys = self._part(name, part).select(key)
                keys = keys.union(gone[name].select(F.col(gone[name].columns[0]).alias(key))) if name in gone else keys
                keys.distinct().write.parquet(f"{self.path}/{name}.keys/{part}")
            parts.setdefault(name, []).append(part)
        self._name_version(parts)
        if any(len(p) > MOST for p in parts.values()):
            self.compact([n for n, p in parts.items() if len(p) > MOST])

    def compact(self, names: list[str]) -> None:
        """One part of each table's parts; old parts stay for readers of older versions."""
        parts = self.current()
        for name in names:
            part, key = uuid.uuid4().hex, self.keys.get(name)
            self.read(name).write.parquet(f"{self.path}/{name}/{part}")
            if key:
                self._part(name, part).select(key).distinct().write.parquet(f"{self.path}/{name}.keys/{part}")
            parts[name] = [part]
        self._name_version(parts)
