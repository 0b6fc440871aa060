"""Helpers shared by the training-data operators.

Two rows of `documents` are the same document when id and text are equal; every
operator that joins decisions back does so on that identity, so repeated rows get
equal decisions and rows that share only an id do not disturb each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut, shared_folder

__all__ = ["ID", "TH", "cut", "keyed", "same_doc", "shared_folder", "table", "with_columns_of"]

ID, TH = "__doc", "__text_hash"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with its identity columns: the id as `__doc` and a hash of the text."""
    return docs.withColumns({ID: F.col(doc_id).cast("long"), TH: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on the identity; a null id is an id of its own."""
    return a[ID].eqNullSafe(b[ID]) & (a[TH] == b[TH])


def with_columns_of(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name (in any case) is replaced."""
    taken = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    return docs.select(*kept, *[v.alias(k) for k, v in columns.items()])
