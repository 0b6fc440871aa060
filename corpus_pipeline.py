"""A corpus pipeline of five stages: each reads what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`.

1. toxicity: documents that the classifier calls toxic go.
2. lines: later repeats of runs of lines go; a document of which no line is left goes with
   them (it was all repeats). Documents that had no lines stay. n_chars follows the text.
3. near_duplicates: of each class of near-duplicates the first document stays.
4. decontamination: documents that hold a benchmark item go.
5. encoding: ids of the texts that are left, and the check that they decode to them.

Null ids and null, empty and very long texts, repeated rows, ties and empty tables are handled as the
operators say. Columns of docs stay as they are, whatever their names; only text and n_chars follow
what line dedup removes. The last stage gives lang and source null where docs have none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, lines, minhash, toxicity
from lodestone.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Other columns travel as one, so that one of them that is named as a result is keeps its values.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    done = lines.line_dedup(docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("__none")).alias("__row")))
    changed = {"doc_id": F.col("doc_id"), "text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("__row")["n_chars"])
    kept = done.where("n_lines = 0 or n_removed < n_lines")
    return kept.select(*[changed.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = docs.select("doc_id", "text", *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")])
    done = bpe.encode_documents(named, bpe.tokenizer_file(), keep=("lang", "source"))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: A classifier fitted to the corpus and class representatives by signature are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is a Parquet table in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}-{name}")
        docs = spark.read.parquet(f"{folder}/{place}-{name}")
    return docs
