"""Chunking of texts and late interaction (MaxSim) over chunk vectors.

Sizes and offsets of fixed chunks are in characters, thresholds in bytes. All but the
sentence chunker are expressions; that one is a running fold over each text.
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

from lodestone.functions.text import strip, utf8_prefix
from lodestone.operators.vectors import asked_by_length, blocks, by_length, cosines, ranked

SIZE, OVERLAP, LEAST = 512, 64, 32


def fixed_pieces(text: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Array of (char_offset, content) windows, trimmed; those of fewer bytes than `least` are dropped.

    The text is cut into blocks of one step in one pass; a window is its block and the beginning
    of those after it, so the work is linear in the text.
    """
    step = max(1, size - overlap)
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{step}}})"), 1)
    pieces = blocks
    for ahead in range(1, -(-size // step)):
        room = min(step, size - ahead * step)
        pieces = F.zip_with(pieces, F.slice(blocks, ahead + 1, F.greatest(F.size(blocks), F.lit(1))), lambda x, y: F.when(x.isNotNull(), F.concat(x, F.substring(F.coalesce(y, F.lit("")), 1, room))))  # noqa: B023
    placed = F.transform(pieces, lambda p, i: F.struct((i * step).cast("bigint").alias("char_offset"), strip(F.substring(p, 1, size)).alias("content")))
    return F.filter(placed, lambda p: F.octet_length(p["content"]) >= least)


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """`id`, `chunk_index`, `char_offset`, `content`."""
    each = docs.select("id", F.posexplode(fixed_pieces(F.col("body"), size, overlap, least)).alias("chunk_index", "c"))
    return each.select("id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "c.char_offset", "c.content")


def paragraphs(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Texts split at blank lines; long paragraphs are cut again. Offsets are in bytes, those of cuts added in characters.

    Offsets and numbers are running sums over a document's paragraphs, in one shuffle by document.
    """
    before = W.partitionBy("id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    parts = docs.select("id", F.posexplode(F.split("body", "\n\n")).alias("ordinal", "part"))
    begin = F.coalesce(F.sum(F.octet_length("part") + 2).over(before), F.lit(0))
    each = parts.select("id", F.col("ordinal").cast("bigint").alias("ordinal"), strip(F.col("part")).alias("content"), begin.cast("bigint").alias("begin")).where(F.octet_length("content") >= least)
    long = F.octet_length("content") > 2 * size
    cuts = F.when(long, F.transform(fixed_pieces(F.col("content"), size, overlap, least), lambda c: F.struct((c["char_offset"] + F.col("begin")).alias("char_offset"), c["content"].alias("content"), F.lit(True).alias("sub"))))
    whole = F.array(F.struct(F.col("begin").alias("char_offset"), F.col("content").alias("content"), F.lit(False).alias("sub")))
    chunk = each.select("id", "ordinal", F.explode(F.coalesce(cuts, whole)).alias("c")).select("id", "ordinal", "c.*")
    n = F.row_number().over(W.partitionBy("id").orderBy("ordinal", "char_offset")) - 1
    index = F.when(F.col("sub"), n.cast("bigint")).otherwise(F.col("ordinal"))
    return chunk.select("id", index.alias("chunk_index"), "char_offset", "content")


def sections(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Texts split at lines that begin with `#`: `id`, `section`, `char_offset` (bytes), `content`; long ones are cut again.

    Headings are counted over a document's lines and each section gathers its own lines once.
    """
    upto = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    lines = docs.select("id", F.posexplode(F.split(F.regexp_replace("body", "\n$", ""), "\n")).alias("pos", "line"))
    headed = lines.withColumn("heading", strip(F.col("line")).startswith("#"))
    placed = headed.select("*", F.sum(F.col("heading").cast("int")).over(upto).alias("nth"), F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("bigint").alias("at"))
    own = F.sort_array(F.collect_list(F.when(~F.col("heading"), F.struct("pos", "line"))))
    name = F.max(F.when(F.col("heading"), strip(F.regexp_replace(strip(F.col("line")), "^#+", ""))))
    gathered = placed.groupBy("id", "nth").agg(name.alias("section"), F.min("at").alias("begin"), own.alias("own"))
    content = F.array_join(F.transform("own", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    kept = gathered.select("id", "section", "begin", content.alias("content")).where(F.octet_length(strip(F.col("content"))) >= least)
    long = F.octet_length("content") > 2 * size
    cuts = F.when(long, F.transform(fixed_pieces(F.col("content"), size, overlap, least), lambda c: F.struct((c["char_offset"] + F.col("begin")).alias("char_offset"), c["content"].alias("content"))))
    whole = F.array(F.struct(F.col("begin").alias("char_offset"), strip(F.col("content")).alias("content")))
    return kept.select("id", "section", F.explode(F.coalesce(cuts, whole)).alias("c")).select("id", "section", "c.char_offset", "c.content")


def sentence_pieces(text: str, size: int = SIZE, least: int = LEAST) -> list[tuple[int, str]]:
    """(offset in characters, content): sentences gathered until they fill `size` bytes."""
    import re

    out, begin, small = [], 0, text.isascii()
    for m in re.finditer(r"[.!?](?=\s|$)", text):
        part = text[begin : m.end()]
        length = len(part) if small else len(part.encode())
        if length >= max(size, least):
            if len(part.strip().encode()) >= least:
                out.append((begin, part.strip()))
            begin = m.end()
    if len(text[begin:].strip().encode()) >= least:
        out.append((begin, text[begin:].strip()))
    return out


def sentences(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    @F.pandas_udf("array<struct<char_offset:bigint,content:string>>")
    def cut(texts):
        return texts.map(lambda t: [{"char_offset": o, "content": c} for o, c in sentence_pieces(t or "", size, least)])

    each = docs.select("id", F.posexplode(cut("body")).alias("chunk_index", "c"))
    return each.select("id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "c.char_offset", "c.content")


STRATEGIES = {"fixed": fixed, "paragraph": paragraphs, "sentence": sentences, "markdown": sections}


#: Queries whose scores for a batch of chunks a task holds at a time.
SIDE = 256


def pair_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """`qid`, `doc`, `chunk`, `score` of each document's best chunk of a batch for query vectors, as `max_sim` gathers them.

    Queries go in broadcast blocks. A task multiplies its chunks with them as matrices and sends on one
    row of a query and document for each batch, not one of each pair; equal to 9 places, the first chunk stays.
    """
    types = [T.StructField(n, f.dataType) for n, f in (("qid", queries.schema["qid"]), ("doc", chunks.schema["doc"]), ("chunk", chunks.schema["chunk"]))]
    dealt, out = chunks.select("doc", "chunk", "v").repartition("doc", "chunk"), None
    for part in blocks(queries):
        shared = chunks.sparkSession.sparkContext.broadcast(asked_by_length(part))

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            qids, sides = shared.value
            for batch in batches:
                for size, rows, lists in by_length(batch, 2):
                    if size not in sides:
                        continue
                    code = pc.dictionary_encode(rows.column(0), null_encoding="encode")
                    keys = pa.table({"doc": code.indices, "chunk": rows.column(1)})
                    order = np.asarray(pc.sort_indices(keys, [("doc", "ascending"), ("chunk", "ascending")]))
                    docs, v = np.asarray(code.indices)[order], lists[order].astype(float)
                    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
                    counts = np.diff(np.append(first, len(docs)))
                    places, q = sides[size]
                    for at in range(0, len(places), SIDE):
                        scores = cosines(q[at : at + SIDE].astype(float), v)
                        near = scores.round(9)
                        best = near == np.repeat(np.maximum.reduceat(near, first, axis=1), counts, axis=1)
                        spot = np.minimum.reduceat(np.where(best, np.arange(len(docs)), len(docs)), first, axis=1)
                        n = len(scores)
                        columns = [
                            pa.array([qids[p] for p in places[at : at + n] for _ in first]),
                            code.dictionary.take(pa.array(np.tile(docs[first], n))),
                            rows.column(1).take(pa.array(order[spot.ravel()])),
                            pa.array(np.maximum.reduceat(scores, first, axis=1).ravel()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["qid", "doc", "chunk", "score"])

        found = dealt.mapInArrow(run, T.StructType([*types, T.StructField("score", T.DoubleType())]))
        out = found if out is None else out.unionByName(found)
    return out


def max_sim(pairs: DataFrame) -> DataFrame:
    """`qid`, `doc`, `score`, `best_chunk`: the best chunk of each document, the first one on ties."""
    best = F.min_by("chunk", F.struct(-F.round("score", 9), "chunk"))
    return pairs.groupBy("qid", "doc").agg(F.max("score").alias("score"), best.alias("best_chunk"))


def late_interaction(pairs: DataFrame) -> DataFrame:
    """`doc`, `score`: the mean over the queries of the best chunk's similarity."""
    return max_sim(pairs).groupBy("doc").agg(F.avg("score").alias("score"))


#: Bytes of a text that an embedding model is given.
EMBEDDED = 6000


def embedded(docs: DataFrame, strategy: str, embed: Callable[[DataFrame, str, int], DataFrame], dims: int, **how) -> DataFrame:
    """`doc`, `chunk`, `content`, `v`: each document's chunks with their vectors; embed takes rows with `id` and a text column.

    Texts are cut to EMBEDDED bytes at a character's end. Empty documents have no chunks.
    """
    pieces = STRATEGIES[strategy](docs, **how).withColumnRenamed("id", "doc")
    if "chunk_index" not in pieces.columns:
        pieces = pieces.withColumn("chunk_index", F.row_number().over(W.partitionBy("doc").orderBy("char_offset")).cast("bigint") - 1)
    named = pieces.select("doc", F.col("chunk_index").alias("chunk"), "content").withColumn("id", F.sha2(F.concat_ws("/", "doc", "chunk", "content"), 256))
    vectors = embed(named.select("id", utf8_prefix(F.col("content"), EMBEDDED).alias("text")).dropDuplicates(["id"]), "text", dims)
    return named.join(vectors, "id").select("doc", "chunk", "content", "v")


def rank_documents(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`qid`, `doc`, `score`, `best_chunk`, `rank`: the k documents whose best chunk is nearest each query, ties to the smaller id."""
    best = max_sim(pair_scores(chunks, queries)).withColumn("score", F.round("score", 6)).withColumnRenamed("doc", "id")
    return ranked(best, k, F.desc("score")).withColumnRenamed("id", "doc").select("qid", "doc", "score", "best_chunk", "rank")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """`doc`, `n`: chunks of each document."""
    return chunks.groupBy("doc").agg(F.count("*").alias("n"))
