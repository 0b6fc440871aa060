"""Substring dedup (operator 4) by super-k-mer partitioning.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A window is 50 consecutive words of one
document; a word goes if some window over it also starts in a document with a smaller
doc_id, judged on the input.

1. Each window's minimiser is the least hash among its runs of 8 words. Windows that are
   equal have equal minimisers, so only minimisers seen in two documents matter; counting
   them moves one row per change of minimiser (about one per 22 words), with its windows and bytes.
2. Consecutive windows that share such a minimiser travel as one packed string (their words
   once, not once per window) to the minimiser's bucket. There the windows' places are sorted by
   hash and each run of equal ones is read from its smallest document on; equal hashes are
   compared on the words, so the result is exact.
3. A bucket of more than `hot` windows, or of more than HOT_BYTES, is not brought together. Its
   windows go as 128-bit hashes with their places; Spark counts them (map-side first) and joins
   each window to its first document, a hash at a time, whatever the bucket.
4. Equal texts are one text: the copy with the smallest doc_id takes part, the others of 50
   or more words lose every word, as all their windows start in that copy.

Null and empty texts have no words. A null doc_id is neither smaller nor larger than another: such
rows stay whole and remove nothing. Rows that repeat an id do not remove from each other. Texts of
any length go through whole: what Python holds of one grows with its bytes, not with its windows'.
An empty table gives an empty one; input columns named as results are (in any case) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import arrow_map, arrow_rows, pieces_of, run_hashes, span_hashes, spans
from lodestone.llm.common import ID, TH, cut, keyed, table, with_columns_of

WINDOW, SEED_WORDS = 50, 8
#: Windows and bytes of the packed strings from which a bucket is not brought together.
HOT, HOT_BYTES = 50_000, 8 << 20
#: Parts in which the documents of a hot window meet its first one.
SALTS = 32
#: The bytes that part words.
INSIDE = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])
#: Multipliers of the two window hashes; odd, so that they have inverses.
FACTORS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word of a text in UTF-8."""
    codes = np.frombuffer(data, np.uint8)
    starts, ends = spans(INSIDE[codes])
    return span_hashes(codes, starts, ends), starts, ends


def powers(factor: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), factor, np.uint64)]), dtype=np.uint64)[:n]


def window_hashes(words: np.ndarray, window: int, factor: int) -> np.ndarray:
    """A hash for each window, from the running sum of the words' hashes over powers of an odd number."""
    inverse = pow(factor, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(inverse, len(words)), dtype=np.uint64)])
    return (sums[window:] - sums[:-window]) * powers(factor, len(words) - window + 1)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def super_k_mers(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser (as signed long), first window and number of windows of each super-k-mer; words are hashes."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = least_of(run_hashes(words, seed), window - seed + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[first].astype(np.int64), first, np.diff(np.append(first, len(least)))


def ranges(doc: int | None, th: int, starts: list[int], window: int) -> Iterator[tuple[int | None, int, int, int]]:
    """Removed words of a document, first and last exclusive, from its repeated windows."""
    begin = end = -1
    for s in sorted(starts):
        if s > end:
            if end >= 0:
                yield doc, th, begin, end
            begin = s
        end = s + window
    if end >= 0:
        yield doc, th, begin, end


RANGE = {ID: pa.int64(), TH: pa.int64(), "begin": pa.int64(), "end": pa.int64()}
RANGE_SCHEMA = f"{ID} long, {TH} long, begin long, end long"


def later_windows(rows: list[tuple], window: int) -> Iterator[tuple]:
    """Removed ranges within one bucket of rows (minimiser, doc, text hash, first window, packed words)."""
    docs = np.array([r[1] for r in rows])
    if docs.min() == docs.max():
        return
    hashes, owner, place, texts, bounds = [], [], [], [], []
    for k, row in enumerate(rows):
        data = row[4].encode()
        words, starts, ends = hashed_words(data)
        found = window_hashes(words, window, FACTORS[0])
        hashes.append(found)
        owner.append(np.full(len(found), k))
        place.append(np.arange(len(found)))
        texts.append(data)
        bounds.append((starts, ends))
    hashes, owner, place = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
    order = np.lexsort((docs[owner], hashes))
    hashes, owner, place = hashes[order], owner[order], place[order]
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    ends = np.append(begins[1:], len(hashes))
    several = docs[owner[begins]] != docs[owner[ends - 1]]
    gone: dict[int, list[int]] = {}
    for begin, end in zip(begins[several].tolist(), ends[several].tolist()):
        first: dict[bytes, int] = {}  # one entry, but for equal hashes of different words
        for k, i in zip(owner[begin:end].tolist(), place[begin:end].tolist()):
            starts, stops = bounds[k]
            doc = rows[k][1]
            if first.setdefault(texts[k][starts[i] : stops[i + window - 1]], doc) < doc:
                gone.setdefault(k, []).append(rows[k][3] + i)
    for k, starts in gone.items():
        yield from ranges(rows[k][1], rows[k][2], starts, window)


def bucket_ranges(packed: DataFrame, window: int) -> DataFrame:
    """Removed ranges from packed strings that are dealt and sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple] = []
        for batch in (piece for whole in batches for piece in pieces_of(whole, 1024)):
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket and bucket[0][0] != row[0]:
                    out.extend(later_windows(bucket, window))
                    bucket = []
                bucket.append(row)
            yield arrow_rows(out, RANGE)
        yield arrow_rows(list(later_windows(bucket, window)) if bucket else [], RANGE)

    return packed.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, RANGE_SCHEMA)


def hot_ranges(chosen: DataFrame, window: int, seed: int) -> DataFrame:
    """Removed ranges in buckets that may be of any size; chosen: identity, `text` and the `minis` asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", ID, TH, "begin"]
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            for doc, th, text, minis in zip(*(c.to_pylist() for c in batch.columns)):
                words, _, _ = hashed_words(text.encode())
                mini, first, n = super_k_mers(words, window, seed)
                mine = np.isin(mini, np.array(minis, np.int64))
                at = np.arange(n[mine].sum()) + np.repeat(first[mine] - np.cumsum(n[mine]) + n[mine], n[mine])
                w1, w2 = (window_hashes(words, window, f)[at].astype(np.int64) for f in FACTORS)
                columns = [pa.array(w1), pa.array(w2), pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), th)), pa.array(at)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    windows = cut(chosen.mapInArrow(run, f"w1 long, w2 long, {ID} long, {TH} long, begin long"))
    firsts = windows.groupBy("w1", "w2").agg(F.min(ID).alias("low"), F.max(ID).alias("high")).where("low < high").drop("high")
    # A window may occur in very many documents: each part of them meets a copy of its first one.
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64(ID, TH), F.lit(SALTS)).cast("int"))
    later = dealt.join(salted, ["w1", "w2", "salt"]).where(F.col(ID) > F.col("low"))
    return later.select(ID, TH, "begin", (F.col("begin") + window).alias("end"))


def repeated_ranges(base: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, hot: int = HOT) -> DataFrame:
    """Ranges of removed words; base has the identity columns and `text`, each text once."""

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            rows, found, counts, sizes = [], [], [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                words, starts, ends = hashed_words(text.encode())
                mini, first, n = super_k_mers(words, window, seed)
                if len(mini):
                    once, which = np.unique(mini, return_inverse=True)
                    rows.append(np.full(len(once), at))
                    found.append(once)
                    counts.append(np.bincount(which, n))
                    sizes.append(np.bincount(which, ends[first + n + window - 2] - starts[first]))
            rows, found, counts, sizes = (np.concatenate([*x, np.empty(0, np.int64)], dtype=np.int64, casting="unsafe") for x in (rows, found, counts, sizes))
            at = pa.array(rows)
            columns = [pa.array(found), batch.column(0).take(at), batch.column(1).take(at), pa.array(counts), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=["mini", ID, TH, "windows", "bytes"])

    seen = cut(base.select(ID, TH, "text").mapInArrow(minimisers, f"mini long, {ID} long, {TH} long, windows long, bytes long"))
    shared = cut(
        seen.groupBy("mini")
        .agg(F.min(ID).alias("low"), F.max(ID).alias("high"), F.sum("windows").alias("windows"), F.sum("bytes").alias("bytes"))
        .where("low < high")
        .select("mini", ((F.col("windows") > hot) | (F.col("bytes") > HOT_BYTES)).alias("hot"))
    )
    wanted = cut(
        seen.join(shared, "mini")
        .groupBy(ID, TH)
        .agg(F.collect_list(F.when(~F.col("hot"), F.col("mini"))).alias("cold_minis"), F.collect_list(F.when(F.col("hot"), F.col("mini"))).alias("hot_minis"))
    )
    found = base.join(wanted, [ID, TH])

    def rows_of(doc: int, th: int, text: str, minis: list[int]) -> Iterator[tuple]:
        data = text.encode()
        words, starts, ends = hashed_words(data)
        mini, first, n = super_k_mers(words, window, seed)
        mine = np.isin(mini, np.array(minis, np.int64))
        last = first + n + window - 2
        for m, f, begin, end in zip(mini[mine].tolist(), first[mine].tolist(), starts[first[mine]].tolist(), ends[last[mine]].tolist()):
            yield m, doc, th, f, b" ".join(data[begin:end].split()).decode()

    types = {"mini": pa.int64(), ID: pa.int64(), TH: pa.int64(), "start": pa.int64(), "packed": pa.string()}
    cold = found.where(F.size("cold_minis") > 0).select(ID, TH, "text", "cold_minis")
    packed = arrow_map(cold, rows_of, f"mini long, {ID} long, {TH} long, start long, packed string", types)
    hot_rows = found.where(F.size("hot_minis") > 0).select(ID, TH, "text", "hot_minis")
    return bucket_ranges(packed, window).unionByName(hot_ranges(hot_rows, window, seed))


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, hot: int = HOT, digest_only: bool = False) -> DataFrame:
    """`docs` with `n_words`, `n_removed` and the kept words as `kept_text`.

    With digest_only: `doc_id`, `n_words`, `n_removed`, `kept_sha256` alone.
    """
    rows = keyed(docs).withColumns({"text": F.coalesce("text", F.lit("")), "__sum": F.sha2(F.coalesce("text", F.lit("")), 256)})
    firsts = cut(rows.groupBy("__sum").agg(F.min(ID).alias("first"), F.max(ID).alias("last")).where("first < last").select("__sum", "first"))
    copies = rows.select(ID, TH, "__sum").join(firsts, "__sum").where(F.col(ID) > F.col("first")).select(ID, TH).distinct()
    base = rows.select(ID, TH, "text").where(F.col(ID).isNotNull())
    taking = base.join(copies.withColumn("copy", F.lit(True)), [ID, TH], "left").where("copy is null").select(ID, TH, "text")
    gone = repeated_ranges(taking, window, seed, hot).unionByName(copies.select(ID, TH, F.lit(0).cast("long").alias("begin"), F.lit(2**62).alias("end")))
    gone = gone.groupBy(ID, TH).agg(F.collect_list(F.struct("begin", "end")).alias("__gone"))
    all_rows = rows.drop("__sum") if not digest_only else rows.select(ID, TH, "text", "doc_id")
    joined = all_rows.alias("d").join(gone.alias("g"), (F.col(f"d.{ID}") == F.col(f"g.{ID}")) & (F.col(f"d.{TH}") == F.col(f"g.{TH}")), "left")
    joined = joined.select(*[F.col(f"d.`{c}`") for c in all_rows.columns if c not in (ID, TH)], F.col("g.__gone"))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def kept(text, gone):
        import pandas as pd

        out = []
        for t, removed in zip(text, gone):
            words = t.encode().split()  # at ASCII white space, which is what parts words here
            left = words
            if removed is not None and len(words):
                keep = np.ones(len(words), bool)
                for s in removed:
                    if s["end"] < 2**62 or len(words) >= window:
                        keep[s["begin"] : s["end"]] = False
                left = [words[i] for i in np.flatnonzero(keep)]
            joined_text = b" ".join(left)
            out.append((len(words), len(words) - len(left), hashlib.sha256(joined_text).hexdigest() if digest_only else joined_text.decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    done = joined.withColumn("__kept", kept("text", "__gone")).drop("__gone")
    columns = {"n_words": F.col("__kept.n_words"), "n_removed": F.col("__kept.n_removed"), "kept_sha256" if digest_only else "kept_text": F.col("__kept.kept")}
    return done.select("doc_id", *[v.alias(k) for k, v in columns.items()]) if digest_only else with_columns_of(done, columns).drop("__kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_only=True)


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (h) WHERE first_doc < doc_id
), every_word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT e.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY e.i) AS text
  FROM every_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
