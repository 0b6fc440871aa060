"""MinHash near-dedup (operator 2) with DartMinHash signatures and banded joining.

A document is the weighted set of its runs of five words (lower-cased `\\w+`), each weighted
by how often it occurs; similarity is weighted Jaccard, 0.8 or more makes a link, and classes
are the connected components. A document of one to four words is one run. Null texts and
texts without words are like nothing: each stays a class of its own. Texts of any length go
through whole, their darts in parts; an empty table gives an empty one; rows that repeat id and
text are one document; ties go to the smaller id, then text hash; `classes` takes `doc_id` and
`text` only, so other columns cannot clash, and `drop_near_duplicates` keeps all columns as they are.

DartMinHash: an element of weight w owns w unit columns. Darts fall on a column at the ranks
of a Poisson process that depends only on the column, so equal columns get equal darts in
every document; those below the rank t / weight are thrown (t = k ln k + 2k in all, so the
work is that of the darts, not of k hashes per element). Each dart falls on one of k
coordinates, and the earliest on each is kept. Two documents agree on a coordinate with
probability equal to their weighted Jaccard similarity.

1. Equal word sequences are one text, whatever their number; only texts go on.
2. 24 bands of 4 coordinates. Only buckets of two or more texts are kept; two pivots of each,
   chosen by hash, differ from bucket to bucket, so texts of one class meet many of them.
   Sketches (96 bits) of text and pivot are compared. Each text is linked to its nearest
   pivot, the pair verified on the exact weighted sets, and components are formed; then the
   nearest pair for each text and other component; then what pivot pairs are left between
   different components.
3. What buckets of three or more texts still hold in different components is compared inside
   tasks, in blocks of bounded number and bytes. Of each bucket the texts of its largest
   component never meet each other, only the others; so a bucket of n texts with m outside that
   component costs n * m / BLOCK^2 meetings of blocks. Buckets with more than LARGE such texts are
   split first: their texts get signatures of more coordinates to a band (8, then 12), which
   similar texts still share in one of many bands. Only pairs that join components leave the
   tasks, and no candidate is capped or dropped.

Recall: a pair at exactly 0.8 shares no band with a probability of (1 - 0.8^4)^24, 3 in a
million, and loses about as much again in each splitting and by the sketches; tests measure it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import arrow_rows, holds_nothing, mixed, pieces_of, run_hashes, word_hashes
from lodestone.llm.common import ID, TH, cut, keyed, table
from lodestone.llm.components import components

WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 4
#: Sketches of texts that differ in more bits are under the threshold: at a similarity of 0.8
#: the mean is 9.6 of 96 with a deviation of 2.9, so one pair in a million is lost here at most.
SKETCH_BITS = 24
#: Texts and bytes of a block in the last step.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Texts outside its largest component from which a bucket is split by longer bands: (rows, bands).
LARGE, FINER = 4096, ((8, 72), (12, 180))
#: Parts in which the texts of one family are joined to its number of blocks.
SALTS = 16
#: Unit columns whose darts are thrown at a time.
THROWN = 1 << 17


def columns_of(text: str | None) -> tuple[bytes, np.ndarray]:
    """Digest of a text's word sequence, and the unit columns of its weighted set, sorted.

    The n-th column of a run of words is a hash of the run and n, so that the Jaccard
    similarity of two sets of columns is the weighted one of the runs.
    """
    words = word_hashes(text)
    if not len(words):
        return b"", words
    runs = np.sort(run_hashes(words, min(WORDS, len(words))))
    again = np.flatnonzero(runs[1:] == runs[:-1]) + 1
    if len(again):
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        nth = np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs))))
        runs = runs + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest(), np.sort(mixed(runs))


def _darts(columns: np.ndarray, below: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Column places, ranks, coordinates and names of all darts on these columns under their ranks."""
    places, ranks, where, names = [], [], [], []
    at, alive, most, rank, step = np.arange(len(columns)), columns, below, np.zeros(len(columns)), 0
    while len(alive):
        # A few darts a column at a time: more where the bound is far away.
        far = float((most - rank).min())
        ahead = math.ceil(far) if far > 4 else 1
        draw = mixed(alive[:, None] + (np.arange(step, step + ahead, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        thrown = rank[:, None] - np.cumsum(np.log1p(-((draw >> np.uint64(11)).astype(float) * 2.0**-53)), axis=1)
        hit = thrown < most[:, None]
        places.append(np.broadcast_to(at[:, None], hit.shape)[hit])
        ranks.append(thrown[hit])
        other = mixed(draw[hit] ^ np.uint64(0xE7037ED1A0B428DB))
        where.append((other % np.uint64(k)).astype(np.int64))
        names.append(mixed(other))
        on = hit[:, -1]
        at, alive, most, rank, step = at[on], alive[on], most[on], thrown[on, -1], step + ahead
    return tuple(np.concatenate(x) if x else np.empty(0) for x in (places, ranks, where, names))


def dart_signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k coordinates of each set, each the name of the earliest dart on it; sets are not empty."""
    out = np.zeros((len(sets), k), np.uint64)
    wanted = {i: (k * math.log(k) + 2 * k) / len(c) for i, c in enumerate(sets)}
    while wanted:
        # Sets whose bounds are alike are thrown at together; large sets go in parts.
        groups: dict[int, list[int]] = {}
        for i, below in wanted.items():
            groups.setdefault(math.frexp(below)[1], []).append(i)
        again: dict[int, float] = {}
        for members in groups.values():
            room, batch = 0, []
            for i in [*members, None]:
                if batch and (i is None or room + len(sets[i]) > THROWN):
                    short = _throw(sets, batch, wanted, k, out)
                    again.update({j: 2 * wanted[j] for j in short})
                    room, batch = 0, []
                if i is not None:
                    batch.append(i)
                    room += len(sets[i])
        wanted = again
    return out


def _throw(sets: list[np.ndarray], batch: list[int], below: dict[int, float], k: int, out: np.ndarray) -> list[int]:
    """Fill the batch's rows of `out`; the members of which a coordinate was not hit come back."""
    least, names = np.full(len(batch) * k, np.inf), np.zeros(len(batch) * k, np.uint64)
    owner = np.repeat(np.arange(len(batch)), [len(sets[i]) for i in batch])
    columns = np.concatenate([sets[i] for i in batch])
    bound = np.repeat([below[i] for i in batch], [len(sets[i]) for i in batch])
    for at in range(0, len(columns), THROWN):
        part = slice(at, at + THROWN)
        places, ranks, where, called = _darts(columns[part], bound[part], k)
        spot = owner[part][places] * k + where
        order = np.argsort(-ranks, kind="stable")  # of several darts on a spot the last one written is the earliest
        order = order[ranks[order] < least[spot[order]]]
        least[spot[order]], names[spot[order]] = ranks[order], called[order]
    out[batch] = names.reshape(len(batch), k)
    return [i for i, full in zip(batch, np.isfinite(least).reshape(len(batch), k).all(axis=1)) if not full]


def dart_min_hash(columns: np.ndarray, k: int) -> np.ndarray:
    """The signature of one set."""
    return dart_signatures([columns], k)[0]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Columns that two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity from two sorted arrays of unit columns."""
    both = shared(a, b)
    return both / max(1, len(a) + len(b) - both)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> list[int]:
    return run_hashes_of_rows(signature[: bands * rows].reshape(bands, rows)).astype(np.int64).tolist()


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Identity columns, `text_id` (digest of the words; null without words), `keys` and `sketch`."""
    types = {ID: pa.int64(), TH: pa.int64(), "text_id": pa.binary(), "keys": pa.list_(pa.int64()), "s1": pa.int64(), "s2": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_nothing("minhash")
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            found = [columns_of(text) for text in batch.column(2).to_pylist()]
            drawn = iter(dart_signatures([columns for text_id, columns in found if text_id], bands * rows))
            out = []
            for doc, th, (text_id, _) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found):
                if not text_id:
                    out.append((doc, th, None, [], 0, 0))
                    continue
                signature = next(drawn)
                bits = np.packbits((signature & np.uint64(1)).astype(np.uint8), bitorder="little")
                s1, s2 = np.frombuffer(np.pad(bits, (0, -len(bits) % 16)).tobytes()[:16], np.int64).tolist()
                out.append((doc, th, text_id, band_keys(signature, bands, rows), s1, s2))
            yield arrow_rows(out, types)

    return docs.select(ID, TH, "text").mapInArrow(run, f"{ID} long, {TH} long, text_id binary, keys array<long>, s1 long, s2 long")


def run_hashes_of_rows(values: np.ndarray) -> np.ndarray:
    """One hash for each row, different for equal rows of different number."""
    total = mixed(np.arange(1, len(values) + 1, dtype=np.uint64))
    for j in range(values.shape[1]):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
    return total


def column_sets(texts: DataFrame) -> DataFrame:
    """`text_id`, `columns`: each text's unit columns as packed 64-bit numbers."""
    types = {"text_id": pa.binary(), "columns": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            yield arrow_rows([(i, columns_of(t)[1].tobytes()) for i, t in zip(*(c.to_pylist() for c in batch.columns))], types)

    return texts.select("text_id", "text").mapInArrow(run, "text_id binary, columns binary")


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (`a`, `b`) of at least this similarity."""

    @F.pandas_udf("boolean")
    def alike(x, y):
        import pandas as pd

        return pd.Series([similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= similar for a, b in zip(x, y)], dtype=bool)

    left = sets.select(F.col("text_id").alias("a"), F.col("columns").alias("a_set"))
    right = sets.select(F.col("text_id").alias("b"), F.col("columns").alias("b_set"))
    # The sets' sizes alone rule out most pairs before Python sees them.
    n, m = F.octet_length("a_set"), F.octet_length("b_set")
    sized = pairs.select("a", "b").join(left, "a").join(right, "b").where(F.least(n, m) >= F.lit(similar) * F.greatest(n, m))
    return sized.where(alike("a_set", "b_set")).select("a", "b")


def finer_keys(texts: DataFrame, rows: int, bands: int) -> DataFrame:
    """`key`, `text_id`: bands of more coordinates from signatures of their own; texts: `text_id`, `columns`."""
    types = {"text_id": pa.binary(), "keys": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole, 64)):
            ids = batch.column(0).to_pylist()
            drawn = dart_signatures([np.frombuffer(c, np.uint64) for c in batch.column(1).to_pylist()], rows * bands)
            yield arrow_rows([(i, band_keys(s, bands, rows)) for i, s in zip(ids, drawn)], types)

    return texts.select("text_id", "columns").mapInArrow(run, "text_id binary, keys array<long>").select("text_id", F.explode("keys").alias("key"))


def judged(rest: DataFrame) -> DataFrame:
    """`key`, `text_id`, `label`, `minor` (outside the bucket's largest component), that one (`major`) and `m`, the number of those.

    Buckets with texts of one component only are left out. Sizes of components are counted
    before they meet, so no bucket comes together.
    """
    sizes = rest.groupBy("key", "label").agg(F.count("*").alias("size"))
    buckets = cut(sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("most"), F.sum("size").alias("n"), F.count("*").alias("labels")).where("labels > 1"))
    known = buckets.select("key", F.col("most.label").alias("major"), (F.col("n") - F.col("most.size")).alias("m"))
    return rest.join(known, "key").select("key", "text_id", "label", (F.col("label") != F.col("major")).alias("minor"), "major", "m")


def crossing_links(rest: DataFrame, sketches: DataFrame, sets: DataFrame, similar: float, most: int) -> DataFrame:
    """Verified pairs (`a`, `b`) between components; rest: `key`, `text_id`, `label` of the buckets left.

    Large buckets are split by longer bands as long as there are any. Texts are dealt to blocks:
    those of buckets with the same largest component together, that component's and the others' apart,
    so that the many buckets of one group make few blocks. Blocks
    that meet in some bucket meet in a task, which compares their texts across components and
    sends on only what joins two components it had not joined before: no pair leaves it otherwise.
    """
    level = cut(judged(rest))
    kept = level
    for rows, bands in FINER:
        large = cut(level.where(F.col("m") > LARGE).select("text_id", "label").distinct())
        if large.isEmpty():
            break
        kept = kept.where(F.col("m") <= LARGE)
        level = cut(judged(finer_keys(large.join(sets, "text_id"), rows, bands).join(large, "text_id")))
        kept = kept.unionByName(level)

    weighed = sets.select("text_id", F.octet_length("columns").alias("bytes"))
    home = kept.groupBy("text_id", "label").agg(F.max_by(F.struct("major", "minor"), F.struct("m", "key")).alias("family")).join(weighed, "text_id")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES))
    sizes = home.groupBy("family").agg(parts.alias("parts"))
    part = F.pmod(F.xxhash64("text_id"), F.col("parts"))
    # A family may hold many texts: it is joined in SALTS parts.
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt_home = home.withColumn("salt", F.pmod(F.xxhash64("text_id", F.lit(1)), F.lit(SALTS)).cast("int"))
    placed = cut(dealt_home.join(salted, ["family", "salt"]).select("text_id", "label", F.xxhash64("family", part).alias("block")))
    spots = cut(kept.select("key", "text_id", "minor").join(placed, "text_id").groupBy("key", "block").agg(F.max("minor").alias("minor")))
    # In a bucket, a block with texts outside the largest component meets every block, and no others meet.
    x, y = spots.where("minor").alias("x"), spots.alias("y")
    met = x.join(y, F.col("x.key") == F.col("y.key")).select(F.least("x.block", "y.block").alias("i"), F.greatest("x.block", "y.block").alias("j")).distinct()
    sides = F.array_distinct(F.array("i", "j"))
    asked = cut(met.select(F.xxhash64("i", "j").alias("task"), F.col("i") == F.col("j"), F.explode(sides).alias("block")).toDF("task", "alone", "block"))
    texts = cut(placed.join(sketches, "text_id").join(sets, "text_id"))
    dealt = asked.join(texts, "block").select("task", "alone", "block", "text_id", "label", "s1", "s2", "columns")

    def of_task(rows: list[tuple]) -> list[tuple]:
        root: dict[bytes, bytes] = {}

        def find(label: bytes) -> bytes:
            while (up := root.get(label, label)) != label:
                label = up
            return label

        alone, found = rows[0][1], []
        block, label = np.array([r[2] for r in rows]), [r[4] for r in rows]
        number = {name: i for i, name in enumerate(dict.fromkeys(label))}
        if len(number) == 1:
            return []
        component = np.array([number[name] for name in label])
        s1, s2 = np.array([r[5] for r in rows]).view(np.uint64), np.array([r[6] for r in rows]).view(np.uint64)
        columns = [np.frombuffer(r[7], np.uint64) for r in rows]
        size = np.array([len(c) for c in columns])
        # Shared columns of one text with all others at once: who holds each of its columns.
        every = np.concatenate(columns)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(rows)), size)[order]
        for k in range(1, len(rows)):
            differ = np.bitwise_count(s1[:k] ^ s1[k]) + np.bitwise_count(s2[:k] ^ s2[k])
            near = (differ <= most) & (component[:k] != component[k]) & (np.minimum(size[:k], size[k]) >= similar * np.maximum(size[:k], size[k]))
            if not alone:
                near &= block[:k] != block[k]
            at = np.flatnonzero(near)
            if not len(at):
                continue
            if len(at) > 8:
                low, high = np.searchsorted(every, columns[k]), np.searchsorted(every, columns[k], side="right")
                n = high - low
                holders = owner[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
                both = np.bincount(holders, minlength=len(rows))[at]
            else:
                both = np.array([shared(columns[j], columns[k]) for j in at.tolist()])
            for j in at[both >= similar * (size[at] + size[k] - both) - 1e-9].tolist():
                p, q = find(label[j]), find(label[k])
                if p != q and similarity(columns[j], columns[k]) >= similar:
                    root[max(p, q)] = min(p, q)
                    found.append((rows[j][3], rows[k][3]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        types = {"a": pa.binary(), "b": pa.binary()}
        for batch in (piece for whole in batches for piece in pieces_of(whole, 1024)):
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += of_task(held)
                    held = []
                held.append(row)
            yield arrow_rows(out, types)
        yield arrow_rows(of_task(held) if held else [], types)

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Identity columns of every row with `text_id` and `class_of`: the least text of its class.

    class_of is null for documents without words. Rows that repeat id and text share a class.
    """
    base = keyed(docs).select(ID, TH, "text")
    signed = cut(signatures(base, bands, rows))
    texts = signed.where("text_id is not null").groupBy("text_id").agg(F.min(F.struct(ID, TH, "s1", "s2", "keys")).alias("one")).select("text_id", "one.*")
    buckets = texts.select("text_id", F.explode("keys").alias("key"))
    order = F.xxhash64("key", "text_id")
    ends = cut(buckets.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).where("n > 1"))
    members = cut(buckets.join(ends, "key").select("key", "text_id", "n", ((order == F.col("low")) | (order == F.col("high"))).alias("pivot")))
    known = cut(texts.join(members.select("text_id").distinct(), "text_id", "left_semi"))

    d, k = base.alias("d"), known.select(ID, TH, "text_id").alias("k")
    sources = d.join(k, F.col(f"d.{ID}").eqNullSafe(F.col(f"k.{ID}")) & (F.col(f"d.{TH}") == F.col(f"k.{TH}")))
    # Rows that repeat id and text repeat their set, which is then taken once.
    sets = cut(column_sets(sources.select("k.text_id", "d.text")).groupBy("text_id").agg(F.first("columns").alias("columns")))

    # Each member of a bucket meets the bucket's pivots; sketches are there already, so few pairs go on.
    sketched = members.join(known.select("text_id", "s1", "s2"), "text_id").select("key", F.col("text_id").alias("a"), "s1", "s2", "pivot")
    pivots = sketched.where("pivot").select("key", F.col("a").alias("b"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    differ = F.expr("bit_count(s1 ^ p1) + bit_count(s2 ^ p2)")
    most = SKETCH_BITS * bands * rows // 96
    star = cut(sketched.join(pivots, "key").where("a <> b").select("a", "b", differ.alias("differ")).where(F.col("differ") <= most).distinct())

    links, labels = None, None

    def label_of(df: DataFrame, column: str, name: str) -> DataFrame:
        named = labels.select(F.col("node").alias(column), F.col("label").alias(name))
        return df.join(named, column, "left").withColumn(name, F.coalesce(name, column))

    def apart(found: DataFrame) -> DataFrame:
        return label_of(label_of(found, "a", "la"), "b", "lb").where("la <> lb")

    def nearest(found: DataFrame, *by: str) -> DataFrame:
        return found.groupBy(*by).agg(F.min_by("b", F.struct("differ", "b")).alias("b")).select("a", "b")

    def linked(found: DataFrame) -> bool:
        """Verify pairs and form components anew; says whether there were any."""
        nonlocal links, labels
        new = cut(verified(found, sets, similar))
        if links is not None and new.isEmpty():
            return False
        links = new if links is None else links.union(new)
        labels = components(links)
        return True

    def in_turn(found: DataFrame) -> None:
        """First the nearest pair of each text and component, then the others still apart."""
        first = cut(nearest(apart(found), "a", "lb"))
        linked(first)
        linked(apart(found).select("a", "b").join(first, ["a", "b"], "left_anti"))

    linked(nearest(star, "a"))
    in_turn(star)

    # Pairs without a pivot exist in buckets of three or more that hold several components.
    rest = cut(label_of(members.where("n > 2").select("key", "text_id"), "text_id", "label"))
    late = cut(crossing_links(rest, known.select("text_id", "s1", "s2"), sets, similar, most))
    if not late.isEmpty():
        links = links.union(late)
        labels = components(links)
    return label_of(signed.select(ID, TH, "text_id"), "text_id", "class_of")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """`doc_id`, `class_id` (least id of the class), `class_size` and `kept`: one row per row of docs.

    The kept document of a class is the one with the least id, then text hash. A null id
    comes first and its class has a null class_id. Rows that repeat id and text count once.
    """
    member = cut(near_duplicates(docs, similar).dropDuplicates([ID, TH]))
    by_class = member.where("class_of is not null").groupBy("class_of")
    groups = cut(by_class.agg(F.min(F.struct(ID, TH)).alias("first"), F.count("*").alias("n")).where("n > 1"))
    known = cut(member.join(groups, "class_of").select(ID, TH, "first", "n"))
    rows = keyed(docs.select("doc_id", "text")).drop("text").alias("r")
    k = known.alias("k")
    joined = rows.join(k, F.col(f"r.{ID}").eqNullSafe(F.col(f"k.{ID}")) & (F.col(f"r.{TH}") == F.col(f"k.{TH}")), "left")
    return joined.select(
        "r.doc_id",
        F.when(F.col("n").isNull(), F.col(f"r.{ID}")).otherwise(F.col(f"first.{ID}")).alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
        (F.col("n").isNull() | (F.col(f"first.{ID}").eqNullSafe(F.col(f"r.{ID}")) & (F.col(f"first.{TH}") == F.col(f"r.{TH}")))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """`docs` without all but the first document of each class."""
    member = cut(near_duplicates(docs, similar))
    groups = cut(member.where("class_of is not null").groupBy("class_of").agg(F.min(F.struct(ID, TH)).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = cut(member.join(groups, "class_of").where(F.struct(ID, TH) != F.col("first")).select(ID, TH))
    d, g = keyed(docs).alias("d"), later.alias("g")
    return d.join(g, F.col(f"d.{ID}").eqNullSafe(F.col(f"g.{ID}")) & (F.col(f"d.{TH}") == F.col(f"g.{TH}")), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
