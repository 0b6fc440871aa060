"""Benchmark decontamination (operator 8) by SimHash windows and multi-index Hamming search.

Texts are lower-cased runs of `\\w+`. A window that is similar to an item shares most of its
five-word runs, so at least one of any few of them: a text that holds none of an item's rarest
runs (a fifth of them and one more) has no such window. Only the other texts get fingerprints.

For each item size every window of that many words of such a text gets a 64-bit SimHash of its
word pairs: running sums of the pairs' +1/-1 votes give each window by one subtraction.

Items' fingerprints are indexed by four blocks of 16 bits. Fingerprints within 15 bits of each
other differ by at most 3 in one block, so looking each block of a window up among the values
within 3 bits of an item's block finds every item within the radius. Each candidate is then
verified by the exact weighted Jaccard similarity of the five-word runs of item and window
(0.8 or more), and a document's best window for each item is reported. Similar windows may lie
outside the radius (copies cut short at a text's end most of all), so where a text holds one of
an item's rarest runs and no window was found, every window that shares enough runs is verified.

Of several best windows the first one is reported. What is found depends on the text alone, not
on its neighbours or partitions. Every pair within the radius is found, and by the telling runs
every window that is similar at all, so recall at 0.8 is 1 (tests compare with brute force).

Null and empty texts have no windows; items without words match nothing; items of two to four
words are one run, and items of one word are looked up among a text's words. Rows are handled one
by one, so repeated rows give repeated results; `contaminated` takes two columns of each table, so
others cannot clash, and `drop_contaminated` keeps all columns as they are. Texts of any length go
through whole, in overlapping parts. Empty tables give an empty result.

The benchmark is broadcast in blocks of bounded rows and bytes, through the driver one at a time;
a larger one costs a further pass over the documents for each block.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import arrow_rows, held, mixed, pieces_of, run_hashes, word_hashes
from lodestone.llm.common import table

SIMILAR, WORDS, RADIUS = 0.8, 5, 15
#: Items and bytes of one broadcast; a larger benchmark goes over the documents once for each block.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
#: Items of one size up to which a window found by a block is compared with each.
FEW = 16
#: Window starts that are worked on at a time, or as many as the largest item has words.
PART = 4096


def votes(words: np.ndarray) -> np.ndarray:
    """Running sums of the votes (+1, -1) of each word pair, or of the only word: 64 to a row.

    Set bits are summed four to a 64-bit number, as no sum reaches 16 bits here, and each bit
    that is not set counts -1. Longer rows than 16 bits can sum are summed in 32.
    """
    pairs = run_hashes(words, min(2, len(words)))
    lane = np.uint16 if len(pairs) < 30_000 else np.uint32
    bits = np.zeros((len(pairs) + 1, 64), lane)
    bits[1:] = np.unpackbits(pairs.view(np.uint8), bitorder="little").reshape(-1, 64)
    sums = np.cumsum(bits.view(np.uint64), axis=0).view(np.int16 if lane is np.uint16 else np.int32)
    sums <<= 1
    sums -= np.arange(len(sums), dtype=sums.dtype)[:, None]
    return sums


def packed(more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows between two rows of running sums."""
    return np.packbits(np.greater(more, less).ravel(), bitorder="little").view(np.uint64)


def weighted_runs(words: np.ndarray) -> np.ndarray:
    """Sorted columns of a weighted set: equal runs are told apart by their number."""
    runs = np.sort(run_hashes(words, min(WORDS, len(words))))
    first = np.concatenate([[0], np.flatnonzero(runs[1:] != runs[:-1]) + 1])
    nth = np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs))))
    return np.sort(mixed(runs + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def near_values(distance: int) -> np.ndarray:
    """All 16-bit masks of at most so many bits."""
    return np.array([sum(1 << b for b in bits) for n in range(distance + 1) for bits in itertools.combinations(range(16), n)], np.uint32)


class Items:
    """A block of items, their fingerprints indexed by size and block of bits."""

    def __init__(self, rows: list[tuple[int, str]], radius: int, similar: float):
        self.radius, self.similar = radius, similar
        self.ids, self.sizes, self.runs = [], [], []
        self.single: dict[int, list[int]] = {}
        prints: list[int] = []
        several: list[np.ndarray] = []
        for item, text in rows:
            words = word_hashes(text)
            if len(words):
                self.ids.append(item)
                self.sizes.append(len(words))
                self.runs.append(weighted_runs(words))
                if len(words) == 1:
                    self.single.setdefault(int(words[0]), []).append(len(self.ids) - 1)
                else:
                    several.append(words)
                sums = votes(words)
                prints.append(int(packed(sums[-1:], sums[:1])[0]))
        self.prints = np.array(prints, np.uint64)
        by_size: dict[int, list[int]] = {}
        for k, size in enumerate(self.sizes):
            if size > 1:
                by_size.setdefault(size, []).append(k)
        self.single_words = np.array(sorted(self.single), np.uint64)
        masks = near_values(radius // 4)
        self.index = {}
        for size, members in by_size.items():
            blocks = []
            for b in range(4):
                values = (self.prints[members] >> np.uint64(16 * b)).astype(np.uint32) & 0xFFFF
                near = (values[:, None] ^ masks[None, :]).ravel()
                if len(members) <= FEW:  # which of them is near is not looked up
                    known = np.zeros(65536, bool)
                    known[near] = True
                    blocks.append((known, None, None, None))
                    continue
                owner = np.repeat(np.array(members, np.int32), len(masks))
                order = np.argsort(near, kind="stable")
                counts = np.bincount(near, minlength=65536).astype(np.int32)
                blocks.append((counts > 0, counts, np.cumsum(counts, dtype=np.int32) - counts, owner[order]))
            self.index[size] = np.array(members), blocks
        self.largest = max(by_size, default=0)
        self._telling([k for k, size in enumerate(self.sizes) if size > 1], several)

    def _telling(self, members: list[int], words: list[np.ndarray]) -> None:
        """By length: runs of which a text with a match holds one, their items, and whether a run has certain first 20 bits.

        Of an item's n runs a similar window shares n * similar or more, so it shares one of any
        n + 1 less that number; the ones taken are those of the fewest items.
        """
        plain = [run_hashes(w, min(WORDS, len(w))) for w in words]
        self.plain = {item: np.unique(r) for item, r in zip(members, plain)}
        known, owners = np.unique(np.concatenate([*self.plain.values(), np.empty(0, np.uint64)]), return_counts=True)
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, w, r in zip(members, words, plain):
            few = len(r) + 1 - math.ceil(len(r) * self.similar - 1e-9)
            rarest = np.unique(r[np.lexsort((r, owners[np.searchsorted(known, r)]))[:few]])
            by_length.setdefault(min(WORDS, len(w)), []).append((rarest, np.full(len(rarest), item, np.int32)))
        self.told = {}
        for length, parts in by_length.items():
            told, owner = (np.concatenate(x) for x in zip(*parts))
            order, begins = np.argsort(told, kind="stable"), np.zeros(1 << 20, bool)
            begins[told >> np.uint64(44)] = True
            self.told[length] = told[order], owner[order], begins

    def suspects(self, hashed: list[np.ndarray]) -> list[tuple[int, int]]:
        """(text's place, item) where the text holds a telling run; one over two texts is no harm."""
        row, ends = np.concatenate(hashed), np.cumsum([len(text) for text in hashed])
        found: set[tuple[int, int]] = set()
        for length, (told, owner, begins) in self.told.items():
            if len(row) >= length:
                runs = run_hashes(row, length)
                some = np.flatnonzero(begins[runs >> np.uint64(44)])
                first = np.searchsorted(told, runs[some])
                n = np.searchsorted(told, runs[some], side="right") - first
                at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
                places = np.searchsorted(ends, np.repeat(some, n), side="right")
                found.update(zip(places.tolist(), owner[at].tolist()))
        return sorted(found)

    def _likely(self, item: int, text: np.ndarray) -> list[int]:
        """Starts of the windows of a text that share enough runs with an item to be similar to it."""
        size, length = self.sizes[item], min(WORDS, self.sizes[item])
        if len(text) < length:
            return []
        runs = run_hashes(text, length)
        shared = np.concatenate([[0], np.cumsum(np.isin(runs, self.plain[item]))])
        begins = np.arange(len(runs))
        ends = np.minimum(begins + size - length + 1, len(runs))
        both = shared[ends] - shared[begins]
        return np.flatnonzero(both >= self.similar * (ends - begins + len(self.runs[item]) - both) - 1e-9).tolist()

    def near(self, prints: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """Windows and items of this size within the radius, each pair once."""
        values, (members, blocks) = prints.view(np.uint16).reshape(-1, 4), self.index[size]
        hit = blocks[0][0][values[:, 0]]
        for b in range(1, 4):
            hit |= blocks[b][0][values[:, b]]
        some = np.flatnonzero(hit)
        pairs: set[tuple[int, int]] = set()
        if len(members) <= FEW:  # one of a few items: as quick to compare as to tell which
            for item in members.tolist():
                close = np.bitwise_count(prints[some] ^ self.prints[item]) <= self.radius
                pairs.update((w, item) for w in some[close].tolist())
            return iter(pairs)
        for b, (known, counts, begins, owner) in enumerate(blocks):
            mine = some[known[values[some, b]]]
            n = counts[values[mine, b]]
            at = np.arange(n.sum()) + np.repeat(begins[values[mine, b]] - np.cumsum(n) + n, n)
            window, item = np.repeat(mine, n), owner[at]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            pairs.update(zip(window[close].tolist(), item[close].tolist()))
        return iter(pairs)

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
        """(text's place, item, similarity, first word, words): each text's best window for each item.

        The texts' words stand in one row, so that short texts share numpy's calls. Filler that
        matches nothing follows each, so that a text's end gets the same windows wherever it lies.
        """
        hashed = [word_hashes(t) for t in texts]
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        if self.single:
            for place, text in enumerate(hashed):
                known, at = np.unique(text, return_index=True)
                for word in np.flatnonzero(np.isin(known, self.single_words, assume_unique=True)):
                    for item in self.single[int(known[word])]:
                        best[place, item] = 1.0, int(at[word]), 1
        filler = mixed(np.arange(1, self.largest + 1, dtype=np.uint64))
        suspects = self.suspects(hashed)
        places = sorted({place for place, _ in suspects})
        sizes = np.array([len(hashed[place]) for place in places], np.int64)
        firsts = np.cumsum(sizes + len(filler)) - sizes - len(filler)
        words = np.concatenate([a for place in places for a in (hashed[place], filler)] or [filler[:0]])
        step = max(PART, self.largest)
        for begin in range(0, len(words), step):
            part = words[begin : begin + step + self.largest]
            sums = votes(part)
            for size in self.index:
                pairs, n = size - 1, min(len(part) - size + 1, step)
                if n > 0:
                    for window, item in self.near(packed(sums[pairs : pairs + n], sums[:n]), size):
                        start = begin + window
                        k = int(np.searchsorted(firsts, start, side="right")) - 1
                        at = start - int(firsts[k])
                        if at < sizes[k]:
                            self._verify(item, places[k], range(max(0, at - 1), at + 2), hashed[places[k]], best)
        for place, item in suspects:
            if (place, item) not in best:
                self._verify(item, place, self._likely(item, hashed[place]), hashed[place], best)
        for (place, item), (alike, start, size) in sorted(best.items()):
            yield place, self.ids[item], alike, start, size

    def _verify(self, item: int, place: int, starts: Iterable[int], text: np.ndarray, best: dict) -> None:
        """Similarity of an item to the windows of its size of a text."""
        size, runs = self.sizes[item], self.runs[item]
        for s in starts:
            window = text[s : s + size]
            if len(window):
                found = weighted_runs(window)
                both = len(np.intersect1d(found, runs, assume_unique=True))
                alike = both / (len(found) + len(runs) - both)
                if alike >= self.similar and (alike, -s) > (best.get((place, item), (0.0, 0))[0], -best.get((place, item), (0.0, 0))[1]):
                    best[place, item] = alike, s, len(window)


def items_of(rows: Broadcast, radius: int, similar: float) -> Items:
    """The index of a broadcast block; a worker keeps the last one."""
    return held("items", (rows.value[0], radius, similar), lambda: Items(rows.value[1], radius, similar))


def item_blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The benchmark in blocks of at most ITEMS rows and about ITEM_BYTES (one item at least), each small enough to broadcast."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-2 * total["n"] // ITEMS), -(-2 * total["bytes"] // ITEM_BYTES))  # by hash, so blocks are about half full
    spread = items.select(F.col("item_id").cast("long"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"))
    for part in range(parts):
        block, held_bytes = [], 0
        rows = spread.where(F.col("part") == part).select("item_id", "text") if parts > 1 else spread.select("item_id", "text")
        for item, text in itertools.chain(rows.toLocalIterator(), [(None, None)] if part == parts - 1 else []):
            weight = 64 + len((text or "").encode())
            if block and (len(block) == ITEMS or held_bytes + weight > 2 * ITEM_BYTES):
                yield items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted(block, key=str)))
                block, held_bytes = [], 0
            block.append((item, text))
            held_bytes += weight
        if block:
            yield items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted(block, key=str)))


def contaminated(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """`doc_id`, `item_id`, `similarity`, `first_word`, `n_words`: a document's best window for each item."""
    types = {"doc_id": pa.int64(), "item_id": pa.int64(), "similarity": pa.float64(), "first_word": pa.int64(), "n_words": pa.int64()}
    found = None
    for block in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            known = items_of(block, radius, similar)
            for batch in (piece for whole in batches for piece in pieces_of(whole)):
                ids, texts = (c.to_pylist() for c in batch.columns)
                yield arrow_rows([(ids[m[0]], *m[1:]) for m in known.matches(texts)], types)

        chosen = docs.select(F.col("doc_id").cast("long"), "text")
        part = chosen.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """`docs` without the documents that hold a window of an item. No shuffle: rows are judged where they lie."""
    at = docs.columns.index("text")
    for block in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            known = items_of(block, radius, similar)
            for batch in (piece for whole in batches for piece in pieces_of(whole)):
                hit = {m[0] for m in known.matches(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
