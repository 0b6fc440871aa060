"""Texts and hashes as numpy arrays, and Arrow batches of bounded size, for work inside tasks.

Words are hashed without a table of known ones: each character and its place in the word give a
64-bit number and a word's hash is their sum, so memory does not grow with the vocabulary and
words of any length are handled alike.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Characters that are worked on at a time.
PART = 1 << 20
#: Rows and bytes of what Python holds of an Arrow batch.
ROWS, BYTES = 256, 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, from the words' hashes."""
    once, size = mixed(words), len(words) - n + 1
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += once[j : size + j]
    return mixed(total)


@functools.lru_cache(maxsize=1)
def word_letters() -> np.ndarray:
    r"""Which code points `\w` takes."""
    return np.array([c == 95 or chr(c).isalnum() for c in range(0x110000)])


def codes_of(text: str) -> np.ndarray:
    """Code points of a text, in bytes where they fit."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each unbroken run of marked places."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    if len(inside) and inside[-1]:
        edges = np.append(edges, len(inside))
    return edges[::2], edges[1::2]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span of a text, spans in order and apart; a part of the text at a time."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PART, side="right")))
        lengths = ends[at:to] - starts[at:to]
        firsts = np.cumsum(lengths) - lengths
        nth = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
        letters = codes[nth + np.repeat(starts[at:to], lengths)].astype(np.uint64)
        out[at:to] = np.add.reduceat(mixed(letters + (nth.astype(np.uint64) << np.uint64(21))), firsts)
        at = to
    return out


def word_hashes(text: str | None) -> np.ndarray:
    r"""A hash for each word (lower-cased `\w+`) of a text."""
    codes = codes_of((text or "").lower())
    starts, ends = spans(word_letters()[codes])
    return span_hashes(codes, starts, ends)


def pieces_of(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes (one row at least), so that what Python holds of it stays small."""
    heavy = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    if not heavy or batch.nbytes <= size:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    weight = np.zeros(batch.num_rows + 1, np.int64)
    for column in heavy:
        weight[1:] += np.asarray(pc.fill_null(pc.binary_length(column), 0))
    ends = np.cumsum(weight)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, ends[at] + size, side="right")) - 1 - at
        n = min(max(1, fits), rows, batch.num_rows - at)
        yield batch.slice(at, n)
        at += n


def arrow_rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def arrow_map(df: DataFrame, rows_of: Callable[..., Iterator[tuple]], schema: str, types: dict[str, pa.DataType]) -> DataFrame:
    """One call of rows_of for each row, its results sent on in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(rows_of(*row))
                if len(out) > 20_000:
                    yield arrow_rows(out, types)
                    out = []
            yield arrow_rows(out, types)

    return df.mapInArrow(run, schema)


_held: dict[str, tuple[object, object]] = {}


def given_back() -> None:
    """What is free in this process goes back to the system: else it stays with the worker as long as that lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def held(kind: str, key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one thing at a time.

    Workers are used again by later stages, so whatever another operator left goes first.
    """
    if kind not in _held or _held[kind][0] != key:
        _held.clear()
        given_back()
        _held[kind] = key, make()
    return _held[kind][1]


def holds_nothing(kind: str) -> None:
    """For operators that keep nothing between tasks: what others left goes."""
    held(kind, None, lambda: None)
