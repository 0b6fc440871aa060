"""Token counts by section (operator 5) with offset-mapped attribution.

Each document is encoded once, whole. Its tokens' byte lengths give their spans, which are
mapped to characters and joined as intervals to the document's sections: for each section the
tokens that overlap it form one range, found by binary search. A token that crosses a border
goes to its sections by an explicit rule:

- `first`: the section that holds its first character;
- `most`: the section that holds most of its characters, the earlier one on ties;
- `shared`: each section, in proportion to the characters it holds (counts are then fractions).

Sections are given as an array of (name, begin, end) in characters, begin included and end not,
in any order, overlapping or not; without one, each line with its line feed is a section.
Tokens outside all sections, and sections outside the text, count nothing; so do sections that are
null, whose begin or end is null, or that end before they begin: they keep their place, name and
bounds and get 0. A token that holds only a part of a character counts as holding it. Null and
empty texts have no sections of their own (given ones get zero). Rows are counted one by one, so
repeated rows and null ids need no care; texts of any length go through whole; an empty table
gives an empty one. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import pieces_of
from lodestone.llm.bpe import Bpe, coder, tokenizer_file, vocabulary
from lodestone.llm.common import table

RULES = ("first", "most", "shared")


def token_spans(bpe: Bpe, data: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of a text; data is the text in UTF-8."""
    sizes = bpe.size[np.frombuffer(bpe.encode(text), "<u4")]
    ends = np.cumsum(sizes)
    if len(data) == len(text):
        return ends - sizes, ends
    # Characters begun up to and with each byte.
    begun = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return begun[ends - sizes] - 1, begun[ends - 1]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each line, with its line feed."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    if len(codes) and (not len(ends) or ends[-1] < len(codes)):
        ends = np.append(ends, len(codes))
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends


def counts(first: np.ndarray, end: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Tokens are in order, so those that touch a section are a range."""
    low, high = np.searchsorted(end, begins, side="right"), np.searchsorted(first, ends, side="left")
    if rule == "first":
        return np.maximum(np.searchsorted(first, ends, side="left") - np.searchsorted(first, begins, side="left"), 0).astype(float)
    high = np.where(ends > begins, high, low)  # an empty section holds nothing
    out = np.maximum(high - low, 0).astype(float)
    # Only a section's first and last tokens can cross its borders.
    held: dict[int, list[tuple[float, int]]] = {}
    for s, (a, b, lo, hi) in enumerate(zip(begins.tolist(), ends.tolist(), low.tolist(), high.tolist())):
        for t in {lo, hi - 1} if hi > lo else ():
            inside = (min(b, int(end[t])) - max(a, int(first[t]))) / int(end[t] - first[t])
            if inside < 1:
                out[s] -= 1
                held.setdefault(t, []).append((inside, s))
    for parts in held.values():
        if rule == "shared":
            for inside, s in parts:
                out[s] += inside
        else:
            out[max(parts, key=lambda p: (p[0], -begins[p[1]], -p[1]))[1]] += 1
    return out


def token_counts(docs: DataFrame, path: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """`doc_id`, `section` (from 0), `name`, `begin`, `end`, `n_tokens` (double if shared, else long)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    vocab = vocabulary(docs.sparkSession, path)
    number = pa.float64() if rule == "shared" else pa.int64()
    names = ["doc_id", "section", "name", "begin", "end", "n_tokens"]
    chosen = docs.select("doc_id", "text", *([sections] if sections else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocab)
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            rows, columns = [], []
            given = batch.column(2).to_pylist() if sections else [None] * batch.num_rows
            for at, (text, own) in enumerate(zip(batch.column(1).to_pylist(), given)):
                text = text or ""
                first, end = token_spans(bpe, text.encode(), text)
                if sections:
                    given_spans = [(s["name"], s["begin"], s["end"]) if s else (None, None, None) for s in own or []]
                    said = [(b, e) for _, b, e in given_spans]
                    called = [n for n, _, _ in given_spans]
                    whole = np.array([(0, 0) if b is None or e is None else (b, max(b, e)) for b, e in said], np.int64).reshape(-1, 2)
                    begins, ends = whole[:, 0], whole[:, 1]
                else:
                    begins, ends = line_sections(text)
                    called, said = [None] * len(begins), None
                rows += [at] * len(begins)
                said = list(zip(begins.tolist(), ends.tolist())) if said is None else said
                columns.append((np.arange(len(begins)), called, said, counts(first, end, begins, ends, rule)))
            joined = [np.concatenate([c[i] for c in columns]) if columns else np.empty(0) for i in (0, 3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(joined[0].astype(np.int64)),
                    pa.array([n for c in columns for n in c[1]], pa.string()),
                    pa.array([b for c in columns for b, _ in c[2]], pa.int64()),
                    pa.array([e for c in columns for _, e in c[2]], pa.int64()),
                    pa.array(joined[1].astype(float if rule == "shared" else np.int64), number),
                ],
                names=names,
            )

    schema = chosen.select("doc_id").schema
    for name, kind in zip(names[1:], ("long", "string", "long", "long", "double" if rule == "shared" else "long")):
        schema = schema.add(name, kind)
    return chosen.mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; the documents' sums are their whole counts."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file()).drop("name")
