"""Word hashes against words, and batches cut by bytes."""

import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import arrays


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet="aAbß éİ_1-\n日😀́", max_size=30), max_size=5))
def test_equal_words_have_equal_hashes(texts):
    known = {}
    for text in texts:
        words = re.findall(r"\w+", text.lower())
        hashes = arrays.word_hashes(text).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_parts_of_long_texts_agree(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 40))) for _ in range(500))
    whole = arrays.word_hashes(text)
    monkeypatch.setattr(arrays, "PART", 25)
    assert (arrays.word_hashes(text) == whole).all()


def test_pieces_are_bounded_by_bytes_and_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([None, "x" * 100] * 20)], names=["i", "t"])
    for size, rows in ((250, 256), (10, 256), (10_000, 7), (1 << 20, 256)):
        pieces = list(arrays.pieces_of(batch, rows, size))
        assert pa.Table.from_batches(pieces).column("i").to_pylist() == list(range(40))
        assert all(p.num_rows <= rows and (sum(len(t or "") for t in p.column(1).to_pylist()) <= max(size, 100)) for p in pieces)
    assert list(arrays.pieces_of(batch.slice(0, 0))) == []


def test_what_another_operator_left_goes_back_to_the_system(monkeypatch):
    freed = []
    monkeypatch.setattr(arrays, "given_back", lambda: freed.append(dict(arrays._held)))
    arrays.held("a", 1, lambda: "model")
    assert arrays.held("a", 1, lambda: "another") == "model" and freed == [{}]
    arrays.holds_nothing("b")
    arrays.holds_nothing("b")
    assert "a" not in arrays._held and freed == [{}, {}]
