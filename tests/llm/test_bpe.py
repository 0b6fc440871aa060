"""The encoder against the library, and the round trip."""

import hashlib
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe, tokencounts

PATH = bpe.tokenizer_file()


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    with open(PATH, encoding="utf-8") as f:
        return bpe.Bpe(f.read()), library


def check(both, text):
    own, library = both
    ids = np.frombuffer(own.encode(text), "<u4")
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(both, text):
    check(both, text)


def test_hard_texts(both):
    rng = random.Random(3)
    parts = ["a", "aa", "ing", " the", "'s", "'re", "\n\n", "  ", "<|endoftext|>", "<|endof", "0", "½", "é", "ß", "\x1c", "\x85", "\u3000", "\u200b", "日本", "😀", "\u0301"]
    for _ in range(400):
        check(both, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
    for text in ("", " ", "a" * 5000, "ab" * 3000, "=" * 4000, "é" * 2000, "<|endoftext|>" * 50):
        check(both, text)


def test_query_digests(spark, sf_dir, both):
    _, library = both
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = bpe.op3_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_messy_rows(spark, messy):
    got = bpe.digests(messy, PATH).collect()
    assert len(got) == messy.count() and sum(r.n_tokens == 0 for r in got) == 2
    full = bpe.encode_documents(messy, PATH, keep=("lang", "n_tokens")).collect()
    assert {r.decoded for r in full} == {r.text or "" for r in messy.collect()}
    assert bpe.digests(messy.limit(0), PATH).count() == 0


def test_token_counts(spark, messy, both):
    _, library = both
    got = {}
    for r in tokencounts.token_counts(messy.where("doc_id <> 2"), PATH).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.begin, r.end, r.n_tokens))
    for r in messy.where("doc_id <> 2").collect():
        text = r.text or ""
        spans = library.encode(text, add_special_tokens=False).offsets
        lines, at = [], 0
        for k, line in enumerate(text.split("\n")):
            end = at + len(line) + (k < text.count("\n"))
            if end > at:
                lines.append((at, end))
            at = end
        want = [(k, b, e, sum(b <= s < e for s, _ in spans)) for k, (b, e) in enumerate(lines)]
        assert sorted(got.get(r.doc_id, [])) == want
    assert tokencounts.token_counts(messy.limit(0), PATH).count() == 0


def test_border_rules():
    first, end = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12])
    begins, ends = np.array([0, 5, 7]), np.array([5, 7, 12])
    assert tokencounts.counts(first, end, begins, ends, "first").tolist() == [2, 1, 1]
    assert tokencounts.counts(first, end, begins, ends, "most").tolist() == [2, 0, 2]
    assert tokencounts.counts(first, end, begins, ends, "shared").sum() == pytest.approx(4)


def test_odd_sections(spark):
    """Null sections and bounds, ends before begins, ties, repeated rows and columns named as results are."""
    kind = "doc_id long, text string, s array<struct<name:string,begin:int,end:int>>, section string, n_tokens string"
    own = [None, ("a", None, 5), ("b", 3, None), (None, 0, 5), ("c", 9, 2), ("d", 5, 21), ("e", 5, 21)]
    rows = [(1, "hello brave new world", own, "x", "y")] * 2 + [(None, None, own, "x", "y"), (2, "text", None, "x", "y"), (3, "", [], "x", "y")]
    for rule in tokencounts.RULES:
        got = [(r.doc_id, r.section, r["name"], r.begin, r.end, r.n_tokens) for r in tokencounts.token_counts(spark.createDataFrame(rows, kind), PATH, rule, "s").collect()]
        assert len(got) == 21 and sum(g[5] for g in got if g[0] is None) == 0
        first = sorted(g for g in got if g[0] == 1)
        assert first[0] == first[1] and [g[5] for g in first[::2]] == [0, 0, 0, 1, 0, 3, 3]
        assert [g[2:5] for g in first[::2]][:5] == [(None, None, None), ("a", None, 5), ("b", 3, None), (None, 0, 5), ("c", 9, 2)]


def test_given_sections(spark):
    rows = spark.createDataFrame([(1, "hello brave new world", [("title", 0, 5), ("rest", 5, 21), ("none", 50, 60)])], "doc_id long, text string, s array<struct<name:string,begin:int,end:int>>")
    got = {r["name"]: r.n_tokens for r in tokencounts.token_counts(rows, PATH, "most", "s").collect()}
    assert got == {"title": 1, "rest": 3, "none": 0}


def test_files_of_other_kinds_are_refused():
    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)
    bpe.check(model)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.check(model | change)


def test_long_unbroken_texts_are_not_remembered(both):
    own, _ = both
    before = len(own)
    own.encode("x" * 10_000)
    assert len(own) == before and len(own.decode(np.frombuffer(own.encode("y" * 100_000), "<u4"))) == 100_000
