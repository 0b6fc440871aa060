"""Line, substring and near dedup against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lines, minhash, substrings


def brute_lines(texts, run=3, least=50):
    seqs, seen, gone = [], set(), {}
    for d, text in texts:
        content = [(i, x.strip(" \t\r")) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\r")]
        seqs.append((d, content))
    for d, content in seqs:
        for s in range(len(content)):
            for n in range(1, run + 1):
                key = tuple(x for _, x in content[s : s + n])
                if len(key) < n or (n < run and sum(x.count(" ") + 1 for x in key) < least):
                    continue
                if key in seen:
                    gone.setdefault(d, set()).update(i for i, _ in content[s : s + n])
                seen.add(key)
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ())) for d, t in texts}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    texts = [(d, "\n".join(rng.choice(["alpha", "beta", " gamma ", "", "delta", f"own {d}"]) for _ in range(rng.randint(0, 12)))) for d in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.kept_text for r in lines.line_dedup(docs).collect()}
    assert got == brute_lines(texts)


def test_runs_of_few_lines_and_many_words(spark):
    rng = random.Random(12)
    long = [" ".join(f"p{k}w{i}" for i in range(n)) for k, n in enumerate((20, 30, 49, 50, 70, 1))]
    texts = [(d, "\n".join(rng.choice([*long, f"own {d}", ""]) for _ in range(rng.randint(0, 6)))) for d in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.kept_text for r in lines.line_dedup(docs).collect()}
    assert got == brute_lines(texts)


def test_line_dedup_of_a_hundred_thousand_lines(spark):
    own = [f"line {i}" for i in range(100_000)]
    texts = [(1, "\n".join(own)), (2, "\n".join(["before"] + own[500:])), (3, "\n".join(["same"] * 100_000))]
    began = time.monotonic()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed").collect()}
    assert got == {1: (100_000, 0), 2: (99_501, 99_500), 3: (100_000, 99_999)} and time.monotonic() - began < 120


def test_line_dedup_messy(spark, messy):
    got = lines.line_dedup(messy.withColumn("N_LINES", F.lit("x")))
    rows = got.collect()
    assert len(rows) == messy.count() and "n_tokens" in got.columns
    second = [r for r in rows if r.doc_id == 2 and r.n_lines == 4]
    assert len(second) == 2 and all(r.kept_text == "other" and r.n_removed == 3 for r in second)
    assert lines.line_dedup(messy.limit(0)).count() == 0


def brute_substrings(texts, window=50):
    first, words = {}, {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_dedup_against_brute_force(spark, hot):
    rng = random.Random(2)
    passages = [[f"p{k}w{rng.randint(0, 9)}" for _ in range(rng.randint(45, 90))] for k in range(6)]
    texts = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.7 else [f"u{d}x{rng.randint(0, 99)}" for _ in range(rng.randint(1, 60))]
        texts.append((d, rng.choice([" ", "\n", "\u00a0 "]).join(words)))
    texts += [(60, texts[3][1]), (61, None), (62, "the same word " * 200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.substring_dedup(docs, hot=hot).collect()}
    assert got == brute_substrings(texts)


def test_substring_dedup_messy(spark, messy):
    rows = substrings.substring_dedup(messy.withColumn("N_WORDS", F.lit("x"))).collect()
    assert len(rows) == messy.count()
    assert [r.n_removed for r in rows if r.doc_id == 6] == [30_000]
    digest = substrings.substring_dedup(messy, digest_only=True).where("doc_id = 3").first()
    assert digest.kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert substrings.substring_dedup(messy.limit(0)).count() == 0


def brute_classes(docs, similar=0.8):
    sets = {i: minhash.columns_of(t) for i, t in docs}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a][1], sets[b][1]
            if len(x) and len(y) and minhash.similarity(x, y) >= similar:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    bases = [[f"b{k}w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 150))] for k in range(8)]
    docs = []
    for d in range(150):
        words = list(rng.choice(bases)) if d % 3 else [f"d{d}w{i}" for i in range(40)]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 10**6)}"
        docs.append((d, " ".join(words)))
    docs += [(150, docs[1][1]), (151, docs[1][1].upper() + "!"), (152, "two words"), (153, "Two words."), (154, ""), (155, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = minhash.classes(frame).collect()
    want = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in rows} == want
    assert sorted(r.doc_id for r in rows if r.kept) == sorted(set(want.values()))
    left = minhash.drop_near_duplicates(frame)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for n in (3, 50, 2000):
        a = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        x, y = np.sort(a[:n]), np.sort(np.concatenate([a[: n // 2], a[n : n + n - n // 2]]))
        agree = np.mean(minhash.dart_min_hash(x, 3000) == minhash.dart_min_hash(y, 3000))
        assert agree == pytest.approx(minhash.similarity(x, y), abs=0.05)
    heavy = minhash.columns_of("a b c d e " * 30)[1]
    assert len(np.unique(heavy)) == len(heavy) == 146


def test_near_duplicates_messy(spark, messy):
    rows = minhash.classes(messy).collect()
    assert len(rows) == messy.count()
    assert {r.class_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert all(r.class_size == 1 for r in rows if r.doc_id in (3, 4, 7))
    assert minhash.drop_near_duplicates(messy).count() == messy.count() - 1
    assert minhash.classes(messy.limit(0)).count() == 0


def test_crossing_links_join_what_brute_force_joins(spark, monkeypatch):
    """All texts in two buckets, each a component of its own, in many small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng, base, texts = random.Random(9), [f"w{i}" for i in range(120)], []
    for d in range(70):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        texts.append((d, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    signed = minhash.signatures(minhash.keyed(docs)).cache()
    sets = minhash.column_sets(signed.join(docs, signed[minhash.ID] == docs["doc_id"]).select("text_id", "text"))
    key = F.filter(F.array(F.when(F.col(minhash.ID) < 45, 1), F.when(F.col(minhash.ID) > 25, 2)), lambda k: k.isNotNull())
    rest = signed.select(F.explode(key.cast("array<long>")).alias("key"), F.lit(45).cast("long").alias("n"), "text_id", F.col("text_id").alias("label"))
    links = minhash.crossing_links(rest, signed.select("text_id", "s1", "s2"), sets, 0.8, 96)
    name = {bytes(r.text_id): r[minhash.ID] for r in signed.collect()}
    columns = {d: minhash.columns_of(t)[1] for d, t in texts}
    got = [(name[bytes(r.a)], name[bytes(r.b)]) for r in links.collect()]
    want = [(a, b) for a in columns for b in columns if a < b and (b < 45 or a > 25) and minhash.similarity(columns[a], columns[b]) >= 0.8]

    def groups(pairs):
        root = {d: d for d in columns}
        for a, b in pairs:
            a, b = find(root, a), find(root, b)
            root[max(a, b)] = min(a, b)
        return {d: find(root, d) for d in columns}

    def find(root, d):
        while root[d] != d:
            d = root[d]
        return d

    # Blocks may also find true links outside the buckets; none of a bucket may be lost.
    assert all(minhash.similarity(columns[a], columns[b]) >= 0.8 for a, b in got)
    joined = groups(got)
    assert all(joined[a] == joined[b] for a, b in want)
