"""Decontamination, toxicity, URL and licence filters, exact search, and the pipeline."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, licenses, mtree, toxicity, urls


def test_planted_items_are_found(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    rng, rows = random.Random(5), []
    for k, (item, text) in enumerate(texts.items()):
        around = [" ".join(f"x{rng.randint(0, 999)}" for _ in range(rng.randint(0, 90))) for _ in range(2)]
        words = text.split()
        if k % 3 == 1 and len(words) >= 50:
            words[len(words) // 2] = "changed"
        rows.append((item, f"{around[0]} {' '.join(words).upper() if k % 2 else text} {around[1]}"))
    rows += [(1000 + i, " ".join(f"y{rng.randint(0, 999)}" for _ in range(300))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, items).collect()}
    assert {d for d, _ in got} == set(texts) and all((i, i) in got for i in texts)
    assert all(s >= 0.8 for s in got.values())
    left = decontaminate.drop_contaminated(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == list(range(1000, 1020)) and left.columns == docs.columns


def test_every_window_by_brute_force(sf_dir):
    import duckdb

    con = duckdb.connect()
    docs = con.execute(f"SELECT text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    index = decontaminate.Items(items, decontaminate.RADIUS, decontaminate.SIMILAR)
    got = {(m[0], m[1]) for m in index.matches([t for (t,) in docs])}
    want = set()
    for place, (text,) in enumerate(docs):
        words = decontaminate.word_hashes(text)
        known = set(decontaminate.run_hashes(words, 5).tolist()) if len(words) >= 5 else set()
        for item, size, runs, (_, item_text) in zip(index.ids, index.sizes, index.runs, items):
            own = decontaminate.run_hashes(decontaminate.word_hashes(item_text), 5)
            if len(known.intersection(own.tolist())) < 0.5 * len(own):
                continue
            for s in range(len(words) - size + 1):
                window = decontaminate.weighted_runs(words[s : s + size])
                both = len(np.intersect1d(window, runs))
                if both / (len(window) + len(runs) - both) >= 0.8:
                    want.add((place, item))
                    break
    assert got == want


def test_large_and_small_size_classes_agree(monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(30))) for i in range(60)]
    docs = [items[i][1] + " and more" for i in range(0, 60, 7)] + [None, "", "short"]
    few = sorted(decontaminate.Items(items, 11, 0.8).matches(docs))
    monkeypatch.setattr(decontaminate, "FEW", 100)
    assert few == sorted(decontaminate.Items(items, 11, 0.8).matches(docs)) and len(few) == 9


def test_decontaminate_messy(spark, messy):
    items = spark.createDataFrame([(1, "third line here fourth line here"), (2, None), (3, ""), (4, "at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(messy, items).collect()}
    assert got == {(1, 1), (None, 4)}
    assert decontaminate.contaminated(messy, items.limit(0)).count() == 0
    assert decontaminate.contaminated(messy.limit(0), items).count() == 0


def test_shortened_copies_are_found_wherever_they_lie(spark):
    rng = random.Random(11)
    items = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(50))) for i in range(30)]
    index = decontaminate.Items(items, decontaminate.RADIUS, decontaminate.SIMILAR)
    short = [text.rsplit(" ", 1)[0] for _, text in items]
    alone = [[m[1:] for m in index.matches([t])] for t in short]
    assert [m[0][0] for m in alone] == list(range(30))
    assert [m for m in index.matches(short + ["", None])] == [(k, *m[0]) for k, m in enumerate(alone)]
    docs = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.contaminated(docs.repartition(n), frame).collect())) for n in (1, 13))
    assert one == many and len(one) == 30


@pytest.mark.parametrize("size", [20, 45, 59, 98])
def test_edited_copies_are_found(size):
    rng, items, copies = random.Random(size), [], []
    while len(items) < 300:
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(size)]
        copy, n, edits = list(words), rng.randint(1, size // 10), rng.choice([1, 1, 2])
        for at in rng.sample([0, rng.randint(0, size - n), size - n], edits):
            copy[at : at + n] = [f"e{rng.randint(0, 10**9)}" for _ in range(n)]
        a, b = (decontaminate.weighted_runs(decontaminate.word_hashes(" ".join(x))) for x in (words, copy))
        both = len(np.intersect1d(a, b))
        if both / (len(a) + len(b) - both) >= 0.8:
            items.append((len(items), " ".join(words)))
            copies.append(f"before it {' '.join(copy)} and after")
    index = decontaminate.Items(items, decontaminate.RADIUS, decontaminate.SIMILAR)
    assert [m[:2] for m in index.matches(copies)] == [(i, i) for i in range(300)]
    least = -(-4 * (size - 4) // 5) + 4  # words of the shortest similar copy
    for cut in (slice(0, least), slice(size - least, size)):
        assert [m[:2] for m in index.matches([" ".join(t.split()[cut]) for _, t in items])] == [(i, i) for i in range(300)]


def test_items_of_one_to_three_words(spark):
    items = [(1, "Lorem"), (2, "lorem ipsum"), (3, "dolor sit amet"), (4, "amet"), (5, "lorem"), (6, "sit ipsum")]
    texts = ["x lorem y lorem", "Lorem ipsum", "a b c dolor sit amet", "lorem", "ipsum lorem", "dolor sit", None, "amets " * 5000]
    index = decontaminate.Items(items, decontaminate.RADIUS, decontaminate.SIMILAR)
    want = [(0, 1, 1), (0, 5, 1), (1, 1, 0), (1, 2, 0), (1, 5, 0), (2, 3, 3), (2, 4, 5), (3, 1, 0), (3, 5, 0), (4, 1, 1), (4, 5, 1)]
    assert [(m[0], m[1], m[3]) for m in index.matches(texts)] == want
    assert [m for k, t in enumerate(texts) for m in [(k, *x[1:]) for x in index.matches([t])]] == list(index.matches(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame(items[:1], "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [2, 5, 6, 7]


def test_item_blocks(spark, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 20)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == whole


INSULTS = ("idiot", "moron", "scum")


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = random.Random(7), [], []
    plain = [f"{a}{b}" for a in ("lan", "mor", "tes", "ver", "sol") for b in ("dine", "tal", "ken", "ra", "is")]
    for d in range(1500):
        words, toxic = [rng.choice(plain) for _ in range(25)], d % 5 == 0
        if toxic:
            words[rng.randrange(25)] = rng.choice(INSULTS)
        docs.append((d, " ".join(words)))
        labels.append((d, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_the_held_out_fold(labelled):
    docs, labels = labelled
    rows = toxicity.scores(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == r.toxic == (r.score >= 0.5) for r in rows if r.held_out)


def test_obfuscated_words_are_restored(spark, labelled):
    docs, labels = labelled
    said = ["you 1d1ot", "such a m0r0n here", "an i d i o t", "sccccum", "a m-o-r-o-n", "id-i-o-t", "id-io-t m-o-r-on", "idіоt", "mor0n!", "lovely landine talken", None, "", "8 9 1 0 !!"]
    asked = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.scores(asked, toxicity.fit(docs, labels)).collect()}
    assert [got[i] for i in range(len(said))] == [1] * 9 + [0] * 4


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    costs = toxicity.triple_costs([(int(t), int(n)) for t, n in zip(rng.integers(0, 64**3, 4000), rng.integers(1, 500, 4000))])
    restorer, mean = toxicity.Restorer(costs), float(costs[0, 0, 0])
    choice = random.Random(5)
    for _ in range(300):
        signs = [choice.choice("abdiost01$!7аі") for _ in range(choice.randint(1, 6))]
        if choice.random() < 0.5:
            signs[choice.randrange(len(signs))] = signs[0]
        best = {}
        for path in itertools.product(*(toxicity.options_of(signs, at, mean) for at in range(len(signs)))):
            a = b = 0
            cost = 0.0
            for letter, extra in path:
                cost += extra
                if letter:
                    c = int(toxicity.CLASS_OF[ord(letter)])
                    cost += costs[a, b, c]
                    a, b = b, c
            cost += costs[a, b, 0] if a or b else 0.0
            word = "".join(letter for letter, _ in path)
            best[word] = min(cost, best.get(word, cost))
        cost, word = restorer.viterbi(signs)
        assert cost == pytest.approx(min(best.values())) and best[word] == pytest.approx(cost)


def test_long_spots_are_restored_in_linear_time():
    restorer = toxicity.Restorer(toxicity.triple_costs([]))
    assert len(restorer.viterbi(list("a1" * 50_000))[1]) >= 50_000


def test_toxicity_counts_features_in_parts(monkeypatch):
    texts = [f"word{'abcdefghij'[n % 10]} only{'abcdefghij'[n // 10]}{'klmnopqrst'[n % 10]}" for n in range(100)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([n % 2 for n in range(102)], pa.int64())], names=["text", "toxic"])
    restorer, want = toxicity.Restorer(toxicity.triple_costs([])), {}
    for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
        for f in {"", *(f for w in toxicity.words_of(text, restorer) for f in toxicity.features_of(w))}:
            want.setdefault(f, [0, 0])[1 - toxic] += 1
    monkeypatch.setattr(toxicity, "COUNTED", 20)
    monkeypatch.setattr(toxicity, "SENT", 7)
    got = {}
    for part in toxicity.feature_counts(iter([batch, batch.slice(0, 0)]), restorer):
        assert part.num_rows <= 7
        for f, n1, n0 in zip(*(c.to_pylist() for c in part.columns)):
            got[f] = [a + b for a, b in zip(got.get(f, [0, 0]), (n1, n0))]
    assert got == want and want[""] == [51, 51]


def test_toxicity_messy(spark, messy, labelled):
    _, labels = labelled
    empty = labels.limit(0)
    rows = toxicity.scores(messy, toxicity.fit(messy, empty)).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 0)], labels.schema))
    assert toxicity.drop_toxic(messy, odd).columns == messy.columns
    assert toxicity.scores(messy.limit(0), toxicity.fit(messy.limit(0), empty)).count() == 0


def test_rules_and_reputation(spark):
    pages = [(i, f"http://bad.evil.org/x/{i}") for i in range(40)] + [(100 + i, f"http://good.fine.org/{i}") for i in range(40)]
    pages += [(200, "HTTP://WWW.Example.com/en/a?b"), (201, "x://example.com/en/"), (202, "http://a.net/es/1#z"), (203, "http://net"), (204, None), (205, "nothing"), (206, "http://other.evil.org"), (207, "http://xexample.com/en/"), (208, "a://É.NET/fr/")]
    labels = [(i, 0 if i < 40 else 1, 0) for i, _ in pages if i < 140] + [(0, 1, None), (None, 0, 1)]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("mean", F.lit("mine"))
    rows = {r.page_id: r for r in urls.judged(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [rows[i].verdict for i in (0, 100, 200, 201, 202)] == ["block", "allow", "allow", "block", "block"]
    assert (rows[200].host, rows[200].path, rows[200].rule) == ("www.example.com", "/en/a", "www.example.com/en/")
    assert (rows[203].host, rows[203].path, rows[203].rule) == ("net", "", None) and (rows[204].host, rows[205].host) == ("", "")
    assert rows[207].rule == "com/" and rows[208].host == "É.net" and rows[208].rule == "net/fr/"
    assert rows[206].bad_share > rows[100].bad_share and rows[0].mean == "mine"
    assert urls.judged(frame.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_reputation_under_two_label_suffixes_as_sql(spark, tmp_path):
    """co.uk hosts, repeated rows and columns named as results are, against the SQL."""
    import duckdb
    from compare import duck_rows, spark_rows

    hosts = ["a.bad.co.uk", "b.bad.co.uk", "www.good.co.uk", "x.com.au", "co.uk", "fine.org", "a.b.c.fine.org", "", "one"]
    pages = [(i, f"http://{hosts[i % 9]}/p/{i}") for i in range(180)] + [(0, "http://a.bad.co.uk/p/0"), (500, None)]
    labels = [(i, int("bad" not in hosts[i % 9]), 0) for i in range(150)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    own, sql = spark_rows(urls.op6_url_filters(spark, str(tmp_path))), duck_rows(con, urls.SQL)
    assert own[0] == sql[0] and set(own[1]) == set(sql[1])
    clash = frame.withColumns({"HOST": F.lit(1), "__host": F.lit(2), "verdict": F.lit("v"), "n": F.lit(3)})
    judged = urls.judged(clash, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert judged.count() == 182 and judged.where("verdict = 'v'").count() == 0 and "n" in judged.columns


def test_licence_variants_and_odd_rows(spark):
    long = "filler words here. " * 60_000
    rows = [
        (1, "// SPDX-License-Identifier: MIT\ncode"), (2, "SPDX-License-Identifier: Apache-2.0"), (3, f"{long} Distributed under the Boost Software License, Version 1.0. {long}"),
        (4, "Released under the MIT License."), (4, "Released under the MIT License."), (None, "This is free and unencumbered software released into the public domain."),
        (5, "Released under the MIT License. Released under the MIT License."), (6, ""), (7, None),
    ]
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in rows], "doc_id long, text string, license string, place int")
    got = {(r.doc_id, r.license): r.n_found for r in licenses.license_scan(docs).collect()}
    assert got == {(1, "MIT"): 1, (2, "Apache-2.0"): 1, (3, "BSL-1.0"): 1, (4, "MIT"): 1, (None, "Unlicense"): 1, (5, "MIT"): 2}
    assert len({sid for sid, _ in licenses.SENTENCES}) == len(licenses.SENTENCES) == len({s for _, s in licenses.SENTENCES})
    assert {i for _, rule in licenses.RULES for i in rule.split()} <= {sid for sid, _ in licenses.SENTENCES}


def test_licences(spark, messy):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    rows = [(1, f"code\n{mit}"), (2, "Prose. Licensed under CC BY-NC 4.0. More. Licensed under CC BY-NC 4.0."), (3, "permission is hereby granted"), (4, None)]
    got = {(r.doc_id, r.license): (r.n_found, r.first_sentence) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"): (1, 1), (2, "CC-BY-NC-4.0"): (2, 1)}
    assert licenses.license_scan(messy).count() == 0 and licenses.license_scan(messy.limit(0)).count() == 0


@pytest.mark.parametrize("page,nodes", [(5, 3), (512, 64)])
def test_search_against_brute_force(spark, page, nodes):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(400)] + [(i, [0.5] * 6) for i in range(400, 460)]
    vectors += [(500, None), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] + [0.0] * 5), (650, [float("inf")] + [0.0] * 5), (700, [0.0] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.exact_top_k(frame, nodes=nodes, page=page, sample=60).collect()]
    sound = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(np.int64) for r in frame.collect() if r.embedding and None not in r.embedding and np.isfinite(np.array(r.embedding, float)).all()}
    want = []
    for q in sorted(v for v in sound if v % 50 == 0):
        best = sorted((-int(sound[q] @ x), i) for i, x in sound.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == want


def test_search_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.exact_top_k(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (None, [1.0, 1.0])], schema)
    assert [(r.query_id, r.vec_id) for r in mtree.exact_top_k(few).collect()] == [(0, 1)]


def test_search_of_lengths_repeated_ids_and_large_numbers(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [1.0, 1.0]), (2, [5.0]), (50, [2.0]), (100, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, v, "x", 9) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score int")
    got = sorted((r.query_id, r.vec_id, r.score) for r in mtree.exact_top_k(frame).collect())
    n = 256 * 256
    want = [(0, 0, 5 * n), (0, 0, 3 * n), (0, 1, 3 * n)]  # of the twice given row
    want += [(0, 0, 3 * n), (0, 0, 3 * n), (0, 1, 3 * n)]  # of the other row of this id
    assert got == sorted(want + [(50, 2, 10 * n)])
    assert sorted(r["rank"] for r in mtree.exact_top_k(frame).where("query_id = 0").collect()) == [1, 1, 2, 2, 3, 3]
    with pytest.raises(OverflowError):
        mtree.exact_top_k(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns and 0 < out.count() <= docs.count()
        docs = out
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.select("doc_id").distinct().count() == final.count() > 0
    assert final.where("n_tokens < 0").count() == 0


def test_pipeline_stages_of_odd_rows(spark, messy, tmp_path):
    """Null ids, null, empty and very long texts, repeated rows, empty tables and columns named as results are."""
    item = "a b c d e f g h i j"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    more = spark.createDataFrame([(20, f"before {item} after", "en", "a", 5), (21, "first line here\nsecond line here\nthird line here", "en", "a", 6)], messy.schema)
    docs = messy.union(more).withColumns({"n_lines": F.lit("mine"), "kept_text": F.lit(7), "class_id": F.lit(8), "score": F.lit(9), "n_chars": F.length("text").cast("long")})
    stages = [name for name, _ in corpus_pipeline.STAGES][:-1]
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        out = stage(spark, docs, str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns
        rows = out.collect()
        if name in stages:
            assert out.columns == docs.columns and all((r.n_lines, r.kept_text, r.class_id, r.score) == ("mine", 7, 8, 9) for r in rows)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        docs = spark.createDataFrame(rows, out.schema).cache()
    assert None in {r.doc_id for r in rows} and {3, 4, 5} <= {r.doc_id for r in rows} and 20 not in {r.doc_id for r in rows}


def test_index_of_few_items_a_size_is_small():
    """Sizes of a few items keep which values are near, not whose they are."""
    from lodestone.llm import decontaminate

    known = decontaminate.Items([(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(2, 60)], 15, 0.8)
    held = sum(a.nbytes for _, blocks in known.index.values() for block in blocks for a in block if a is not None)
    assert held <= 58 * 4 * 65536
