"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text, vector
from lodestone.operators import chunks, fts, fusion, graph, lifecycle, store, temporal, vectors, watch, workspaces
from lodestone.plans.catalog import QUERIES
from lodestone.streaming import watching


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([(a, b) for a, b in zip("ABCD", "BCDE")], "source string, target string").select(
        F.concat("source", "target").alias("id"), F.lit("related_to").alias("edge_type"), "source", "target", F.lit(1.0).alias("weight")
    )


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def test_chain_graph(spark, chain):
    assert ids(graph.bfs(chain, seeds(spark, "A"), 2)) == list("ABC")
    assert ids(graph.bfs(chain, seeds(spark, "A"), 4)) == list("ABCDE")
    middle = graph.bfs(chain, seeds(spark, "C"), 1)
    assert ids(middle) == list("BCD")
    assert ids(graph.subgraph_edges(chain, middle, 1)) == ["BC", "CD"]
    assert ids(graph.bfs(chain, seeds(spark, "X"), 3)) == ["X"]


def test_shortest_path(spark, chain):
    pairs = spark.createDataFrame([("A", "D"), ("E", "C"), ("B", "B"), ("A", "X")], "from_id string, to_id string")
    got = {(r.from_id, r.to_id): r.path for r in graph.shortest_path(chain, pairs, 3).collect()}
    assert got == {("A", "D"): list("ABCD"), ("E", "C"): list("EDC"), ("B", "B"): ["B"]}


def test_pagerank_sums_to_one(spark, chain):
    ranks = graph.pagerank(chain, spark.createDataFrame([("s", "A")], "seed_set string, seed string"), 0.5, 5)
    got = {r.id: r.score for r in ranks.collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert got["A"] > got["B"] > got["C"]


def test_bit_pattern_and_hamming(spark):
    rows = spark.createDataFrame([([0.5, -0.3, 0.0, 0.1, -0.9, 0.8, -0.1, 0.2], [1.0, 1.0, -1.0, -1.0], [1.0, -1.0, 1.0, -1.0])], "a array<double>, b array<double>, c array<double>")
    r = rows.select(vector.sign_code(F.col("a")).alias("code"), vector.hamming(vector.sign_code(F.col("b")), vector.sign_code(F.col("c"))).alias("h")).first()
    assert r.code == [0b10101001] and r.h == 2


def test_vector_order_upsert_and_dimensions(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0]), ("c", [-1.0, 0.0, 0.0, 0.0]), ("z", [0.0] * 4)], "id string, v array<double>")
    query = spark.createDataFrame([("q", [0.9, 0.1, 0.0, 0.0])], "qid string, q array<double>")
    got = [(r.id, r.score) for r in vectors.batch_top_k(rows, query, 4).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["a", "b", "z", "c"] and got[2][1] == 0.0
    versions = rows.withColumn("t", F.lit(1)).union(rows.where("id = 'a'").withColumn("v", F.reverse("v")).withColumn("t", F.lit(2)))
    assert vectors.latest(versions, "id", F.col("t")).where("id = 'a'").first().v == [0.0, 0.0, 0.0, 1.0]
    with pytest.raises(Exception, match="expected 5 dimensions"):
        vectors.of_dimension(rows, 5).collect()


def test_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("v"))
    queries = rows.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    best = vectors.batch_top_k(rows, queries, 1)
    assert all(r.qid == r.id for r in best.collect()) and best.count() == 10


def test_approximate_recall(spark, sf_dir):
    exact, near = QUERIES["vec_batch_topk"](spark, sf_dir), QUERIES["ivf_topk"](spark, sf_dir)
    assert vectors.recall(exact, near, 10).agg(F.avg("recall")).first()[0] >= 0.9


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_approximate_search_joins_no_pairs(spark):
    rows = spark.range(40).select(F.col("id").cast("string").alias("id"), F.array(F.col("id") - 20.5, F.lit(1.0), F.col("id") % 3 - 0.5).alias("v"))
    queries = rows.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    near, exact = vectors.ivf_top_k(rows, queries, 3, 4, 1.0), vectors.batch_top_k(rows, queries, 3)
    assert "Join" not in plan_of(near)
    assert sorted(near.collect()) == sorted(exact.collect())


def test_codes_join_no_pairs(spark):
    rows = spark.createDataFrame([(str(i), [float((i >> b & 1) * 2 - 1) for b in range(70)]) for i in range(64)], "id string, v array<double>")
    queries = rows.where("id in ('5', '9')").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    near = vectors.hamming_top_k(rows, queries, 4)
    assert "Join" not in plan_of(near)
    brute = {q: sorted((bin(i ^ q).count("1"), str(i)) for i in range(64))[:4] for q in (5, 9)}
    assert {q: [(r.distance, r.id) for r in near.where(F.col("qid") == str(q)).orderBy("rank").collect()] for q in (5, 9)} == brute
    assert near.where("rank = 4").first().similarity == round(1 - 1 / 70, 6)


def test_best_chunks_join_no_pairs(spark):
    rows = spark.createDataFrame([(i % 3 or None, i, [float(i % 5), 1.0]) for i in range(30)], "doc int, chunk long, v array<double>")
    queries = rows.where("chunk < 2").select(F.col("chunk").alias("qid"), F.col("v").alias("q"))
    pairs = chunks.pair_scores(rows, queries)
    assert "Join" not in plan_of(pairs)
    got = {(r.qid, r.doc): (round(r.score, 6), r.best_chunk) for r in chunks.max_sim(pairs).collect()}
    assert len(got) == 6 and got[0, 1] == (1.0, 10) and got[0, None] == (1.0, 0) and got[1, 1] == (1.0, 1) and got[1, 2] == (1.0, 11)


def test_walks_keep_only_what_they_reach(spark, monkeypatch):
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(cut(df)) or written[-1])
    ring = spark.range(50).select(F.col("id").cast("string").alias("source"), ((F.col("id") + 1) % 50).cast("string").alias("target"), F.lit(2.0).alias("weight"))
    assert len(ids(graph.bfs(ring, seeds(spark, "7"), 2))) == 5
    assert max(df.count() for df in written) == 2
    written.clear()
    ranks = {r.id: r.score for r in graph.pagerank(ring, spark.createDataFrame([("s", "7")], "seed_set string, seed string"), 0.5, 10).collect()}
    assert sorted(df.count() for df in written)[:-1] == [1] * 11
    want = {7: 1.0}
    for _ in range(10):
        want = {7: 0.5} | {n + 1: s * 0.5 for n, s in want.items()}
    assert {int(n): s for n, s in ranks.items()} == pytest.approx(want)


def test_texts_meet_labels_only_where_those_repeat(spark, sf_dir, tmp_path):
    from lodestone.sources import tables

    assert "Join" not in plan_of(tables.texts(spark, sf_dir))
    spark.createDataFrame([(1, "a", "de", "src1", 1), (2, "b", "en", "src2", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert ids(tables.texts(spark, str(tmp_path))) == ["1", "1", "2"]


def test_frequent_terms_are_not_dealt_by_term(spark):
    docs = spark.createDataFrame([(str(n), "the cat" if n % 2 else "the", []) for n in range(6)], "id string, body string, tags array<string>")
    indexed = fts.field_tokens(docs, fts.body_and_tags())
    scored = fts.bm25(indexed, spark.createDataFrame([(q, t) for q in range(3) for t in ("the", "cat")], "qid long, term string"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [field" not in plan and "LeftSemi, BuildRight" in plan
    assert scored.count() == 18


def test_search_terms(spark):
    docs = spark.createDataFrame([("1", "Quantum theory of light", ["science"]), ("2", "Gardening for all", ["home"]), ("3", "", [])], "id string, body string, tags array<string>")
    indexed = fts.field_tokens(docs, fts.body_and_tags())
    def found(*terms):
        return ids(fts.bm25(indexed, spark.createDataFrame([("q", t) for t in terms], "qid string, term string")))
    assert found("quantum") == ["1"] and found("science") == ["1"] and found("chess") == [] and found("light", "home") == ["1", "2"]
    assert ids(fts.phrase(indexed, ("theory", "of"))) == ["1"] and ids(fts.phrase(indexed, ("of", "theory"))) == []


def test_stored_postings_are_made_where_texts_lie(spark, sf_dir):
    from lodestone.plans import retrieval

    odd = [("1", "The cat, the CAT \u00e9t\u00e9 the", ["x:the"]), ("2", "\U0001f600", []), ("3", None, ["a"]), ("4", "w " * 300 + "b", [])]
    docs = spark.createDataFrame(odd, "id string, body string, tags array<string>")
    for indexed in (fts.field_tokens(docs, fts.body_and_tags()), retrieval._indexed(spark, sf_dir)):
        stored = fts.stored_postings(indexed)
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("sort_array") == 1
        # A list carried along with each of its terms takes time by the square of a text's length.
        assert not any("tokens#" in line for line in plan.splitlines() if "Generate inline(terms" in line)
        each = lambda df: sorted(map(tuple, df.select("id", "field", "term", "dl", "tf", "positions").collect()))
        assert each(stored) == each(fts.postings(indexed))
        assert sorted(fts.stored_lengths(stored).collect()) == sorted(fts.lengths(indexed).collect())
        for part in stored.select("term").rdd.map(lambda r: r.term.encode()).glom().collect():
            assert part == sorted(part)


def test_stored_postings_of_repeated_ids_are_put_together(spark, tmp_path):
    rows = [("1", "the cat", []), ("1", "the the", []), ("1", "the longer cat", []), ("2", "the cat", ["the"]), (None, "cat the", []), (None, "the cat", [])]
    indexed = fts.field_tokens(spark.createDataFrame(rows, "id string, body string, tags array<string>"), fts.body_and_tags())
    fts.stored_postings(indexed).write.parquet(f"{tmp_path}/postings")
    stored = spark.read.parquet(f"{tmp_path}/postings")
    asked = spark.createDataFrame([(0, "the"), (0, "cat")], "qid long, term string")
    each = lambda df: sorted(df.select("id", "field", "term", "dl", "tf").collect(), key=str)
    assert each(fts.of_terms(stored, ["the", "cat"])) == each(fts.matching(indexed, asked))
    scores = lambda df: sorted(((r.id or "", round(r.score, 9)) for r in df.collect()))
    assert scores(fts.bm25_of(fts.of_terms(stored, ["the", "cat"]), fts.statistics_of(fts.stored_lengths(stored)), asked)) == scores(fts.bm25(indexed, asked))


def test_rank_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "qid string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "qid string, id string, rank int")
    got = {r.id: r.score for r in fusion.rrf([a, b]).collect()}
    assert got == {"x": round(1 / 61, 6), "y": round(1 / 62 + 1 / 61, 6)}


def test_as_of_replays_the_log(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in range(1, 7)]
    rows = [
        ("n", t[0], 1, "insert", "a", 1.0, None), ("n", t[1], 2, "update_confidence", None, 0.5, None), ("n", t[2], 3, "delete", None, None, None),
        ("n", t[3], 4, "update_body", "lost", None, None), ("n", t[4], 5, "insert", "b", None, None), ("m", t[0], 6, "update_body", "x", None, None),
    ]
    log = spark.createDataFrame(rows, "node_id string, ts timestamp, seq long, op string, body string, confidence double, valid_time timestamp")
    def state(day):
        return [(r.node_id, r.body, r.confidence) for r in temporal.as_of(log, F.lit(t[day - 1])).collect()]
    assert state(1) == [("n", "a", 1.0)] and state(2) == [("n", "a", 0.5)] and state(3) == [] and state(4) == [] and state(5) == [("n", "b", None)]


def test_lifecycle_is_monotone(spark):
    import datetime as dt

    now = dt.datetime(2024, 1, 10)
    log = spark.createDataFrame([("a", now, "access", 0.0)] * 20 + [("b", now, "reinforce", 0.7)] * 2, "node_id string, ts timestamp, kind string, boost double")
    nodes = spark.createDataFrame([(i, 0.5, now - dt.timedelta(days=3)) for i in "abc"], "id string, confidence double, tx_time timestamp")
    got = {r.id: r for r in lifecycle.scored(nodes, lifecycle.factors(log), F.lit(now)).collect()}
    assert got["a"].strength > got["b"].strength > got["c"].strength and got["b"].boost == 1.0 and got["c"].recency == 0.0
    assert got["c"].state == "archived"


def test_workspace_visibility(spark):
    spaces = spark.createDataFrame([("w", "p", True, True, 1, ["group:7"]), ("p", None, False, False, 0, [])], "ws_id string, parent string, allow_shared_reads boolean, allow_promotion boolean, max_nodes int, tags array<string>")
    members = spark.createDataFrame([("w", "1", "private", None), ("p", "2", "private", None), ("x", "3", "shared", None), ("x", "4", "group", 7), ("x", "5", "private", None)], "ws_id string, node_id string, access string, group_id int")
    asked = members.select("node_id").distinct().withColumn("ws_id", F.lit("w"))
    assert ids(workspaces.visible(spaces, members, asked), "node_id") == ["1", "2", "3"]
    assert ids(workspaces.group_visible(spaces, members, asked), "node_id") == ["1", "3", "4"]
    up = workspaces.promoted(members, spaces, spark.createDataFrame([("w", "1"), ("p", "2")], "ws_id string, node_id string"))
    assert {r.node_id: r.access for r in up.collect()}["1"] == "shared" and {r.node_id: r.access for r in up.collect()}["2"] == "private"
    stamped = members.withColumn("added_at", F.current_timestamp())
    assert workspaces.merged(stamped, "x", "w", F.current_timestamp()).where("ws_id = 'w'").count() == 4


def brute_sentences(content, size, least):
    out, current, begin = [], "", 0
    for i, c in enumerate(content):
        current += c
        ends = c in ".!?" and (i + 1 == len(content) or content[i + 1].isspace())
        n = len(current.encode())
        if ends and n >= least and n >= size:
            if len(current.strip().encode()) >= least:
                out.append((begin, current.strip()))
            current, begin = "", i + 1
    if len(current.strip().encode()) >= least:
        out.append((begin, current.strip()))
    return out


def test_chunkers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    for r in docs.limit(60).collect():
        assert chunks.sentence_pieces(r.body) == brute_sentences(r.body, 512, 32)
    marked = spark.createDataFrame([("d", "# Introduction\nHello hello.\n# Methods\nWork work work.\n# Results\nGood good good.\n")], "id string, body string")
    assert [r.section for r in chunks.sections(marked, least=10).orderBy("char_offset").collect()] == ["Introduction", "Methods", "Results"]
    assert chunks.fixed(spark.createDataFrame([("d", "")], "id string, body string")).count() == 0
    assert chunks.fixed(spark.createDataFrame([("d", "word " * 40)], "id string, body string"), 50, 10, 10).count() > 1


def test_content_types(spark):
    row = spark.createDataFrame([("fn main() {\n    println!(\"x\");\n}",)], "t string").select(text.content_type_of_text(F.col("t")), text.content_type_of_extension(F.lit("RS")), text.content_type_of_extension(F.lit("png")), text.content_type_of_text(F.lit("plain prose here"))).first()
    assert list(row) == ["code", "code", "image", "text"]


def test_utf8_prefix(spark):
    for s in ("", "abc", "aéöß", "日本語", "a日b本"):
        for n in (1, 2, 3, 4, 5, 20):
            want = s.encode()[:n].decode("utf-8", errors="ignore")
            assert spark.createDataFrame([(s,)], "s string").select(text.utf8_prefix(F.col("s"), n)).first()[0] == want


def test_objects_and_deletes(spark):
    blobs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    assert store.objects(blobs, "x").count() == 2
    nodes = spark.createDataFrame([("1",), ("2",)], "id string")
    edges = spark.createDataFrame([("e", "1", "2")], "id string, source string, target string")
    log = spark.createDataFrame([], "node_id string, ts timestamp, seq bigint, op string")
    left = store.deleted({"nodes": nodes, "edges": edges, "deltas": log}, nodes.where("id = '1'"), F.lit("2024-01-01").cast("timestamp"))
    assert ids(left["nodes"]) == ["2"] and left["edges"].count() == 0 and left["deltas"].first().op == "delete"


def test_watch_filters(spark):
    paths = ["test.md", "test.rs", "test.exe", "a/.git/config.md", "node_modules/x.js", "noext"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").where(watch.watched(F.col("path")))
    assert ids(rows, "path") == ["test.md", "test.rs"]


def test_file_changes(spark):
    import datetime as dt

    t = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    rows = [
        (1, "a", "modify", t(1), "x", 5), (2, "a", "modify", t(2), "y", 5), (3, "a", "modify", t(3), "y", 5), (4, "a", "create", t(4), "y", 5),
        (5, "big", "create", t(1), "p", 2**30), (6, "big", "modify", t(2), "q", 2**30), (7, "a", "delete", t(5), None, None), (8, "new", "modify", t(1), "z", 1),
    ]
    events = spark.createDataFrame(rows, "event_id long, path string, kind string, ts timestamp, hash string, length long")
    scanned = spark.createDataFrame([("a", "x", 5)], "path string, hash string, length long")
    assert ids(watch.file_changes(events), "event_id") == [1, 2, 4, 5, 7, 8]
    assert ids(watch.file_changes(events, scanned), "event_id") == [2, 4, 5, 7, 8]


def stream_of(spark, rows, folder, parts=4):
    for part in range(parts):
        rows.where((F.col("event_id") >= part * 10) & (F.col("event_id") < part * 10 + 10)).coalesce(1).write.mode("append").parquet(folder)
    return watching.read_events(spark, folder, watching.EVENT, per_trigger=1)


def test_streams_keep_state_between_batches(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("path"), F.timestamp_seconds(F.col("id") * 1000 + (F.col("id") % 7) * 100).alias("ts"), F.sha2((F.col("id") / 5).cast("int").cast("string"), 256).alias("hash"))
    stream = stream_of(spark, rows, str(tmp_path / "in"))
    for live, batch in ((watching.debounced(stream, 2_950_000_000), watch.debounced(rows, 2_950_000_000)), (watching.changed(stream), watch.changed(rows))):
        assert ids(watching.drained(live), "event_id") == ids(batch, "event_id")


def test_streams_of_odd_events(spark, tmp_path):
    """Events before 1970 and without time or hash, and a state that is forgotten."""
    rows = [(0, 1, -86400, "a"), (1, 1, -80000, "a"), (2, 1, None, "b"), (3, 1, None, "b"), (4, 1, 0, "b"), (5, 2, 1, None), (6, 2, 2, None), (7, 2, 3, "c")]
    odd = spark.createDataFrame(rows, "event_id long, path long, s long, hash string").select("event_id", "path", F.timestamp_seconds("s").alias("ts"), "hash")
    stream = stream_of(spark, odd, str(tmp_path / "odd"), 1)
    for live, batch, want in (
        (watching.debounced(stream, 3_600_000_000), watch.debounced(odd, 3_600_000_000), [0, 1, 2, 3, 4, 5]),
        (watching.changed(stream), watch.changed(odd), [0, 2, 3, 4, 5, 7]),
    ):
        assert ids(watching.drained(live), "event_id") == ids(batch, "event_id") == want
    late = spark.createDataFrame([(0, 1, 0), (10, 2, 90_000), (20, 2, 200_000), (30, 1, 200_001)], "event_id long, path long, s long").select("event_id", "path", F.timestamp_seconds("s").alias("ts"), F.lit("same").alias("hash"))
    again = stream_of(spark, late, str(tmp_path / "late"))
    assert ids(watching.drained(watching.changed(again, "30 days")), "event_id") == [0, 10]
    assert ids(watching.drained(watching.changed(again, "12 hours")), "event_id") == [0, 10, 30]


def test_upserts_and_counters_of_a_stream(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("path"), F.timestamp_seconds(1704067200 + F.col("id") * 10_000).alias("ts"), F.lit("h").alias("hash"))
    stream = stream_of(spark, rows, str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(watching.upsert_to(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.path: r.event_id for r in watching.upserted(spark, str(tmp_path / "out")).collect()} == {0: 39, 1: 37, 2: 38}
    counted = watching.drained(watching.windowed_counts(stream), "complete")
    assert counted.agg(F.sum("n")).first()[0] == 40 and counted.count() == rows.select(F.to_date("ts"), "path").distinct().count()


def test_long_texts_are_chunked_in_linear_time(spark):
    import time

    body = ("# Title %d\n" + "word é " * 9 + "\n\n") * 30_000 % tuple(range(30_000))
    docs = spark.createDataFrame([("d", body)], "id string, body string").cache()
    docs.count()
    for chunker, least in ((chunks.fixed, 4000), (chunks.paragraphs, 29_000), (chunks.sections, 29_000)):
        began = time.monotonic()
        assert chunker(docs).count() >= least and time.monotonic() - began < 60


@pytest.mark.parametrize("size,overlap", [(50, 10), (50, 40), (7, 6), (5, 0), (4, 9)])
def test_fixed_pieces_against_slices(spark, size, overlap):
    texts = ["", "a", "abcdef " * 30, "é日本 x\n" * 20, "x" * 50]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, body string")
    got = sorted((int(r.id), r.char_offset, r.content) for r in chunks.fixed(rows, size, overlap, 3).collect())
    want = []
    for i, t in enumerate(texts):
        for at in range(0, len(t), max(1, size - overlap)):
            piece = t[at : at + size].strip()
            if len(piece.encode()) >= 3:
                want.append((i, at, piece))
    assert got == sorted(want)


def test_nested_clauses(spark):
    rows = [("1", "Quantum theory of light", ["state-of-the-art"]), ("2", "light gardening", ["home"]), ("3", "theory without it", [])]
    docs = spark.createDataFrame(rows, "id string, body string, tags array<string>")
    indexed = fts.field_tokens(docs, fts.body_and_tags())
    def found(clause):
        return ids(fts.search(indexed, clause, 10))
    light, theory = fts.word("light"), fts.word("theory")
    assert found(fts.any_of(light, theory)) == ["1", "2", "3"] and found(fts.all_of(light, fts.none_of(theory))) == ["2"]
    assert found(fts.words_in_turn("state of the art", "tags")) == ["1"] and found(fts.words_in_turn("of theory")) == []
    assert found(fts.between("g", "h")) == ["2"] and found(fts.all_of(fts.any_of(light, theory), fts.word("home", "tags"))) == ["2"]
    ranked = {c: fts.search(indexed, fts.any_of(light.boosted(c), theory), 3).orderBy("rank").first().score for c in (1.0, 3.0)}
    assert ranked[3.0] > ranked[1.0]


def test_workspace_members_come_and_go(spark):
    import datetime as dt

    now = F.lit(dt.datetime(2024, 1, 1))
    spaces = spark.createDataFrame([("a", 2, dt.datetime(2024, 1, 1))], "ws_id string, max_nodes int, last_accessed timestamp")
    more = workspaces.created(spaces, spark.createDataFrame([("b",)], "ws_id string"), now)
    assert {r.ws_id: r.max_nodes for r in more.collect()} == {"a": 2, "b": 10_000}
    members = spark.createDataFrame([("a", "1", "private", None, dt.datetime(2023, 1, 1))], "ws_id string, node_id string, access string, group_id int, added_at timestamp")
    new = spark.createDataFrame([("a", "1", "shared", None), ("a", "2", "shared", None), ("a", "3", "shared", None), ("x", "1", "shared", None)], "ws_id string, node_id string, access string, group_id int")
    after, taken = workspaces.added(members, more, new, now)
    assert {(r.ws_id, r.node_id): r.ok for r in taken.collect()} == {("a", "1"): True, ("a", "2"): True, ("a", "3"): False, ("x", "1"): False}
    assert sorted((r.node_id, r.access) for r in after.collect()) == [("1", "shared"), ("2", "shared")]
    assert workspaces.added(after, more, new, now)[1].where("ok").count() == 0
    assert ids(workspaces.removed(after, new.where("node_id = '1'")), "node_id") == ["2"]


def test_two_seeds_and_half_life(spark, chain):
    got = {(r.seed, r.id): r.depth for r in graph.bfs(chain, seeds(spark, "A", "E"), 2).collect()}
    assert got == {("A", "A"): 0, ("A", "B"): 1, ("A", "C"): 2, ("E", "E"): 0, ("E", "D"): 1, ("E", "C"): 2}
    near = graph.ranked_near(chain, spark.createDataFrame([("q", "E", 1), ("q", "A", 2)], "qid string, seed string, seed_rank int"), 1)
    assert [r.id for r in near.orderBy("rank").collect()] == ["E", "D", "A", "B"]
    assert lifecycle.Config(half_life=100.0).decay == pytest.approx(0.00693147, abs=1e-6) and lifecycle.Config().decay == 0.0001


def test_previews_and_records(spark):
    rows = spark.createDataFrame([("a", "fact", "é" * 60, [], 1.0, None), ("b", "fact", "short", [], 1.0, None)], "id string, node_type string, body string, tags array<string>, confidence double, tx_time timestamp")
    assert [r.preview for r in store.previews(rows).orderBy("id").collect()] == ["é" * 50 + "...", "short"]
    assert store.records(rows).columns == ["id", "node_type", "body", "tags", "confidence", "tx_time"]


def test_documents_are_embedded_and_ranked(spark):
    from lodestone.api import hashed_vectors

    docs = spark.createDataFrame([("d1", "memory safety in rust. " * 40), ("d2", "gardens and flowers. " * 40), ("d3", "")], "id string, body string")
    pieces = chunks.embedded(docs, "fixed", hashed_vectors, 32)
    assert {r.doc for r in chunks.chunk_counts(pieces).collect()} == {"d1", "d2"}
    query = pieces.where("doc = 'd2' AND chunk = 0").select(F.lit("q").alias("qid"), F.col("v").alias("q"))
    best = chunks.rank_documents(pieces.select("doc", "chunk", "v"), query, 1).first()
    assert (best.doc, best.best_chunk, best["rank"]) == ("d2", 0, 1)


def test_degrees_are_summed_in_parts_that_follow_the_rows(spark, sf_dir, tmp_path, monkeypatch):
    from lodestone.sources import tables

    made = {"customer": ("c_custkey long, c_nationkey long", [(1, None), (2, None), (3, 7)]), "orders": ("o_orderkey long, o_custkey long", [(1, None), (2, 7), (3, 7), (None, 7)])}
    made["supplier"] = ("s_suppkey long, s_nationkey long", [(1, 7), (1, 8), (None, 7)])
    made["lineitem"] = ("l_orderkey long, l_suppkey long, l_quantity double", [(1, 1, 2.0), (1, 1, 3.0), (1, None, 4.0), (1, None, None), (None, 1, 1.0), (2, 2, None)])
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.id, r.edge_type): (r.degree, r.weight) for r in QUERIES["degree_stats"](spark, str(tmp_path)).collect()}
    want = {(None, "has_part"): (3, 3.0), ("n7", "has_part"): (1, 1.0), ("c7", "has_part"): (3, 3.0), ("o1", "references"): (2, 9.0), (None, "references"): (1, 1.0), ("o2", "references"): (1, None)}
    assert got == want | {("s1", "is_a"): (2, 2.0), (None, "is_a"): (1, 1.0)}
    monkeypatch.setattr(tables, "SUMMED", 500)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert tables._referred(spark, sf_dir).rdd.getNumPartitions() == -(-rows // 500)
