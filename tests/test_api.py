"""The knowledge base's handle, end to end."""

import pytest
from pyspark.sql import functions as F

from lodestone import versions
from lodestone.api import KnowledgeBase, NodeNotFound
from lodestone.sources import files


def test_add_search_relate_delete(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), dims=64)
    bodies = [("r", "Rust gives memory safety without a collector"), ("p", "Python is easy to read"), ("t", "TypeScript adds types")]
    kb.add(spark.createDataFrame(bodies, "id string, body string"), project="lang")
    kb.relate("r", "related_to", "t", 0.5)
    found = kb.search("memory safety", 3).orderBy("rank").collect()
    assert found[0].id == "r" and found[0].tags == ["project:lang"]
    kb.add(spark.createDataFrame([("p", "Python, again")], "id string, body string"))
    assert kb.get("p").body == "Python, again" and kb.table("deltas").count() == 4 and kb.table("nodes").count() == 3
    nodes, edges = kb.subgraph("r", 1)
    assert sorted(r.id for r in nodes.collect()) == ["r", "t"] and edges.count() == 1
    kb.delete(spark.createDataFrame([("r",)], "id string"))
    with pytest.raises(NodeNotFound):
        kb.get("r")
    assert {r.what: r.n for r in kb.stats().collect()} == {"nodes": 2}
    assert kb.table("edges").count() == 0 and [r.id for r in kb.find("python").collect()] == ["p"] and kb.find("rust").count() == 0
    assert [r.id for r in kb.list(limit=1).collect()] == ["p"]


def test_files_become_nodes(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Hello")
    (tmp_path / "b.exe").write_text("no")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/c.js").write_text("x")
    (tmp_path / "empty.md").write_text("")
    found = files.read_files(spark, str(tmp_path))
    nodes = files.as_nodes(found, "p").collect()
    assert [n.body for n in nodes] == ["# Hello"] and "file:a.md" in nodes[0].tags and "project:p" in nodes[0].tags
    assert files.fingerprints(found).where(F.length("hash") == 64).count() >= 1  # empty files may not be read at all


def test_last_row_of_an_id_and_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MOST", 3)
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), dims=16)
    kb.add(spark.createDataFrame([("a", "first", 1), ("a", "second", 2)], "id string, body string, t int").withColumn("tx_time", F.timestamp_seconds("t")).drop("t"))
    assert kb.get("a").body == "second" and kb.table("nodes").count() == 1
    for n in range(5):
        kb.add(spark.createDataFrame([("a", f"word{n} again"), (f"n{n}", "again")], "id string, body string"))
    assert kb.get("a").body == "word4 again" and kb.table("nodes").count() == 6 and kb.find("again", 10).count() == 6
    assert kb.find("word3").count() == 0 and kb.find("word4").count() == 1
    assert len(kb.versions.current()["nodes"]) <= 3


def test_a_lost_write_changes_nothing(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), dims=16)
    kb.add(spark.createDataFrame([("a", "one")], "id string, body string"))
    monkeypatch.setattr(versions.Versions, "_name_version", lambda self, parts: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        kb.add(spark.createDataFrame([("a", "two")], "id string, body string"))
    assert kb.get("a").body == "one" and kb.table("deltas").count() == 1


def test_edges_values_objects_and_pages(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), dims=16)
    kb.relate_all(spark.createDataFrame([("a", "is_a", "b", 1.0), ("a", "is_a", "b", 2.0), ("b", "is_a", "c", 1.0)], "source string, edge_type string, target string, weight double"))
    edges = kb.table("edges").orderBy("source").collect()
    assert [(e.source, e.weight) for e in edges] == [("a", 2.0), ("b", 1.0)] and kb.edge(edges[0].id).target == "b" and kb.edge("none") is None
    kb.unrelate(kb.table("edges").where("source = 'a'").select("id"))
    assert kb.table("edges").count() == 1
    kb.put("k", b"v1")
    kb.put("k", b"v2")
    assert kb.value("k") == b"v2"
    kb.drop("k")
    assert kb.value("k") is None
    name = kb.put_objects(spark.createDataFrame([("x",), ("x",)], "t string"), "t").first().object_id
    assert kb.object(name) == b"x" and kb.table("objects").count() == 1
    kb.ingest(spark.createDataFrame([("http://a/b", "<title>Hi</title><p>Some words</p>")], "url string, html string"), project="web")
    node = kb.table("nodes").first()
    assert node.body == "# Hi\n\nHi Some words" or "Some words" in node.body
    before = kb.table("vectors").first().v
    kb.reembed(kb.table("nodes").select("id"))
    assert kb.table("vectors").first().v == before and kb.table("vectors").count() == 1
