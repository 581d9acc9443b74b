import json

import pytest

from quillvec.errors import ChunkingError
from quillvec.functions import exprs
from quillvec.operators import chunking, graph, hybrid, traverse


def test_chunk_text():
    assert chunking.chunk_text("  \n ") == [] and chunking.chunk_text(None) == []
    pieces = chunking.chunk_text("Word " * 500, "d", chunking.ChunkConfig(50, 10))
    assert len(pieces) == 10 and len(pieces[1]["text"].split()) == 60 and pieces == chunking.chunk_text("Word " * 500, "d", chunking.ChunkConfig(50, 10))
    assert pieces[3]["metadata"] == {"chunk_index": 3, "chunk_count": 10} and pieces[0]["chunk_id"].startswith("chunk-")
    assert chunking.merged_segments("One two. Three four. Five six.", 4) == ["One two Three four", "Five six."]


def test_chunk_frame_equals_chunk_text(spark):
    docs = {"a": "# Head\nSome words here. More words there.\n\n## Tail\nThe Tail of it " + "x y z, " * 60, "b": "short", "c": " ", "d": None}
    c = chunking.ChunkConfig(20, 4)
    rows = chunking.chunk_frame(spark.createDataFrame(list(docs.items()), "source_doc string, text string"), config=c).collect()
    expected = {(p["chunk_id"], p["text"], p["section"], p["metadata"]["chunk_index"]) for k, t in docs.items() for p in chunking.chunk_text(t, k, c)}
    assert {(r["chunk_id"], r["text"], r["section"], r["chunk_index"]) for r in rows} == expected


def test_sql_functions(spark):
    exprs.register_sql_functions(spark)
    rows = spark.sql("SELECT c.* FROM VALUES ('a b c d e') t(x), LATERAL chunk_text(x, 2, 1) c ORDER BY chunk_index").collect()
    assert [r["text"] for r in rows] == ["a b", "b c d", "d e"]
    r = spark.sql("SELECT hex(vec_quantize(array(1.0f, -1.0f), 4, 1.0)) q, vec_hamming(X'FF', X'0F') h").first()
    assert (r["q"], r["h"]) == ("0F", 4)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody")
    (tmp_path / "b.txt").write_text("plain\ntext")
    got = chunking.read_documents(spark, [str(tmp_path / "a.md"), str(tmp_path / "b.txt")]).collect()
    assert {(r["source_doc"], r["text"]) for r in got} == {("a.md", "# T\nbody"), ("b.txt", "plain\ntext")}
    for wrong in ("gone.txt", "x.xyz"):
        with pytest.raises(ChunkingError):
            chunking.read_documents(spark, str(tmp_path / wrong))
    assert chunking.read_documents(spark, [str(tmp_path / "gone.txt")], True).count() == 0


@pytest.fixture(scope="module")
def payloads(spark):
    rel = lambda s, t, w, r: {"source": s, "target": t, "weight": w, "relation": r}
    e = lambda n, t="person", d="": {"name": n, "type": t, "description": d}
    rows = [
        ("c1", 1, json.dumps({"entities": [e("A"), e("B", "org", "first")], "relationships": [rel("A", "B", 0.3, "knows"), rel("A", "C", 1, "early")]})),
        ("c2", 2, json.dumps({"entities": [e("B", "other", "second"), e("C"), {"type": "nameless"}, "text"], "relationships": [rel("B", "A", 0.8, "likes"), rel("C", "C", "bad", "")]})),
        ("c3", 3, "not json"), ("c4", 4, "[1]"), ("c5", 5, json.dumps({"entities": [e("D")]})),
    ]
    return spark.createDataFrame(rows, "chunk_id string, seq long, payload string")


def test_graph(payloads):
    nodes = graph.nodes(payloads)
    assert {(r["name"], r["type"], r["description"], tuple(r["chunk_ids"])) for r in nodes.collect()} == {("A", "person", "", ("c1",)), ("B", "org", "first", ("c1", "c2")), ("C", "person", "", ("c2",)), ("D", "person", "", ("c5",))}
    edges = graph.edges(payloads, nodes)
    assert {(r["src"], r["dst"], r["weight"], tuple(r["relations"])) for r in edges.collect()} == {("A", "B", 0.8, ("knows", "likes")), ("C", "C", 0.5, ("related_to",))}
    groups = graph.communities(graph.components(edges, nodes))
    assert [(r["community_id"], list(r["members"])) for r in groups.orderBy("community_id").collect()] == [(0, ["A", "B"]), (1, ["C"]), (2, ["D"])]
    assert [r["summary"] for r in graph.summaries(groups, 1).orderBy("community_id").collect()] == ["A", "C", "D"]
    s = graph.stats(nodes, edges, groups).first()
    assert (s["node_count"], s["edge_count"], s["community_count"], list(s["entity_types"])) == (4, 2, 3, ["org", "person"])
    assert "<edge source=\"A\"" in graph.to_graphml(nodes, edges)
    assert graph.nodes(payloads, ["org"]).count() == 1


def test_extract_uses_cache(spark):
    chunks = spark.createDataFrame([("1", 1, "x"), ("2", 2, "y"), ("3", 3, "x")], "chunk_id string, seq long, text string")
    with pytest.raises(ValueError):
        graph.extract(chunks, None)
    first, fresh = graph.extract(chunks, lambda prompt: '{"entities": []}')
    assert fresh.count() == 2 and first.count() == 3

    def never(prompt):
        raise AssertionError

    again, none = graph.extract(chunks, never, fresh)
    assert none.count() == 0 and again.where("payload = '{}'").count() == 0


def test_traversal_and_hybrid(spark):
    nodes = spark.createDataFrame([("ACME Corp", ["1"]), ("Élan", ["2"]), ("Far", ["3"]), ("Further", ["4"])], "name string, chunk_ids array<string>")
    edges = spark.createDataFrame([("ACME Corp", "Élan"), ("Far", "Élan"), ("Far", "Further"), ("Far", "Far")], "src string, dst string")
    queries = spark.createDataFrame([("q", "What does acme corp. do with ELAN?"), ("r", "ACMECorp")], "query_id string, text string")
    starts = traverse.detect(queries, nodes)
    assert {(r["query_id"], r["name"]) for r in starts.collect()} == {("q", "ACME Corp"), ("q", "Élan")}
    reached = traverse.bfs(starts.where("name = 'ACME Corp'"), edges, 2)
    assert {(r["name"], r["depth"]) for r in reached.collect()} == {("ACME Corp", 0), ("Élan", 1), ("Far", 2)}
    records = spark.createDataFrame([("1",), ("2",)], "chunk_id string")
    found = traverse.candidates(reached, nodes, records, 5)
    assert [(r["chunk_id"], r["score"], list(r["path"])) for r in found.orderBy("rank").collect()] == [("1", 1.0, ["ACME Corp"]), ("2", 0.5, ["ACME Corp", "Élan"])]
    dense = spark.createDataFrame([("q", "2", 0.25), ("q", "9", 0.1)], "query_id string, chunk_id string, score double")
    merged = {r["chunk_id"]: (r["score"], r["explanation"]) for r in hybrid.merge(dense, found).collect()}
    assert merged["2"] == (0.75, "Matched graph path: ACME Corp -> Élan") and merged["9"] == (0.1, hybrid.DENSE_NOTE)


def test_hybrid_retriever(spark):
    from quillvec.config import IndexConfig
    from quillvec.operators.index import VectorIndex

    model = hybrid.HashEmbedder(32)
    texts = {"1": "acme makes rockets", "2": "elan sells skis", "3": "nothing at all"}
    index = VectorIndex(spark, IndexConfig(32, bits=4))
    index.add(spark.createDataFrame([(k, [float(x) for x in model.embed(t)]) for k, t in texts.items()], "chunk_id string, embedding array<float>"))
    records = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    nodes = spark.createDataFrame([("acme", ["1"]), ("elan", ["2"])], "name string, chunk_ids array<string>")
    edges = spark.createDataFrame([("acme", "elan")], "src string, dst string")
    r = hybrid.HybridRetriever(index, records, nodes, edges, model)
    assert r.query(["acme makes rockets"], 2).first()["chunk_id"] == "1"
    assert [x["chunk_id"] for x in r.query(["acme"], 5, "graph").collect()] == ["1", "2"]
    with pytest.raises(ValueError):
        r.query(["x"], 1, "other")
    last = hybrid.HybridRetriever(index, records, nodes, edges, model, rerank=lambda q, rs: [1.0 if x["chunk_id"] == "3" else 0.0 for x in rs])
    assert last.query(["acme"], 3).first()["chunk_id"] == "3"
