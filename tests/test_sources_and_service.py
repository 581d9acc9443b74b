import json

import numpy as np
import pytest

from quillvec.config import IndexConfig
from quillvec.errors import DatasetFormatError, QueryError, ServiceError
from quillvec.operators import evaluate
from quillvec.operators.hybrid import HashEmbedder
from quillvec.operators.index import VectorIndex
from quillvec.service import Service, validate_batch, validate_ingest, validate_query
from quillvec.sources import backends, datasets
from quillvec.streaming.ingest import ingest_stream
from quillvec.vectorstore import Store

ROWS = [dict(chunk_id=i, text=t, embedding=e, metadata={"topic": m}) for i, t, e, m in (("a", "apple finance", [2, 0, 1], "finance"), ("b", "banana inventory", [0, 2, 0], "inventory"), ("c", "finance banana", [0, 1, 1], "finance"))]


@pytest.fixture()
def jsonl(tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in ROWS) + "\n\n")
    return str(path)


def test_sidecar(spark, jsonl, tmp_path):
    datasets.build_sidecar(spark, datasets.read_dataset(spark, jsonl), str(tmp_path / "i"), bits=4)
    index, records = datasets.open_sidecar(spark, str(tmp_path / "i"))
    assert [r["chunk_id"] for r in index.search([2, 0, 1], 2).collect()] == ["a", "c"]
    assert [r["chunk_id"] for r in index.search([2, 0, 1], 2, filters_={"topic": "finance"}).collect()] == ["a", "c"]
    assert {r["text"] for r in records.collect()} == {r["text"] for r in ROWS}
    _, fetched = datasets.open_sidecar(spark, str(tmp_path / "i"), fetch={"a": {"text": "from outside"}})
    assert [(r["chunk_id"], r["text"]) for r in fetched.for_ids(index.rows).collect()] == [("a", "from outside")]


def test_bad_datasets(spark, tmp_path):
    for text in ("", '{"chunk_id": "a", "text": "x"}', "not json", json.dumps(ROWS[0]) + "\n" + json.dumps(ROWS[0])):
        path = tmp_path / "bad.jsonl"
        path.write_text(text)
        with pytest.raises(DatasetFormatError):
            datasets.read_dataset(spark, str(path))
    with pytest.raises(ValueError):
        datasets.format_of("x.csv")


def test_npz(spark, tmp_path):
    path = str(tmp_path / "d.npz")
    np.savez(path, embeddings=np.eye(3, dtype=np.float32), ids=np.array(["x", "y", "z"]), texts=np.array(["t1", "t2", "t3"]), page_nums=np.array(["4", "", "6"]))
    rows = {r["chunk_id"]: r for r in datasets.read_dataset(spark, path).collect()}
    assert rows["x"]["page_num"] == 4 and rows["y"]["page_num"] is None and rows["z"]["text"] == "t3" and list(rows["y"]["embedding"]) == [0, 1, 0]
    np.savez(path, ids=np.array(["x"]))
    with pytest.raises(DatasetFormatError):
        datasets.read_npz(spark, path)


def test_cases_and_report(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"query_id": "1", "query_vector": [1, 0], "relevant_ids": ["a", "b"]}\n{"query_id": "2", "query_vector": [1, 0], "relevant_ids": []}\n')
    cases = datasets.read_cases(spark, str(path))
    hits = spark.createDataFrame([("1", "x", 1), ("1", "b", 2), ("2", "x", 1)], "query_id string, chunk_id string, rank int")
    r = evaluate.report(hits, cases, 2.0).first()
    assert (r["queries"], r["recall"], r["mrr"], r["qps"]) == (2, 0.25, 0.25, 1.0)
    path.write_text('{"query_id": "1"}\n')
    with pytest.raises(DatasetFormatError):
        datasets.read_cases(spark, str(path))


def test_backends(spark, tmp_path):
    ids = spark.createDataFrame([("1",), ("2",), ("2",), ("9",)], "chunk_id string")

    class Columns:
        def get(self, wanted):
            return {"ids": [["2", "1"]], "documents": [["two", "one"]], "metadatas": [[{"source": "s", "page": "3"}, None]]}

    rows = {r["chunk_id"]: r for r in backends.fetch_records(ids, Columns()).collect()}
    assert set(rows) == {"1", "2"} and (rows["2"]["source_doc"], rows["2"]["page_num"]) == ("s", 3)
    assert backends.fetch_records(ids, lambda some: [{"id": i, "text": i * 2} for i in some]).count() == 3
    config = {"backend": "postgres", "options": {"dsn": "${DB}", "table": "t"}}
    assert backends.load_config(config, {"DB": "x"}) == {"backend": "neon", "options": {"dsn": "x", "table": "t"}}
    backends.save_config(config, str(tmp_path / "adapter.json"))
    for wrong in ({"backend": "none"}, {"backend": "qdrant", "options": {}}, config):
        with pytest.raises(ValueError):
            backends.load_config(wrong, {})
    with pytest.raises(ValueError):
        backends.identifier("a; drop")
    assert backends.detect_environment({"QDRANT_URL": "x", "DATABASE_URL": "y"}) == "qdrant"


def test_requests():
    assert validate_query({"query_vector": [1, 2]})["k"] == 5
    for wrong in ({}, {"query_text": "a", "query_vector": [1]}, {"query_text": "a", "top_k": 0}, {"query_text": "a", "top_k": True}, {"query_text": "a", "x": 1}, {"query_text": "a", "filters": []}, {"query_text": "a", "hydrate": 1}, {"query_vector": ["a"]}, []):
        with pytest.raises(QueryError):
            validate_query(wrong)
    for wrong in ({}, {"queries": []}, {"queries": [{"query_vector": [1], "filters": {}}]}):
        with pytest.raises(QueryError):
            validate_batch(wrong)
    for wrong in ({"records": [{"chunk_id": "a"}]}, {"records": [{"chunk_id": "a", "text": "t", "embedding": [1], "x": 1}]}, {"records": [{"chunk_id": "a", "text": "t", "embedding": [1], "metadata": []}]}):
        with pytest.raises(QueryError):
            validate_ingest(wrong)


def test_service(spark, jsonl):
    data = datasets.read_dataset(spark, jsonl)
    index = VectorIndex(spark, IndexConfig(3, bits=4))
    index.add(data.select("chunk_id", "embedding", "metadata"))
    service = Service(index, data.drop("embedding"), HashEmbedder(3))
    assert [r["text"] for r in service.query({"query_vector": [2, 0, 1], "top_k": 2})["results"]] == ["apple finance", "finance banana"]
    service.ingest({"records": [{"chunk_id": "d", "text": "new", "embedding": [3, 0, 1], "metadata": {"topic": "legal"}}]})
    assert [r["chunk_id"] for r in service.query({"query_vector": [3, 0, 1], "filters": {"topic": "legal"}})["results"]] == ["d"]
    assert len(service.query_batch({"queries": [{"query_vector": [0, 2, 0]}, {"query_vector": [2, 0, 1]}], "top_k": 1})["results"]) == 2
    assert service.ingest_text({"text": "one two three", "source_doc": "s"})["added"] == 1
    d = service.describe()
    assert (d["index_size"], d["hydration_source"]) == (5, "local_snapshot") and service.health()["status"] == "ok"
    with pytest.raises(ServiceError):
        Service(index).query({"query_text": "x"})
    with pytest.raises(QueryError):
        service.query({})
    m = service.metrics()["endpoints"]["query"]
    assert (m["count"], m["errors"]) == (3, 1) and m["min_ms"] <= m["avg_ms"] <= m["max_ms"]


def test_store(spark):
    store = Store.from_texts(spark, ["red fox", "blue whale"], HashEmbedder(64), [{"k": 1}, {"k": 2}])
    assert store.similarity_search("red fox", 1)[0]["text"] == "red fox"
    assert store.similarity_search("red fox", 2, {"k": 2})[0]["text"] == "blue whale"
    store.add_texts(["green frog"], ids=["g"])
    assert store.as_retriever(1).invoke("green frog")[0]["chunk_id"] == "g" and store.similarity_search_with_score("green frog", 1)[0][1] > 0.5
    with pytest.raises(ValueError):
        Store.from_existing_records(store.index, store.records).add_texts(["x"])


def test_stream_twice_adds_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>").write.parquet(src)
    for k in range(2):  # a second checkpoint replays everything
        stream = spark.readStream.schema("chunk_id string, embedding array<float>").parquet(src)
        ingest_stream(stream, str(tmp_path / "i"), IndexConfig(2), str(tmp_path / f"cp{k}")).awaitTermination()
    assert len(VectorIndex.open(spark, str(tmp_path / "i"))) == 2


def test_command_line(spark, jsonl, tmp_path, capsys):
    from quillvec import cli

    path = str(tmp_path / "i")
    (tmp_path / "q.jsonl").write_text('{"query_id": "1", "query_vector": [2, 0, 1], "relevant_ids": ["a"]}')
    cli.main(["import-existing-index", jsonl, path, "--bits", "4"])
    cli.main(["query", path, "--vector", "[2, 0, 1]", "--top-k", "1"])
    cli.main(["describe-index", path])
    cli.main(["benchmark", path, str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "r.json")])
    cli.main(["adapt", "set", path, "--backend", "chroma", "--option", "collection=c"])
    cli.main(["adapt", "show", path])
    cli.main(["adapt", "remove", path])
    out = capsys.readouterr().out
    assert '"index_size": 3' in out and "apple finance" in out and '"recall": 1.0' in out and '"collection": "c"' in out
    assert json.loads((tmp_path / "r.json").read_text())[0]["mrr"] == 1.0
