"""Stores, servers and files at the engine's edges."""

import io
import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from quillvec import server
from quillvec.config import IndexConfig
from quillvec.errors import DatasetFormatError
from quillvec.operators import chunking, graph, hydrate
from quillvec.operators.index import VectorIndex
from quillvec.service import Service
from quillvec.sources import backends, datasets


@pytest.fixture(scope="module")
def index(spark):
    i = VectorIndex(spark, IndexConfig(4, bits=4))
    i.add(spark.createDataFrame([(str(k), [float(k == j) + 0.1 * j for j in range(4)]) for k in range(4)], "chunk_id string, embedding array<float>"))
    return i


def test_only_hits_are_asked_for(spark, index, tmp_path):
    """An outside store gets the ids of the hits, and with a snapshot those that it lacks; each once for all queries."""
    log = str(tmp_path / "asked")

    def ask(ids):
        with open(log, "a") as f:
            f.write("".join(i + "\n" for i in ids))
        return [{"id": i, "text": f"text {i}"} for i in ids if i != "3"]

    def asked():
        with open(log) as f:
            out = sorted(f.read().split())
        open(log, "w").close()
        return out

    source = hydrate.Source(lambda ids: backends.fetch_records(ids, ask))
    hits = index.search_batch([[1, 0, 0, 0], [1, 0.1, 0, 0]], 2)
    wanted = sorted({r["chunk_id"] for r in hits.collect()})
    rows = hydrate.hydrate_batch(hits, source).collect()
    assert asked() == wanted and len(rows) == 4 and all(r["text"] == ("" if r["chunk_id"] == "3" else f"text {r['chunk_id']}") for r in rows)
    local = spark.createDataFrame([(wanted[0], "here")], "chunk_id string, text string")
    rows = hydrate.hydrate_fallback(hits, local, source).collect()
    assert asked() == wanted[1:] and {r["text"] for r in rows if r["chunk_id"] == wanted[0]} == {"here"}
    service = Service(index, source)
    answer = service.query({"query_vector": [1, 0, 0, 0], "top_k": 2})
    assert answer["count"] == 2 == len(asked()) and service.describe()["hydration_source"] == "external_backend"


def test_database(spark):
    """Ids reach the database as a condition; many ids are joined instead."""
    url = "jdbc:derby:memory:records;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(f"it's {k}", f"text {k}", k) for k in range(50)], "chunk_id string, text string, page_num int")
    rows.write.jdbc(url, "chunks", mode="overwrite", properties={**driver, "createTableColumnTypes": "chunk_id VARCHAR(64), text VARCHAR(64)"})
    ids = spark.createDataFrame([("it's 7",), ("it's 7",), ("it's 9",), ("none",)], "chunk_id string")
    columns = {"chunk_id": "chunk_id", "text": "text", "page_num": "page_num"}
    found = backends.jdbc_records(spark, ids, url, "chunks", columns, **driver)
    assert {(r["chunk_id"], r["text"], r["page_num"]) for r in found.collect()} == {("it's 7", "text 7", 7), ("it's 9", "text 9", 9)}
    assert backends.jdbc_records(spark, ids.limit(0), url, "chunks", columns, **driver).count() == 0
    assert backends.MOST_IDS == 1 or "IN" in found._jdf.queryExecution().executedPlan().toString().upper().partition("PUSHEDFILTERS")[2]
    assert backends.jdbc_url("postgresql://me:p%40ss@host:5/db?sslmode=require") == "jdbc:postgresql://host:5/db?sslmode=require&user=me&password=p%40ss"
    with pytest.raises(ValueError):
        backends.jdbc_url("mysql://x/y")


def test_many_ids_are_joined(spark, monkeypatch):
    monkeypatch.setattr(backends, "MOST_IDS", 1)
    test_database(spark)


def client():
    """A class of clients that stand for any store's: they note what they are asked and give the store's shape of answer."""

    class Answers:
        def table(self, name):
            self.name = name
            return self

        def select(self, what):
            return self

        def in_(self, column, ids):
            self.ids = ids
            return self

        def execute(self):
            return type("Answer", (), {"data": [{"chunk_id": i, "text": f"t{i}"} for i in self.ids]})()

        def fetch(self, ids, namespace=None):
            return {"vectors": {i: {"metadata": {"text": f"t{i}", "source": namespace}} for i in ids}}

        def retrieve(self, collection_name, ids, with_payload, with_vectors):
            assert all(isinstance(i, int) for i in ids) and with_payload and not with_vectors
            return [type("Point", (), {"id": i, "payload": {"text": f"t{i}"}})() for i in ids]

        def get(self, ids, include):
            return {"ids": ids, "documents": [f"t{i}" for i in ids], "metadatas": None}

    return Answers


@pytest.mark.parametrize(
    "backend, options",
    [("supabase", {"url": "u", "key": "k", "table": "t"}), ("pinecone", {"api_key": "k", "index": "i", "namespace": "n"}), ("qdrant", {"url": "u", "collection": "c"}), ("chromadb", {"collection": "c"})],
)
def test_clients(spark, backend, options):
    ids = spark.createDataFrame([("1",), ("2",), ("1",)], "chunk_id string")
    source = backends.from_config(spark, {"backend": backend, "options": options}, client())
    assert {(r["chunk_id"], r["text"]) for r in source.for_ids(ids).collect()} == {("1", "t1"), ("2", "t2")}
    with pytest.raises(ValueError):
        backends.from_config(spark, {"backend": backend, "options": options})


def test_line_numbers(spark, tmp_path):
    """A bad line is named by its number in its file, blank lines counted, however the file is split."""
    path = tmp_path / "big.jsonl"
    good = json.dumps({"chunk_id": "%d", "text": "x" * 60, "embedding": [1]})
    lines = [good % k if k % 7 else "" for k in range(1, 9001)]
    lines[6000] = '{"chunk_id": "broken"}'
    path.write_text("\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        with pytest.raises(DatasetFormatError, match="line 6001:"):
            datasets.read_jsonl(spark, str(path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_last_record_wins(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for k, name in enumerate(("a", "b", "c")):
        (tmp_path / "r" / f"{name}.json").write_text("\n".join(json.dumps({"chunk_id": "same", "text": f"{k}{j}"}) for j in range(3)))
    assert [r["text"] for r in datasets.read_records(spark, str(tmp_path / "r")).collect()] == ["22"]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_slices_of_archives(spark, tmp_path, save):
    path, n = str(tmp_path / "d.npz"), 1003
    x = np.arange(n * 3, dtype=np.float64).reshape(n, 3)
    save(path, ids=np.array([f"i{k}" for k in range(n)]), embeddings=x, page_nums=np.arange(n))
    spark.dataSource.register(datasets.NpzSource)
    rows = {r["chunk_id"]: r for r in spark.read.format("quillvec_npz").option("rows", 100).load(path).collect()}
    assert len(rows) == n and all(list(rows[f"i{k}"]["embedding"]) == x[k].tolist() and rows[f"i{k}"]["page_num"] == k for k in range(0, n, 97))


def test_http(index):
    http = server.http_server(Service(index), port=0, origins=("https://app",))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"

    def call(path, body=None, **headers):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, headers)) as r:
                return r.status, json.loads(r.read() or b"null"), r.headers
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read()), e.headers

    try:
        assert call("/health")[1] == {"status": "ok", "index_size": 4}
        status, found, headers = call("/query", {"query_vector": [0, 0, 1, 0], "top_k": 1}, **{"X-Request-Id": "r7", "Origin": "https://app"})
        assert (status, found["results"][0]["chunk_id"], headers["X-Request-Id"], headers["Access-Control-Allow-Origin"]) == (200, "2", "r7", "https://app")
        assert call("/query", {"query_vector": []})[0] == 400 and call("/query", b"{")[0] == 400 and call("/nowhere")[0] == 404
        assert call("/query/batch", {"queries": [{"query_vector": [1, 0, 0, 0]}], "top_k": 1})[0] == 200
        assert call("/metrics")[1]["endpoints"]["query"]["errors"] == 1 and call("/")[1]["dim"] == 4
    finally:
        http.shutdown()


def test_tools(spark):
    i = VectorIndex(spark, IndexConfig(2, bits=4))
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "ingest", "arguments": {"records": [{"chunk_id": "a", "text": "t", "embedding": [1, 0]}, {"chunk_id": "b"}]}}}, {"id": 4, "method": "tools/call", "params": {"name": "query", "arguments": {"query_vector": [1, 0]}}}, {"id": 5, "method": "tools/call", "params": {"name": "query", "arguments": {}}}, {"id": 6, "method": "other"}]
    out = io.StringIO()
    server.serve_tools(Service(i), io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    told = lambda r: json.loads(r["result"]["content"][0]["text"])
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, None] and {t["name"] for t in replies[1]["result"]["tools"]} == {"query", "describe", "ingest"}
    assert told(replies[2]) == {"added": 1, "index_size": 1, "skipped": 1} and told(replies[3])["results"][0]["chunk_id"] == "a"
    assert replies[4]["result"]["isError"] and "error" in replies[5] and replies[6]["error"]["code"] == -32700


def test_communities_of_high_modularity(spark):
    """Two cliques joined by one edge are two communities, a lone node its own; connected components would see one."""
    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    pairs = [*clique("abcde"), *clique("mnopq"), ("e", "m"), *clique("xyz")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(c,) for c in "abcdemnopqxyzL"], "name string")
    found = {r["name"]: r["component"] for r in graph.leiden(edges, nodes).collect()}
    groups = {}
    for name, c in found.items():
        groups.setdefault(c, set()).add(name)
    assert groups == {"a": set("abcde"), "m": set("mnopq"), "x": set("xyz"), "L": {"L"}}


def test_graph_files_and_cache(spark, tmp_path):
    nodes = spark.createDataFrame([("A & B", "org", "", ["1"]), ("C", "person", "", [])], "name string, type string, description string, chunk_ids array<string>")
    edges = spark.createDataFrame([("A & B", "C", 0.75, ["knows"])], "src string, dst string, weight double, relations array<string>")
    back_nodes, back_edges = graph.from_graphml(spark, graph.to_graphml(nodes, edges))
    assert sorted(map(tuple, back_nodes.select("name", "type", "chunk_ids").collect())) == [("A & B", "org", ["1"]), ("C", "person", [])]
    assert [tuple(r) for r in back_edges.collect()] == [("A & B", "C", 0.75, ["knows"])]
    graph.save(str(tmp_path / "g"), nodes=nodes, edges=edges)
    assert set(graph.load(spark, str(tmp_path / "g"))) == {"nodes", "edges"}
    chunks = spark.createDataFrame([("1", 1, "x"), ("2", 2, "y")], "chunk_id string, seq long, text string")
    cache = str(tmp_path / "cache")
    _, fresh = graph.extract(chunks, lambda p: "{}" if p.endswith("x") else "broken", cache_path=cache)
    assert fresh.count() == 2
    payloads, fresh = graph.extract(chunks, lambda p: '{"entities": []}', cache_path=cache)
    assert fresh.count() == 1 and {r["chunk_id"]: r["payload"] for r in payloads.collect()} == {"1": "{}", "2": '{"entities": []}'}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_token_counts(name):
    import os

    path = os.path.join(os.environ.get("QUILLVEC_TOKENIZERS", "/opt/tokenizers"), name)
    if not os.path.exists(path):
        pytest.skip("no public tokenizers here")
    count = chunking.BpeCount(path)
    assert count("hello world") == 2 and count("") == 0 and count("unbelievably") > 1
    pieces = chunking.merged_segments("The quick brown fox jumps. " * 40, 24, count)
    assert len(pieces) > 5 and all(count(p) <= 30 for p in pieces)


def plain_chunks(text, size, separators=("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")):
    """The rules written down once more: split by the first separator that splits, then join what fits."""

    def cut(t, rest):
        if len(t.split()) <= size:
            return [t]
        for n, s in enumerate(rest):
            parts = [p.strip() for p in t.split(s) if p.strip()]
            if len(parts) > 1:
                return [x for p in parts for x in cut(p, rest[n + 1 :])]
        words = t.split()
        return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]

    out, now = [], []
    for piece in cut(text.strip(), separators) if text and text.strip() else []:
        if now and sum(len(p.split()) for p in now) + len(piece.split()) > size:
            out.append(" ".join(now))
            now = []
        now.append(piece)
    return out + ([" ".join(now)] if now else [])


def test_chunk_documents_against_the_rules(spark, sf_small):
    from quillvec.plans import catalog

    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = catalog.queries()["chunk_documents"](spark, sf_small).collect()
    got = {}
    for r in rows:
        got.setdefault(r["source_doc"], {})[r["chunk_index"]] = r["text"]
    for doc, text in texts.items():
        pieces = plain_chunks(text, 128)
        wanted = {i: p if i == 0 else " ".join([*pieces[i - 1].split()[-16:], p]) for i, p in enumerate(pieces)}
        assert got.get(doc, {}) == wanted, doc


def test_baselines(spark):
    """Clusters find most of what exact search finds; each is compared on the same queries."""
    from pyspark.sql import functions as F

    from quillvec.operators import baselines, evaluate
    from quillvec.operators.hybrid import SentenceEmbedder

    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((20, 12)), 30, 0) + 0.2 * rng.standard_normal((600, 12))
    vectors = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>")
    queries = vectors.where("cast(chunk_id as int) % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    flat, clustered = baselines.Flat(vectors, 12), baselines.Clustered(vectors, 12, clusters=24, probes=6)
    cases = flat.search(queries, 5).groupBy("query_id").agg(F.collect_list("chunk_id").alias("relevant_ids"))
    rows = {r["label"]: r for r in evaluate.evaluated([flat, clustered], queries, cases, 5).collect()}
    assert rows["flat"]["recall"] == 1.0 and rows["clustered"]["recall"] >= 0.9
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        from quillvec.errors import EmbeddingError

        with pytest.raises(EmbeddingError):
            SentenceEmbedder("a model").embed("text")
