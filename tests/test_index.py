import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.config import IndexConfig
from quillvec.errors import DuplicateIDError, IDNotFoundError, IndexConfigError
from quillvec.operators import search
from quillvec.operators.index import VectorIndex


def frame(spark, x, prefix="chunk-", meta=None, start=0):
    rows = [(f"{prefix}{start + i}", [float(a) for a in v], None if meta is None else meta[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, metadata string")


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(42).standard_normal((300, 16)).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, data):
    i = VectorIndex(spark, IndexConfig(16, shard_size=64))
    i.add(frame(spark, data, meta=[None if k % 10 == 9 else f'{{"group": {k % 3}, "tag": "t{k % 2}"}}' for k in range(300)]))
    return i


def hits(df):
    return [(r["chunk_id"], r["score"]) for r in df.orderBy("rank").collect()]


def test_self_match_and_single_equals_batch(index, data):
    batch = index.search_batch(data[:5], 3)
    by = {str(q): [(r["chunk_id"], r["score"]) for r in sorted(batch.where(F.col("query_id") == str(q)).collect(), key=lambda r: r["rank"])] for q in range(5)}
    for q in range(5):
        assert by[str(q)][0][0] == f"chunk-{q}" and by[str(q)] == hits(index.search(data[q], 3))


def test_frame_search_equals_batch(spark, index, data):
    asked = frame(spark, data[:20], "").withColumnRenamed("chunk_id", "query_id")
    a = search.search_frame(index.rows, asked, index.config, index.matrix, 4).collect()
    b = index.search_batch(data[:20], 4).collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}


def test_fast_finds_what_exact_finds(index, data):
    exact, fast = hits(index.search(data[3], 5)), hits(index.search(data[3], 5, mode="fast"))
    assert len({i for i, _ in exact} & {i for i, _ in fast}) >= 4
    assert hits(index.search(data[3], 5, mode="fast", compat_row_order=True))
    assert search.shortlist_size(10, 5000) == 500 and search.shortlist_size(10, 100) == 200


def test_filters(index, data):
    found = index.search_batch(data[:3], 300, {"group": 1, "tag": {"$ne": "t0"}})
    ids = {int(r["chunk_id"].split("-")[1]) for r in found.collect()}
    assert ids == {k for k in range(300) if k % 3 == 1 and k % 2 and k % 10 != 9}
    assert index.search(data[0], 5, filters_={"group": 99}).count() == 0
    assert index.search(data[0], 300, filters_={}).count() == 270


def test_edges(spark, index, data):
    assert index.search(data[0], 0).count() == 0
    assert VectorIndex(spark, IndexConfig(16)).search(data[0], 3).count() == 0
    assert "chunk-5" in index and "nobody" not in index and "size=300" in repr(index)
    assert {r["shard"] for r in index.rows.select("shard").collect()} == {0, 1, 2, 3, 4}
    for wrong in (np.ones(3), np.ones((2, 16))):
        with pytest.raises(ValueError):
            index.search(wrong)


def test_changes(spark, data):
    i = VectorIndex(spark, IndexConfig(16, shard_size=10))
    assert i.add(frame(spark, data[:20], meta=['{"a": 1}'] * 20)) == 20
    with pytest.raises(DuplicateIDError) as e:
        i.add(frame(spark, data[:3], start=18))
    assert e.value.chunk_id == "chunk-18"
    with pytest.raises(ValueError):
        i.add(frame(spark, data[:2], "same").withColumn("chunk_id", F.lit("x")))
    assert i.delete(["chunk-0", "chunk-1", "nobody"]) == 2 and len(i) == 18
    with pytest.raises(IDNotFoundError):
        i.update(frame(spark, data[:1]))
    i.update(frame(spark, -data[5:6], start=5))
    assert hits(i.search(-data[5], 1))[0][0] == "chunk-5" and i.search(data[0], 99, filters_={"a": 1}).count() == 17
    assert i.add_new(frame(spark, data[:25])) == 7 and len(i) == 25


def test_save_and_open(spark, index, data, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(IndexConfigError):
        VectorIndex.open(spark, path)
    assert index.save(path) == 1 and index.save(path) == 2
    again = VectorIndex.open(spark, path)
    assert again.config == index.config and hits(again.search(data[7], 4, filters_={"group": 1})) == hits(index.search(data[7], 4, filters_={"group": 1}))
    assert len(VectorIndex.open(spark, path, 1)) == 300


def parts(path, kind):
    folder = path / "i" / kind
    return sorted(p.name for p in folder.iterdir()) if folder.exists() else []


def test_changes_are_appended(spark, data, tmp_path):
    """A saved change writes what changed: rows added, and marks of rows removed; old versions stay readable until vacuum."""
    path = str(tmp_path / "i")
    i = VectorIndex(spark, IndexConfig(16))
    i.add(frame(spark, data[:40]))
    assert i.save(path) == 1
    first = parts(tmp_path, "data")
    again = VectorIndex.open(spark, path)
    again.delete(["chunk-3"])
    again.update(frame(spark, -data[5:6], start=5))
    again.add(frame(spark, data[3:4], start=3))
    assert again.save(path) == 2 and set(first) < set(parts(tmp_path, "data")) and len(parts(tmp_path, "data")) == 2 and len(parts(tmp_path, "gone")) == 1
    now = VectorIndex.open(spark, path)
    assert len(now) == 40 == now.rows.count() and hits(now.search(-data[5], 1))[0][0] == "chunk-5" and hits(now.search(data[3], 1))[0][0] == "chunk-3"
    assert len(VectorIndex.open(spark, path, 1)) == 40 and hits(VectorIndex.open(spark, path, 1).search(data[5], 1))[0][0] == "chunk-5"
    assert now.rows.agg(F.count_distinct("seq")).first()[0] == 40
    assert now.save(path) == 3 and VectorIndex.vacuum(spark, path, 1) == 0
    with pytest.raises(IndexConfigError):
        VectorIndex.open(spark, path, 1)


def test_many_parts_become_one(spark, data, tmp_path, monkeypatch):
    from quillvec.operators import index as module

    monkeypatch.setattr(module, "MOST_PARTS", 2)
    path = str(tmp_path / "i")
    VectorIndex(spark, IndexConfig(16)).save(path)
    for k in range(3):
        i = VectorIndex.open(spark, path)
        i.add(frame(spark, data[k : k + 1], start=k))
        i.save(path)
    assert len(VectorIndex.open(spark, path)) == 3 and VectorIndex.vacuum(spark, path, 1) >= 1
    assert {r["chunk_id"] for r in VectorIndex.open(spark, path).rows.collect()} == {"chunk-0", "chunk-1", "chunk-2"}


def test_auto_is_fast_beyond_ten_thousand(spark, tmp_path):
    """Rows in hand: beyond the limit ``auto`` takes the two-stage search, and finds what the exact one finds."""
    x = np.random.default_rng(3).standard_normal((10_050, 8)).astype(np.float32)
    i = VectorIndex(spark, IndexConfig(8))
    i.add(frame(spark, x))
    exact, auto, fast = (hits(i.search(x[7], 10, mode=m)) for m in ("exact", "auto", "fast"))
    assert auto == fast and auto[0] == exact[0] and len({c for c, _ in exact} & {c for c, _ in auto}) >= 8
