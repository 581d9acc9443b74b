"""Searches whose queries are a table, against brute force, and what they hold and shuffle."""

import numpy as np
import pyarrow as pa
import pytest

from quillvec.config import IndexConfig
from quillvec.functions import codec
from quillvec.operators import search

DIM, K = 16, 5
C = IndexConfig(DIM, seed=0, rotation_kind="srht")
MATRIX = codec.rotation(DIM, 0, "srht")


@pytest.fixture(scope="module")
def data(spark):
    """700 vectors, every third one a copy of another, some zero; 60 queries, the last one zero."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((700, DIM)).astype(np.float32)
    base[::3] = base[rng.integers(0, 20, len(base[::3])) * 3 + 1]
    base[5:9] = 0
    asked = np.concatenate((base[:50], rng.standard_normal((9, DIM)), np.zeros((1, DIM)))).astype(np.float32)
    rows = spark.createDataFrame([(f"v{i}", i, v.tolist()) for i, v in enumerate(base)], "chunk_id string, seq long, embedding array<float>").repartition(6)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)], "query_id string, embedding array<float>").repartition(3)
    return base, asked, search.encode(rows, C, MATRIX), rows, queries


def best(scores, k=K):
    """{query: [(id, score)]} of scores[queries, rows]; -inf doesn't count."""
    ids = [f"v{i}" for i in range(scores.shape[1])]
    return {f"q{q}": [(i, s) for s, i in sorted(((-x, i) for x, i in zip(own, ids) if x > -np.inf))[:k]] for q, own in enumerate(scores)}


def found(hits, score="score"):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], -r[score]))
    return out


def scored(base, asked, decimals=9):
    codes, _ = codec.encode(base, C, MATRIX)
    weights, bias = codec.affine(codec.prepare(asked, C, MATRIX), C.bits, C.value_range)
    return np.round(codec.unpack(codes, DIM, C.bits).astype(np.float64) @ weights + bias, decimals).T


def same(got, expected):
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    assert all(abs(a - b) < 2e-9 for q in got for (_, a), (_, b) in zip(got[q], expected[q]))


def test_codes(data):
    base, asked, rows, _, queries = data
    same(found(search.search_frame(rows, queries, C, MATRIX, K)), best(scored(base, asked)))


def test_floats(data):
    base, asked, _, rows, queries = data
    unit = lambda x: x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), codec.TINY)
    same(found(search.search_floats_frame(rows, queries, DIM, K)), best(np.round(unit(asked) @ unit(base).T, 9)))


def test_more_asked_than_there_are(data):
    base, asked, rows, _, queries = data
    few = rows.where("seq < 7")
    same(found(search.search_frame(few, queries, C, MATRIX, 20)), best(scored(base[:7], asked), 20))


def test_hamming(data, spark):
    base, asked, rows, _, _ = data
    sketches = codec.encode(np.concatenate((base, asked)), C, MATRIX)[1]
    own, wanted = sketches[: len(base)], sketches[len(base) :]
    queries = spark.createDataFrame([(f"q{i}", w.tobytes()) for i, w in enumerate(wanted)], "query_id string, sketch binary").repartition(3)
    distances = np.stack([codec.hamming(own, w) for w in wanted])
    got = found(search.hamming_frame(rows, queries, DIM // 8, 40), "distance")
    same({q: [(i, -d) for i, d in v] for q, v in got.items()}, best(-distances.astype(float), 40))


def test_two_stages(data):
    base, asked, rows, _, queries = data
    _, own = codec.encode(base, C, MATRIX)
    distances = np.stack([codec.hamming(own, w) for w in codec.sketch(codec.prepare(asked, C, MATRIX))])
    keep = search.shortlist_size(K, len(base))
    edge = np.sort(distances, 1)[:, keep - 1]
    expected = best(np.where(distances <= edge[:, None], scored(base, asked), -np.inf))
    same(found(search.search_fast_frame(rows, queries, C, MATRIX, K, len(base))), expected)


@pytest.mark.parametrize("k", [1, 7, 30])
def test_small_tiles(k, monkeypatch):
    for name, value in {"STRIP": 8, "TILE": 16, "SEED": 20, "PAIRS": 64}.items():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(k)
    rows, asked = rng.integers(-1, 2, (333, 4)).astype(float), rng.integers(-1, 2, (21, 4)).astype(float)
    ids = [f"v{i}" for i in range(333)]

    def block(at, size):
        own = rows[at]
        tile, slack = search._dots(asked, own)
        return search._Block(tile, slack, lambda q, r: -np.round(search._pair_dots(own[r], asked[q]), 9))

    b = search._Best(pa.array([f"q{i}" for i in range(21)]), k, block)
    for part in np.array_split(rng.permutation(333), 9):
        at = sorted(part, key=lambda i: ids[i])
        b.add(pa.array([ids[i] for i in at]), at)
    got = {}
    for r in b.result().to_pylist():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], -r["score"]))
    assert got == best(asked @ rows.T, k)


def test_sketches_of_several_words():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (5, 19), dtype=np.uint8), rng.integers(0, 256, (7, 19), dtype=np.uint8)
    tile, pairs = search._differing(search._words(a.tobytes(), 5, 19), search._words(b.tobytes(), 7, 19))
    out = np.empty((5, 7), search._distance_kind(19))
    tile(slice(0, 5), slice(0, 7), out)
    expected = np.stack([codec.hamming(b, x) for x in a])
    assert (out == expected).all() and (pairs(np.arange(5), np.arange(5)) == np.diag(expected)).all()
    tile(slice(1, 3), slice(2, 6), wide := np.empty((2, 4), np.uint16))
    assert (wide == expected[1:3, 2:6]).all()


@pytest.mark.parametrize("make", ["codes", "floats"])
def test_hits_before_ranking_are_queries_times_k(data, make, monkeypatch):
    _, asked, codes, rows, queries = data
    monkeypatch.setattr(search, "top_k", lambda hits, k: hits)
    hits = search.search_frame(codes, queries, C, MATRIX, K) if make == "codes" else search.search_floats_frame(rows, queries, DIM, K)
    assert hits.count() == len(asked) * K


def test_equal_rows_are_not_all_held():
    n = 40
    same_row = np.ones((n, 4))
    asked = np.ones((3, 4))

    def block(rows, size):
        tile, slack = search._dots(asked, rows)
        return search._Block(tile, slack, lambda q, r: -np.round(search._pair_dots(rows[r], asked[q]), 9))

    b = search._Best(pa.array(list("abc")), 2, block)
    for i in reversed(range(50)):
        b.add(pa.array([f"{i:02}-{j:02}" for j in range(n)]), same_row)
        assert len(b.q) <= 6 * 3 * 2
    assert b.result().column(1).to_pylist() == ["00-00", "00-01"] * 3
