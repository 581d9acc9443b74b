"""Registered queries of the retrieval engine and their SQL twins.

Each entry of ``CATALOG`` is (query, SQL or None). The queries run over whole tables. The rotation is the unsigned Hadamard
one, which SQL can write down; values are rounded to nine digits before they are rounded to levels, in both.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.config import IndexConfig
from quillvec.functions import codec, exprs
from quillvec.operators import chunking, evaluate, filters, graph, hybrid, hydrate, search, traverse
from quillvec.operators.index import VectorIndex
from quillvec.session import ensure_checkpoint_dir
from quillvec.streaming.ingest import ingest_stream

DIM, TOP = 64, 10
CATALOG: dict = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        CATALOG[name] = (f, sql)
        return f

    return keep


def queries():
    return {n: f for n, (f, _) in CATALOG.items()}


def oracle_sql():
    return {n: s for n, (_, s) in CATALOG.items() if s is not None}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def config(bits: int = 3, **more) -> IndexConfig:
    return IndexConfig(DIM, bits=bits, seed=0, rotation_kind="srht", **more)


def vectors(spark, sf_dir: str) -> DataFrame:
    """(vec_id, label, v): unit vectors as doubles."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", exprs.normalized(exprs.doubles(F.col("embedding"))).alias("v"))


def rotated(spark, sf_dir: str) -> DataFrame:
    return exprs.hadamard(vectors(spark, sf_dir), "v", DIM, "y")


def encoded(spark, sf_dir: str, c: IndexConfig | None = None) -> DataFrame:
    """(chunk_id, seq, label, codes, sketch) by the Arrow encoder."""
    c = c or config()
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("seq"), "label", "embedding")
    return search.encode(e, c, codec.rotation(DIM, 0, "srht"))


def first_query(spark, sf_dir: str) -> np.ndarray:
    """The vector with the least id, as the query of single-query searches."""
    return np.array(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0], np.float64)


def prepared_first(spark, sf_dir: str, c: IndexConfig | None = None) -> np.ndarray:
    return codec.prepare(first_query(spark, sf_dir), c or config(), codec.rotation(DIM, 0, "srht"))


def levels_sql(bits: int) -> str:
    return f"list_transform(y, lambda x: CAST(round_even(round((least(greatest(x, -1.0::DOUBLE), 1.0::DOUBLE) + 1.0::DOUBLE) / 2.0::DOUBLE * {2**bits - 1}.0::DOUBLE, 9), 0) AS INTEGER))"


def deq_sql(levels: str, bits: int) -> str:
    return f"list_transform({levels}, lambda n: n::DOUBLE / {2**bits - 1}.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE)"


UNIT = """
u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT *, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) AS size FROM u),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / size) AS v FROM l)"""
ROTATED = UNIT + f""",
h AS (SELECT j, list(CASE WHEN bit_count(i & j) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS r
      FROM range({DIM}) a(i), range({DIM}) b(j) GROUP BY j),
t AS (SELECT vec_id, label, list(round(list_dot_product(v, r) / 8.0::DOUBLE, 9) ORDER BY j) AS y FROM n, h GROUP BY vec_id, label)"""
ENCODED = ROTATED + f""",
q AS (SELECT vec_id, label, y, {levels_sql(3)} AS levels FROM t),
d AS (SELECT *, {deq_sql('levels', 3)} AS deq FROM q)"""
FIRST = "(SELECT min(vec_id) FROM embeddings)"


# -- scalar functions of vectors


@register("vector_norms", f"WITH {UNIT} SELECT vec_id, round(size, 9) AS norm FROM l")
def vector_norms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(exprs.norm(exprs.doubles(F.col("embedding"))), 9).alias("norm"))


@register("normalize_vectors", f"WITH {UNIT} SELECT vec_id, CAST(unnest(range({DIM})) AS INTEGER) AS place, round(unnest(v), 9) AS value FROM n")
def normalize_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("place", "x")).select("vec_id", "place", F.round("x", 9).alias("value"))


@register("rotate_srht", f"WITH {ROTATED} SELECT vec_id, CAST(unnest(range({DIM})) AS INTEGER) AS place, unnest(y) AS value FROM t")
def rotate_srht(spark, sf_dir):
    return rotated(spark, sf_dir).select("vec_id", F.posexplode("y").alias("place", "value"))


def _levels(bits: int):
    @register(f"quantize_levels_{bits}bit", f"WITH {ROTATED} SELECT vec_id, array_to_string({levels_sql(bits)}, ',') AS levels FROM t")
    def run(spark, sf_dir):
        return rotated(spark, sf_dir).select("vec_id", F.array_join(exprs.levels(F.col("y"), bits), ",").alias("levels"))


for _bits in (2, 3, 4):
    _levels(_bits)


@register("pack_codes_hex_3bit", f"""WITH {ENCODED},
g AS (SELECT vec_id, k, CAST(list_sum(list_transform(range(8), lambda j: CAST(levels[k * 8 + j + 1] AS BIGINT) << CAST(3 * j AS BIGINT))) AS BIGINT) AS w FROM q, range({DIM // 8}) r(k))
SELECT vec_id, string_agg(printf('%02X%02X%02X', w & 255, (w >> 8) & 255, (w >> 16) & 255), '' ORDER BY k) AS codes, {DIM * 3 // 8} AS code_bytes FROM g GROUP BY vec_id""")
def pack_codes_hex_3bit(spark, sf_dir):
    packed = exprs.packed_hex(exprs.levels(F.col("y"), 3), DIM, 3)
    return rotated(spark, sf_dir).select("vec_id", packed.alias("codes"), F.lit(codec.bytes_per_vector(DIM, 3)).alias("code_bytes"))


@register("encode_arrow_hex_3bit", CATALOG["pack_codes_hex_3bit"][1])
def encode_arrow_hex_3bit(spark, sf_dir):
    e = encoded(spark, sf_dir)
    return e.select(F.col("seq").alias("vec_id"), F.hex("codes").alias("codes"), F.length("codes").alias("code_bytes"))


@register("unpack_roundtrip", f"WITH {ENCODED} SELECT vec_id, array_to_string(levels, ',') AS levels, true AS same_codes FROM q")
def unpack_roundtrip(spark, sf_dir):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            codes = codec.bytes_of(batch.column("codes"), codec.bytes_per_vector(DIM, 3))
            levels = codec.unpack(codes, DIM, 3)
            same = (codec.pack(levels, 3) == codes).all(1)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array([",".join(map(str, r)) for r in levels], pa.string()), pa.array(same)], names=["vec_id", "levels", "same_codes"])

    return encoded(spark, sf_dir).select("seq", "codes").mapInArrow(run, "vec_id long, levels string, same_codes boolean")


@register("dequantize_error", f"WITH {ENCODED} SELECT vec_id, round(list_max(list_transform(range(1, {DIM + 1}), lambda i: abs(y[i] - deq[i]))), 8) AS largest_error FROM d")
def dequantize_error(spark, sf_dir):
    r = rotated(spark, sf_dir).withColumn("deq", exprs.dequantized(exprs.levels(F.col("y"), 3), 3))
    return r.select("vec_id", F.round(F.array_max(F.zip_with("y", "deq", lambda a, b: F.abs(a - b))), 8).alias("largest_error"))


@register("compressed_dot_symmetric", f"WITH {ENCODED} SELECT d.vec_id, round(list_dot_product(d.deq, f.deq), 6) + 0.0 AS score FROM d, (SELECT deq FROM d WHERE vec_id = {FIRST}) f")
def compressed_dot_symmetric(spark, sf_dir):
    d = rotated(spark, sf_dir).select("vec_id", exprs.dequantized(exprs.levels(F.col("y"), 3), 3).alias("deq"))
    first = d.orderBy("vec_id").limit(1).select(F.col("deq").alias("f"))
    return d.crossJoin(F.broadcast(first)).select("vec_id", (F.round(exprs.dot(F.col("deq"), F.col("f")), 6) + 0.0).alias("score"))


WORDS = ENCODED + """,
w AS (SELECT vec_id, CAST(list_sum(list_transform(range(32), lambda j: CASE WHEN y[j + 1] >= 0 THEN 1::BIGINT << CAST(j AS BIGINT) ELSE 0::BIGINT END)) AS BIGINT) AS w0,
             CAST(list_sum(list_transform(range(32), lambda j: CASE WHEN y[j + 33] >= 0 THEN 1::BIGINT << CAST(j AS BIGINT) ELSE 0::BIGINT END)) AS BIGINT) AS w1 FROM t),
ham AS (SELECT w.vec_id, CAST(bit_count(xor(w.w0, f.w0)) + bit_count(xor(w.w1, f.w1)) AS INTEGER) AS distance FROM w, (SELECT w0, w1 FROM w WHERE vec_id = """ + FIRST + """) f)"""


@register("sketch_words", f"WITH {WORDS} SELECT vec_id, w0, w1 FROM w")
def sketch_words(spark, sf_dir):
    s = rotated(spark, sf_dir).select("vec_id", exprs.sketch_words(F.col("y"), DIM).alias("w"))
    return s.select("vec_id", F.get("w", F.lit(0)).alias("w0"), F.get("w", F.lit(1)).alias("w1"))


@register("hamming_topk", f"WITH {WORDS} SELECT vec_id, distance FROM ham ORDER BY distance, vec_id LIMIT 50")
def hamming_topk(spark, sf_dir):
    s = rotated(spark, sf_dir).select("vec_id", exprs.sketch_words(F.col("y"), DIM).alias("w"))
    first = s.orderBy("vec_id").limit(1).select(F.col("w").alias("f"))
    return s.crossJoin(F.broadcast(first)).select("vec_id", exprs.hamming(F.col("w"), F.col("f")).cast("int").alias("distance")).orderBy("distance", "vec_id").limit(50)


# -- search

HITS_OF_FIRST = f"s AS (SELECT d.vec_id, d.label, round(list_dot_product(d.deq, f.y), 9) AS score FROM d, (SELECT y FROM d WHERE vec_id = {FIRST}) f)"
RANKED = "CAST(row_number() OVER (ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank"


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def _haar() -> np.ndarray:
    return codec.rotation(DIM, 42, "haar")


def _haar_sql() -> str:
    rows = ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in map(float, row)) + "]" for row in _haar())
    return f"WITH {UNIT}, h AS (SELECT unnest(range({DIM})) AS place, unnest([{rows}]) AS r) SELECT vec_id, CAST(place AS INTEGER) AS place, round(list_dot_product(v, r), 5) + 0.0 AS value FROM n, h"


@register("rotate_haar", _haar_sql())
def rotate_haar(spark, sf_dir):
    """The random orthogonal rotation of every vector, by the Arrow path that the encoder takes."""
    import pyarrow as pa

    matrix = _haar()

    def run(batches):
        for batch in batches:
            x = codec.matrix_of(batch.column("embedding"), DIM, np.float64)
            y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), codec.TINY) @ matrix.T.astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(np.round(y.astype(np.float64), 5) + 0.0), pa.list_(pa.float64()))], names=["vec_id", "y"])

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, y array<double>")
    return rows.select("vec_id", F.posexplode("y").alias("place", "value"))


@register("exact_search_topk", f"WITH {ENCODED}, {HITS_OF_FIRST} SELECT vec_id, round(score, 6) AS score, rank FROM (SELECT *, {RANKED} FROM s) WHERE rank <= {TOP}")
def exact_search_topk(spark, sf_dir):
    return _shown(search.search_codes(encoded(spark, sf_dir), config(), prepared_first(spark, sf_dir), ["0"], TOP))


PAIRS = """p AS (SELECT a.vec_id AS query_id, d.vec_id, d.label, round(list_dot_product(d.deq, a.y), 9) AS score FROM d, d a),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM p)"""


def _batch(spark, sf_dir, k=TOP):
    """Every vector as a query."""
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.search_frame(encoded(spark, sf_dir), asked, config(), codec.rotation(DIM, 0, "srht"), k)


@register("exact_search_batch", f"WITH {ENCODED}, {PAIRS} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= {TOP}")
def exact_search_batch(spark, sf_dir):
    return _batch(spark, sf_dir).select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


SHORT = f"k AS (SELECT greatest({20 * TOP}, count(*) // 10) AS keep FROM embeddings), o AS (SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS place FROM ham)"
NEAR = "bound AS (SELECT max(distance) AS most FROM o, k WHERE place <= keep), short AS (SELECT vec_id FROM o, bound WHERE distance <= most)"
FAST = "SELECT vec_id, round(score, 6) AS score, rank FROM (SELECT s.*, " + RANKED + " FROM s JOIN short USING (vec_id)) WHERE rank <= " + str(TOP)


def _fast(spark, sf_dir, compat=False):
    rows = encoded(spark, sf_dir)
    return _shown(search.search_fast(rows, config(), prepared_first(spark, sf_dir), ["0"], TOP, table(spark, sf_dir, "embeddings").count(), compat))


@register("fast_search_topk", f"WITH {WORDS}, {HITS_OF_FIRST}, {SHORT}, {NEAR} {FAST}")
def fast_search_topk(spark, sf_dir):
    return _fast(spark, sf_dir)


@register("fast_search_row_order_compat", f"""WITH {WORDS}, {HITS_OF_FIRST}, {SHORT}, edge AS (SELECT max(distance) AS most FROM o, k WHERE place <= keep + 1),
c AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS place FROM o, edge WHERE distance <= most), short AS (SELECT vec_id FROM c, k WHERE place <= keep) {FAST}""")
def fast_search_row_order_compat(spark, sf_dir):
    return _fast(spark, sf_dir, True)


def _everyone(spark, sf_dir) -> DataFrame:
    """Every vector as a query."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _shown_batch(hits: DataFrame, score: str = "score") -> DataFrame:
    value = F.round(score, 6).alias(score) if score == "score" else F.col(score)
    return hits.select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("vec_id"), value, "rank")


ALL_FAST = f"""{PAIRS.split("," + chr(10))[0]}, k AS (SELECT greatest({20 * TOP}, count(*) // 10) AS keep FROM embeddings),
hp AS (SELECT a.vec_id AS query_id, w.vec_id, CAST(bit_count(xor(w.w0, a.w0)) + bit_count(xor(w.w1, a.w1)) AS INTEGER) AS distance FROM w, w a),
ho AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM hp),
bound AS (SELECT query_id, max(distance) AS most FROM ho, k WHERE place <= keep GROUP BY query_id),
fs AS (SELECT p.query_id, p.vec_id, p.score FROM p JOIN hp USING (query_id, vec_id) JOIN bound USING (query_id) WHERE distance <= most),
ff AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM fs)"""


def _fast_batch(spark, sf_dir, k: int = TOP) -> DataFrame:
    size = table(spark, sf_dir, "embeddings").count()
    return search.search_fast_frame(encoded(spark, sf_dir), _everyone(spark, sf_dir), config(), codec.rotation(DIM, 0, "srht"), k, size)


@register("fast_search_batch", f"WITH {WORDS}, {ALL_FAST} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ff WHERE rank <= {TOP}")
def fast_search_batch(spark, sf_dir):
    """The two-stage search of every vector."""
    return _shown_batch(_fast_batch(spark, sf_dir))


@register("fast_search_recall", f"""WITH {WORDS}, {ALL_FAST},
er AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM p)
SELECT er.query_id, count(ff.vec_id) / {TOP}.0::DOUBLE AS overlap FROM er LEFT JOIN ff ON ff.query_id = er.query_id AND ff.vec_id = er.vec_id AND ff.rank <= {TOP} WHERE er.rank <= {TOP} GROUP BY er.query_id""")
def fast_search_recall(spark, sf_dir):
    """The share of the exact hits that the two-stage search finds, for every vector."""
    return evaluate.overlap(_fast_batch(spark, sf_dir), _batch(spark, sf_dir)).select(F.col("query_id").cast("long").alias("query_id"), "overlap")


@register("hamming_batch", f"""WITH {WORDS}, hp AS (SELECT a.vec_id AS query_id, w.vec_id, CAST(bit_count(xor(w.w0, a.w0)) + bit_count(xor(w.w1, a.w1)) AS INTEGER) AS distance FROM w, w a)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM hp) WHERE rank <= {TOP}""")
def hamming_batch(spark, sf_dir):
    """The nearest sketches of every vector."""
    e = encoded(spark, sf_dir)
    return _shown_batch(search.hamming_frame(e, e.select(F.col("chunk_id").alias("query_id"), "sketch"), DIM // 8, TOP), "distance")


@register("filtered_search_batch", f"WITH {ENCODED}, {PAIRS.split(',' + chr(10))[0]} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM p WHERE label >= 2 AND label <> 3) WHERE rank <= {TOP}")
def filtered_search_batch(spark, sf_dir):
    """Every vector as a query among those that a filter keeps."""
    e = encoded(spark, sf_dir).withColumn("m", F.parse_json(F.to_json(F.struct("label"))))
    kept = e.where(filters.predicate({"label": {"$gte": 2, "$ne": 3}}, F.col("m")))
    return _shown_batch(search.search_frame(kept, _everyone(spark, sf_dir), config(), codec.rotation(DIM, 0, "srht"), TOP))


def _searched(bits: int):
    hits = f"WITH {ROTATED}, q AS (SELECT vec_id, label, y, {levels_sql(bits)} AS levels FROM t), d AS (SELECT *, {deq_sql('levels', bits)} AS deq FROM q), {PAIRS}"

    @register(f"exact_search_batch_{bits}bit", f"{hits} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= {TOP}")
    def run(spark, sf_dir):
        c = config(bits)
        return _shown_batch(search.search_frame(encoded(spark, sf_dir, c), _everyone(spark, sf_dir), c, codec.rotation(DIM, 0, "srht"), TOP))


for _bits in (2, 4):
    _searched(_bits)


@register("float_baseline_topk", f"WITH {UNIT}, s AS (SELECT n.vec_id, round(list_dot_product(n.v, f.v), 9) AS score FROM n, (SELECT v FROM n WHERE vec_id = {FIRST}) f) SELECT vec_id, round(score, 6) AS score, rank FROM (SELECT *, {RANKED} FROM s) WHERE rank <= {TOP}")
def float_baseline_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return _shown(search.search_floats(e, first_query(spark, sf_dir), ["0"], TOP))


# -- filters


def _filter(name: str, spec: dict, where: str):
    @register(f"filter_{name}", f"SELECT event_id FROM (SELECT event_id, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events) WHERE {where}")
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("m"))
        return e.where(filters.predicate(spec, F.col("m"))).select("event_id")


_filter("eq", {"k": 42}, "k = 42")
_filter("ne", {"k": {"$ne": 42}}, "k <> 42")
_filter("in", {"k": {"$in": [1, 2, 3.0, "4"]}}, "k IN (1, 2, 3)")
_filter("nin", {"k": {"$nin": [1, 2, 3]}}, "k NOT IN (1, 2, 3)")
_filter("range", {"k": {"$gte": 20, "$lt": 60}}, "k >= 20 AND k < 60")
_filter("exists", {"k": {"$exists": True}, "missing": {"$exists": False}}, "k IS NOT NULL")
_filter("compound", {"k": {"$gt": 10, "$lte": 90, "$nin": [50]}, "missing": {"$exists": False}}, "k > 10 AND k <= 90 AND k <> 50")

MIXED = ['{"x": 5}', '{"x": "5"}', '{"x": 5.0}', '{"x": true}', '{"x": null}', '{"x": [5]}', '{"x": {"y": 5}}', '{"y": 5}', '{"x": 4.5}', '{"x": "abc"}', '{"x": false}']
TESTS = [("eq 5", {"x": 5}), ("eq '5'", {"x": "5"}), ("eq true", {"x": True}), ("eq 1", {"x": 1}), ("eq null", {"x": None}), ("gt 4", {"x": {"$gt": 4}}), ("lt 'b'", {"x": {"$lt": "b"}}), ("ne 5", {"x": {"$ne": 5}}), ("nin", {"x": {"$nin": [5, "5"]}}), ("list", {"x": [5]}), ("object", {"x": {"$eq": {"y": 5}}})]
EXPECTED = [(0, 2), (1,), (3,), (3,), (4,), (0, 2, 8), (1, 9), (1, 3, 4, 5, 6, 8, 9, 10), (3, 4, 5, 6, 8, 9, 10), (5,), (6,)]


@register("filter_type_mismatch", "SELECT * FROM (VALUES " + ", ".join("('" + t[0].replace("'", "''") + f"', {i})" for t, rows in zip(TESTS, EXPECTED) for i in rows) + ") v(test, row_no)")
def filter_type_mismatch(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(MIXED)), "row_no int, json string").select("row_no", F.parse_json("json").alias("m"))
    checks = F.array(*(F.when(filters.predicate(spec, F.col("m")), F.lit(name)) for name, spec in TESTS))
    return rows.select(F.explode(F.filter(checks, lambda t: t.isNotNull())).alias("test"), "row_no")


@register("filtered_search_topk", f"WITH {ENCODED}, {HITS_OF_FIRST} SELECT vec_id, round(score, 6) AS score, rank FROM (SELECT *, {RANKED} FROM s WHERE label >= 2 AND label <> 3) WHERE rank <= {TOP}")
def filtered_search_topk(spark, sf_dir):
    e = encoded(spark, sf_dir).withColumn("m", F.parse_json(F.to_json(F.struct("label"))))
    kept = e.where(filters.predicate({"label": {"$gte": 2, "$ne": 3}}, F.col("m")))
    return _shown(search.search_codes(kept, config(), prepared_first(spark, sf_dir), ["0"], TOP))


# -- the index


def _batch_of(spark, sf_dir, where: str = "true") -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(where)
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.to_json(F.struct("label")).alias("metadata"))


def _numbers(where: str, start: str = "0", shard: str = "0", size: int = 100) -> str:
    n = "(row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) - 1)"
    return f"SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST({start} + {n} AS BIGINT) AS seq, CAST({shard} + {n} // {size} AS INTEGER) AS shard FROM embeddings WHERE {where}"


@register("shard_assignment", _numbers("true"))
def shard_assignment(spark, sf_dir):
    index = VectorIndex(spark, config(shard_size=100))
    index.add(_batch_of(spark, sf_dir))
    return index.rows.select("chunk_id", "seq", "shard")


COUNT_EVEN = "(SELECT count(*) FROM embeddings WHERE label < 3)"


@register("index_add_dedupe", f"{_numbers('label < 3')} UNION ALL SELECT * FROM ({_numbers('label >= 3', COUNT_EVEN, f'(({COUNT_EVEN} + 99) // 100)')})")
def index_add_dedupe(spark, sf_dir):
    """One part of the vectors is added, then all that aren't there yet."""
    index = VectorIndex(spark, config(shard_size=100))
    index.add(_batch_of(spark, sf_dir, "label < 3"))
    index.add_new(_batch_of(spark, sf_dir))
    return index.rows.select("chunk_id", "seq", "shard")


@register("index_delete", f"SELECT * FROM ({_numbers('true')}) WHERE chunk_id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE label = 0)")
def index_delete(spark, sf_dir):
    index = VectorIndex(spark, config(shard_size=100))
    index.add(_batch_of(spark, sf_dir))
    index.delete(_batch_of(spark, sf_dir, "label = 0"))
    return index.rows.select("chunk_id", "seq", "shard")


TOTAL = "(SELECT count(*) FROM embeddings)"


@register("index_update", f"SELECT * FROM ({_numbers('true')}) WHERE chunk_id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE label = 1) UNION ALL {_numbers('label = 1', TOTAL, f'(({TOTAL} + 99) // 100)')}")
def index_update(spark, sf_dir):
    index = VectorIndex(spark, config(shard_size=100))
    index.add(_batch_of(spark, sf_dir))
    index.update(_batch_of(spark, sf_dir, "label = 1").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    return index.rows.select("chunk_id", "seq", "shard")


@register("index_save_open", f"WITH {ENCODED}, {HITS_OF_FIRST} SELECT vec_id, round(score, 6) AS score, rank FROM (SELECT *, {RANKED} FROM s WHERE label IN (1, 4)) WHERE rank <= {TOP}")
def index_save_open(spark, sf_dir):
    """Built, saved, opened again, searched with a filter."""
    path = _folder(spark, "index")
    index = VectorIndex(spark, config())
    index.add(_batch_of(spark, sf_dir))
    index.save(path)
    again = VectorIndex.open(spark, path)
    return _shown(again.search(first_query(spark, sf_dir), TOP, filters_={"label": {"$in": [1, 4]}}))


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("stream_ingest_append", _numbers("true", size=100_000))
def stream_ingest_append(spark, sf_dir):
    """The table as a file stream, appended to an index until the stream is empty."""
    path = _folder(spark, "stream")
    kind = table(spark, sf_dir, "embeddings").schema
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/embeddings.parquet*")
    rows = stream.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.to_json(F.struct("label")).alias("metadata"))
    ingest_stream(rows, path, config(), f"{path}-checkpoint").awaitTermination()
    return VectorIndex.open(spark, path).rows.select("chunk_id", "seq", "shard")


# -- records


def _hits(spark, sf_dir) -> DataFrame:
    return _fast_base(spark, sf_dir).select("chunk_id", "score", "rank")


def _fast_base(spark, sf_dir, k: int = 50) -> DataFrame:
    return search.search_codes(encoded(spark, sf_dir), config(), prepared_first(spark, sf_dir), ["0"], k)


def _records(spark, sf_dir, labelled: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    if labelled:
        d = d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text"), F.col("source").alias("source_doc"), F.lit(None).cast("int").alias("page_num"))


def _wide_hits(spark, sf_dir) -> DataFrame:
    """The hits of every vector as hits of records: a vector's record is the document of three times its id, which may not exist."""
    return _batch(spark, sf_dir).select("query_id", (F.col("chunk_id").cast("long") * 3).cast("string").alias("chunk_id"), "score", "rank")


WIDE = f"WITH {ENCODED}, {PAIRS}, x AS (SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(vec_id * 3 AS VARCHAR) AS chunk_id, vec_id * 3 AS wanted, rank FROM r WHERE rank <= {TOP}), rec AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


@register("hydrate_left", f"{WIDE} SELECT query_id, chunk_id, rank, md5(coalesce(text, '')) AS text_md5, source AS source_doc, CASE WHEN text IS NULL THEN '{hydrate.UNHYDRATED}' END AS explanation FROM x LEFT JOIN documents ON doc_id = wanted")
def hydrate_left(spark, sf_dir):
    out = hydrate.hydrate(_wide_hits(spark, sf_dir), _records(spark, sf_dir, False))
    return out.select("query_id", "chunk_id", "rank", F.md5("text").alias("text_md5"), "source_doc", "explanation")


@register("hydrate_inner", f"{WIDE} SELECT query_id, chunk_id, rank, md5(text) AS text_md5, source AS source_doc FROM x JOIN documents ON doc_id = wanted")
def hydrate_inner(spark, sf_dir):
    out = hydrate.hydrate(_wide_hits(spark, sf_dir), _records(spark, sf_dir, False), False)
    return out.select("query_id", "chunk_id", "rank", F.md5("text").alias("text_md5"), "source_doc")


@register("hydrate_batch", CATALOG["hydrate_left"][1])
def hydrate_batch(spark, sf_dir):
    """As hydrate_left, each record fetched once for all queries."""
    out = hydrate.hydrate_batch(_wide_hits(spark, sf_dir), _records(spark, sf_dir, False))
    return out.select("query_id", "chunk_id", "rank", F.md5("text").alias("text_md5"), "source_doc", "explanation")


@register("hydrate_fallback", f"{WIDE} SELECT query_id, chunk_id, rank, md5(coalesce(rec.text, documents.text, '')) AS text_md5 FROM x LEFT JOIN rec ON rec.doc_id = wanted LEFT JOIN documents ON documents.doc_id = wanted")
def hydrate_fallback(spark, sf_dir):
    """The local store holds the labelled documents, the outside one, asked for the missing ids, all."""
    outside = _records(spark, sf_dir, False)
    source = hydrate.Source(lambda ids: outside.join(ids, "chunk_id", "left_semi"))
    out = hydrate.hydrate_fallback(_wide_hits(spark, sf_dir), _records(spark, sf_dir), source)
    return out.select("query_id", "chunk_id", "rank", F.md5("text").alias("text_md5"))


@register("coerce_records_documents", """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, md5(text) AS text_md5, source AS source_doc, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE CAST(n_chars AS INTEGER) END AS page_num,
CASE WHEN doc_id % 3 = 1 THEN lang END AS section, CASE WHEN doc_id % 3 = 1 THEN '{"section":"' || lang || '"}' WHEN doc_id % 3 = 2 THEN '{"kind":"' || lang || '"}' ELSE '{}' END AS metadata, CAST(NULL AS VARCHAR) AS error FROM documents WHERE trim(text, ' ') <> ''""")
def coerce_records_documents(spark, sf_dir):
    """All documents as JSON lines, in three of the shapes that stores use."""
    d = table(spark, sf_dir, "documents").where(F.trim("text") != "")
    flat = F.struct(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source"))
    paged = F.struct(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("source_doc"), F.col("n_chars").alias("page_num"), F.col("lang").alias("section"))
    nested = F.struct(F.struct(F.col("doc_id").alias("_id"), F.col("text").alias("page_content"), F.col("source"), F.col("n_chars").cast("string").alias("page_number"), F.col("lang").alias("kind")).alias("metadata"))
    shape = F.col("doc_id") % 3
    lines = d.select(F.when(shape == 0, F.to_json(flat)).when(shape == 1, F.to_json(paged)).otherwise(F.to_json(nested)).alias("value"))
    out = hydrate.coerce_records(lines)
    return out.select("chunk_id", F.md5("text").alias("text_md5"), "source_doc", F.coalesce("page_num", F.lit(-1)).alias("page_num"), "section", "metadata", "error")


RAW = [
    ('{"chunk_id": "a", "text": "one", "source_doc": "s", "page_num": 3, "section": "intro", "metadata": {"topic": "x"}}', "a", "one", "s", 3, "intro", '{"topic":"x","section":"intro"}', None),
    ('{"id": 7, "content": "two", "page": "12", "payload": {"kind": 1, "page": 4}}', "7", "two", None, 12, None, '{"kind":1}', None),
    ('{"_id": "c", "metadata": {"page_content": "three", "source": "m", "page_number": ""}}', "c", "three", "m", None, None, "{}", None),
    ('{"metadata": {"_id": "d", "document": "four"}}', "d", "four", None, None, None, "{}", None),
    ('{"text": "no id"}', None, "no id", None, None, None, "{}", "no id"),
    ('{"id": "e"}', "e", None, None, None, None, "{}", "no text"),
    ("not json", None, None, None, None, None, "{}", "not JSON"),
]


def _lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


@register("coerce_records", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_lit, (i, *r[1:4], -1 if r[4] is None else r[4], *r[5:]))) + ")" for i, r in enumerate(RAW)) + ") v(line, chunk_id, text, source_doc, page_num, section, metadata, error)")
def coerce_records(spark, sf_dir):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RAW)], "line int, value string")
    return hydrate.coerce_records(rows).drop("embedding").withColumn("page_num", F.coalesce("page_num", F.lit(-1)))


# -- chunking

LINES = """x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '') AS parts FROM documents),
p AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS chunk_index, unnest(parts) AS piece FROM x),
w AS (SELECT *, list_filter(regexp_split_to_array(lag(piece) OVER (PARTITION BY doc_id ORDER BY chunk_index), '[ \\t\\n\\f\\r]+'), lambda z: z <> '') AS before FROM p),
c AS (SELECT *, CASE WHEN before IS NULL THEN piece ELSE array_to_string(before[-5:], ' ') || ' ' || piece END AS text FROM w)"""


def _pieces(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "").alias("parts"))
    return d.select("doc_id", F.posexplode(chunking.with_overlap(F.col("parts"), 5)).alias("chunk_index", "text"))


@register("chunk_overlap", f"WITH {LINES} SELECT doc_id, chunk_index, md5(text) AS text_md5 FROM c")
def chunk_overlap(spark, sf_dir):
    return _pieces(spark, sf_dir).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


@register("chunk_ids", f"WITH {LINES} SELECT doc_id, chunk_index, 'chunk-' || substr(sha256(doc_id || ':' || chunk_index || ':' || substr(text, 1, 200)), 1, 12) AS chunk_id FROM c")
def chunk_ids(spark, sf_dir):
    p = _pieces(spark, sf_dir)
    return p.select("doc_id", "chunk_index", chunking.id_column(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("text")).alias("chunk_id"))


@register("chunk_documents")
def chunk_documents(spark, sf_dir):
    return chunking.chunk_frame(table(spark, sf_dir, "documents"), source="doc_id", config=chunking.ChunkConfig(128, 16))


MARKDOWN = "# Alpha\nAlpha is first.\n## Beta part\nNothing here.\n### Gamma\nBeta part again and Gamma."
PIECES = ["Alpha is first.", "Nothing here.", "Beta part again and Gamma.", "Gamma alone"]


@register("markdown_sections", "SELECT * FROM (VALUES (0, 'Alpha'), (1, NULL), (2, 'Beta part'), (3, 'Gamma')) v(piece_no, section)")
def markdown_sections(spark, sf_dir):
    rows = spark.createDataFrame([(i, p, MARKDOWN) for i, p in enumerate(PIECES)], "piece_no int, piece string, full string")
    return rows.select("piece_no", chunking.section_column(F.col("full"), F.col("piece")).alias("section"))


@register("markdown_sections_documents", f"""WITH {LINES},
m AS (SELECT doc_id, '# ' || substr(trim(parts[1]), 1, 6) || chr(10) || text AS full_text FROM x JOIN documents USING (doc_id) WHERE len(parts) > 0),
h AS (SELECT doc_id, list_transform(regexp_extract_all(full_text, '(?m)^(#{{1,6}})\\s+(\\S.*)$', 2), lambda t: trim(t)) AS titles FROM m)
SELECT p.doc_id, chunk_index, list_filter(titles, lambda t: contains(p.piece, t))[1] AS section FROM p JOIN h USING (doc_id)""")
def markdown_sections_documents(spark, sf_dir):
    """The lines of all documents, each of which gets a heading from its own first line."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "").alias("parts")).where(F.size("parts") > 0)
    full = F.concat(F.lit("# "), F.substring(F.trim(F.get("parts", F.lit(0))), 1, 6), F.lit("\n"), F.col("text"))
    rows = d.select("doc_id", chunking.titles_column(full).alias("titles"), F.posexplode("parts").alias("chunk_index", "piece"))
    return rows.select("doc_id", "chunk_index", chunking.section_of(F.col("titles"), F.col("piece")).alias("section"))


# -- graph

TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents({0})), '[^a-z0-9]+'), lambda w: w <> '')"


@register("tokenize_normalize", f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)")
def tokenize_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", traverse.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@register("entity_detect", f"""WITH q AS (SELECT doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS line FROM documents),
e AS (SELECT DISTINCT item_id, array_to_string(({TOKENS.format('text')})[1:3], ' ') AS name FROM benchmark)
SELECT DISTINCT doc_id, name FROM q JOIN e ON name <> '' AND contains(line, ' ' || name || ' ')""")
def entity_detect(spark, sf_dir):
    """Documents that mention an entity; the entities are the first three words of the benchmark's items."""
    names = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(traverse.tokens(F.col("text")), 1, 3), " ").alias("name")).distinct()
    found = traverse.detect(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text"), names)
    return found.select(F.col("query_id").alias("doc_id"), "name")


def payloads(spark, sf_dir) -> DataFrame:
    """An extraction payload for each order: its parts' brands and types, related with the discount as weight."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_returnflag").join(parts, "l_partkey")
    entity = lambda name, kind: F.struct(F.col(name).alias("name"), F.lit(kind).alias("type"), F.lit("").alias("description"))
    relation = F.struct(F.col("p_brand").alias("source"), F.col("p_type").alias("target"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("weight"))
    grouped = rows.groupBy("l_orderkey").agg(F.flatten(F.collect_list(F.array(entity("p_brand", "brand"), entity("p_type", "kind")))).alias("entities"), F.collect_list(relation).alias("relationships"))
    return grouped.select(F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("l_orderkey").alias("seq"), F.to_json(F.struct("entities", "relationships")).alias("payload"))


SEEN = "j AS (SELECT l_orderkey, l_discount, l_returnflag, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT p_brand AS name, 'brand' AS type, l_orderkey FROM j UNION ALL SELECT p_type, 'kind', l_orderkey FROM j)"


@register("graph_nodes", f"WITH {SEEN} SELECT name, min(type) AS type, '' AS description, CAST(count(DISTINCT l_orderkey) AS INTEGER) AS chunks, min(l_orderkey) AS first_seq FROM m GROUP BY name")
def graph_nodes(spark, sf_dir):
    n = graph.nodes(payloads(spark, sf_dir))
    return n.select("name", "type", "description", F.size("chunk_ids").alias("chunks"), "first_seq")


@register("graph_edges", f"WITH {SEEN} SELECT least(p_brand, p_type) AS src, greatest(p_brand, p_type) AS dst, max(l_discount) AS weight, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS relations FROM j GROUP BY 1, 2")
def graph_edges(spark, sf_dir):
    p = payloads(spark, sf_dir)
    e = graph.edges(p, graph.nodes(p))
    return e.select("src", "dst", "weight", F.array_join("relations", ",").alias("relations"))


@register("graph_stats", f"WITH {SEEN} SELECT count(DISTINCT name) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type FROM j)) AS edge_count, 0::BIGINT AS community_count, 'brand,kind' AS entity_types FROM m")
def graph_stats(spark, sf_dir):
    p = payloads(spark, sf_dir)
    n = graph.nodes(p)
    return graph.stats(n, graph.edges(p, n)).select("node_count", "edge_count", "community_count", F.array_join("entity_types", ",").alias("entity_types"))


def region_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): customers in nations in regions; a node's chunks are the customer's key or nothing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region")
    customer = c.select(F.concat(F.lit("customer "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("name"), F.array(F.col("c_custkey").cast("string")).alias("chunk_ids"))
    places = n.select(F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name"))).distinct().withColumn("chunk_ids", F.array().cast("array<string>"))
    home = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("customer "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("a"), F.col("n_name").alias("b"))
    up = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    edges = home.unionByName(up).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit(1.0).alias("weight"))
    return customer.unionByName(places), edges


REGION = """c AS (SELECT 'customer ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name, c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT name AS a, n_name AS b FROM c UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e)"""
REACH = f"WITH RECURSIVE {REGION}, reach(name, label) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.dst, reach.label FROM reach JOIN b ON b.src = reach.name AND b.dst > reach.label), comp AS (SELECT name, min(label) AS component FROM reach GROUP BY name)"


def _components(spark, sf_dir) -> DataFrame:
    nodes, edges = region_graph(spark, sf_dir)
    return graph.components(edges, nodes)


@register("graph_components", f"{REACH} SELECT name, component FROM comp")
def graph_components(spark, sf_dir):
    return _components(spark, sf_dir)


@register("community_summary", f"{REACH} SELECT CAST(row_number() OVER (ORDER BY component) - 1 AS INTEGER) AS community_id, CAST(count(*) AS INTEGER) AS size, array_to_string(list_sort(list(name))[1:20], ', ') AS summary FROM comp GROUP BY component")
def community_summary(spark, sf_dir):
    groups = graph.communities(_components(spark, sf_dir))
    return groups.select("community_id", F.size("members").alias("size")).join(graph.summaries(groups, 20), "community_id")


def _reached(spark, sf_dir) -> DataFrame:
    _, edges = region_graph(spark, sf_dir)
    starts = table(spark, sf_dir, "region").select(F.col("r_name").alias("query_id"), F.col("r_name").alias("name"))
    return traverse.bfs(starts, edges, 2)


WALK = f"WITH {REGION}, walk AS (SELECT r_name AS query_id, r_name AS name, 0 AS depth, r_name AS path FROM region UNION SELECT r_name, n_name, 1, r_name || ' -> ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, name, 2, r_name || ' -> ' || n_name || ' -> ' || name FROM c)"


@register("graph_bfs_depth2", f"{WALK} SELECT query_id, name, depth, path FROM walk")
def graph_bfs_depth2(spark, sf_dir):
    return _reached(spark, sf_dir).select("query_id", "name", "depth", F.array_join("path", " -> ").alias("path"))


def _graph_hits(spark, sf_dir, k: int = 20) -> DataFrame:
    nodes, _ = region_graph(spark, sf_dir)
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("chunk_id"))
    return traverse.candidates(_reached(spark, sf_dir), nodes, records, k)


GRAPH_HITS = "g AS (SELECT * FROM (SELECT r_name AS query_id, CAST(c_custkey AS VARCHAR) AS chunk_id, 1.0::DOUBLE / 3 AS score, r_name || ' -> ' || n_name || ' -> ' || name AS path, CAST(row_number() OVER (PARTITION BY r_name ORDER BY CAST(c_custkey AS VARCHAR)) AS INTEGER) AS rank FROM c) WHERE rank <= 20)"


@register("graph_candidates", f"WITH {REGION}, {GRAPH_HITS} SELECT query_id, chunk_id, round(score, 6) AS score, path, rank FROM g")
def graph_candidates(spark, sf_dir):
    return _graph_hits(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join("path", " -> ").alias("path"), "rank")


def _merged(spark, sf_dir) -> DataFrame:
    """The dense hits of the first vector against the graph hits of each region."""
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("query_id"))
    dense = regions.crossJoin(_hits(spark, sf_dir))
    return hybrid.merge(dense, _graph_hits(spark, sf_dir))


MERGED = f"""WITH {ENCODED.replace('d AS (', 'dd AS (').replace('h AS (', 'hh AS (').replace('n, h GROUP', 'n, hh GROUP')}, {HITS_OF_FIRST.replace(' d.', ' dd.').replace('(d.', '(dd.').replace('FROM d', 'FROM dd')},
x AS (SELECT * FROM (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, score, {RANKED} FROM s) WHERE rank <= 50), {REGION}, {GRAPH_HITS},
dense AS (SELECT r_name AS query_id, chunk_id, score FROM region, x),
z AS (SELECT coalesce(dense.query_id, g.query_id) AS query_id, coalesce(dense.chunk_id, g.chunk_id) AS chunk_id, coalesce(dense.score, 0) + coalesce(g.score, 0) AS score, g.path FROM dense FULL JOIN g ON dense.query_id = g.query_id AND dense.chunk_id = g.chunk_id)"""


@register("hybrid_merge", f"{MERGED}, k AS (SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM z) SELECT * FROM k WHERE rank <= 15")
def hybrid_merge(spark, sf_dir):
    return hybrid.ranked(_merged(spark, sf_dir), 15).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register("hybrid_explain", f"{MERGED} SELECT query_id, chunk_id, coalesce('Matched graph path: ' || path, '{hybrid.DENSE_NOTE}') AS explanation FROM z")
def hybrid_explain(spark, sf_dir):
    return _merged(spark, sf_dir).select("query_id", "chunk_id", "explanation")


# -- evaluation

FLOATS = """fp AS (SELECT a.vec_id AS query_id, n.vec_id, round(list_dot_product(n.v, a.v), 9) AS score FROM n, n a),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM fp)"""


def _float_batch(spark, sf_dir, k: int) -> DataFrame:
    """Exact float neighbours of every vector, as the truth."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return search.search_floats_frame(rows, _everyone(spark, sf_dir), DIM, k)


@register("float_search_batch", f"WITH {UNIT}, {FLOATS} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM fr WHERE rank <= {TOP}")
def float_search_batch(spark, sf_dir):
    """The float baseline of every vector."""
    return _shown_batch(_float_batch(spark, sf_dir, TOP))


def _cases(spark, sf_dir, k: int = 5) -> DataFrame:
    return _float_batch(spark, sf_dir, k).groupBy("query_id").agg(F.collect_list("chunk_id").alias("relevant_ids"))


@register("eval_recall_mrr", f"""WITH {ENCODED}, {PAIRS}, {FLOATS},
hit AS (SELECT fr.query_id, count(r.vec_id) AS found, min(r.rank) AS first FROM fr LEFT JOIN r ON r.query_id = fr.query_id AND r.vec_id = fr.vec_id AND r.rank <= {TOP} WHERE fr.rank <= 5 GROUP BY fr.query_id)
SELECT query_id, round(found / 5.0::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank FROM hit""")
def eval_recall_mrr(spark, sf_dir):
    out = evaluate.per_query(_batch(spark, sf_dir), _cases(spark, sf_dir))
    return out.select(F.col("query_id").cast("long").alias("query_id"), F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@register("eval_overlap", f"""WITH {ENCODED}, {PAIRS}, {FLOATS}
SELECT fr.query_id, count(r.vec_id) / {TOP}.0::DOUBLE AS overlap FROM fr LEFT JOIN r ON r.query_id = fr.query_id AND r.vec_id = fr.vec_id AND r.rank <= {TOP} WHERE fr.rank <= {TOP} GROUP BY fr.query_id""")
def eval_overlap(spark, sf_dir):
    return evaluate.overlap(_batch(spark, sf_dir), _float_batch(spark, sf_dir, TOP)).select(F.col("query_id").cast("long").alias("query_id"), "overlap")


@register("eval_comparison", "SELECT * FROM (VALUES ('float', 1.0::DOUBLE, 1.0::DOUBLE, 64.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), ('exact', 0.95::DOUBLE, 0.9::DOUBLE, 128.0::DOUBLE, -0.05::DOUBLE, -0.1::DOUBLE, 2.0::DOUBLE)) v(label, recall, mrr, qps, recall_delta, mrr_delta, qps_ratio)")
def eval_comparison(spark, sf_dir):
    runs = spark.createDataFrame([("float", 1.0, 1.0, 64.0), ("exact", 0.95, 0.9, 128.0)], "label string, recall double, mrr double, qps double")
    return evaluate.comparison(runs, "float")


@register("endpoint_metrics", "SELECT event_type AS endpoint, count(*) AS requests, CAST(sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY event_type")
def endpoint_metrics(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), F.col("value").alias("ms"), (F.col("value") < 0).alias("failed"))
    return evaluate.endpoint_metrics(log).withColumns({"total_ms": F.round("total_ms", 4), "avg_ms": F.round("avg_ms", 6)})
