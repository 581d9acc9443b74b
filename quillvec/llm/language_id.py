"""Language identification by the nearest of several centroids.

A text is a vector of its byte 2- and 3-grams (lower case, all but letters as blanks), hashed into ``DIMENSIONS`` places,
with logarithmic term frequencies times inverse document frequencies, scaled to length one. Document frequencies are
counted over all documents. For each language of the column ``lang``, spherical k-means splits the vectors of a sample of
labelled documents into ``CENTROIDS`` centroids. The sample is bounded for each language on its own: ``MAX_LABELLED`` over
the number of languages, but one at least, those with the least hashes of doc_id and text; no language is ever left out. A document takes the language of the nearest centroid by cosine; it is rejected ("und") when it is
farther from it than that centroid's radius, which lies beyond nearly all of the centroid's own training vectors. The
cosine of a short text is small by nature: with fewer than ``FULL_TEXT`` different n-grams the least cosine shrinks with
the square root of their number.

Defined cases: a null or empty text, or one without letters, has no vector: its language is "und", its cosine 0. Rows
with a null or empty lang are classified but not used to fit. With no labelled rows everything is "und". Ties of cosine go
to the first language by name. Repeated rows are classified alike and count once in the sample, as rows do that lack a
doc_id and have one text; an empty table gives an empty result. doc_id may be of any type. ``classify`` reads doc_id, text
and lang only, whatever other columns there are; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.llm import textbytes as tb
from quillvec.llm.columns import kind, plain

DIMENSIONS, CENTROIDS, MAX_LABELLED, ROUNDS = 4096, 3, 1200, 12
#: The radius leaves out this share of a centroid's training vectors, times a slack for texts shorter than those.
RADIUS_SHARE, RADIUS_SLACK = 0.002, 0.5
CHUNK_DOCS, UNKNOWN, FULL_TEXT, SPREAD = 256, "und", 150, 256

LETTERS = np.full(256, 32, np.uint8)
for _lo, _hi in ((65, 90), (97, 122), (128, 255)):
    LETTERS[_lo : _hi + 1] = np.arange(_lo, _hi + 1)


def term_counts(texts: pa.Array) -> np.ndarray:
    """float32[documents, DIMENSIONS]: how often each hashed n-gram occurs."""
    data, offsets = tb.byte_view(texts)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * 2, lengths)
    padded = np.full(len(data) + 2 * n + 2, 32, np.uint32)
    padded[place] = LETTERS[data]
    doc = np.repeat(np.arange(n), lengths) * DIMENSIONS
    a, b, c = padded[place], padded[place - 1], padded[place - 2]
    bits = np.uint32(32 - 12)
    two = ((a + b * np.uint32(257)) * np.uint32(2654435761)) >> bits
    three = ((a + b * np.uint32(257) + c * np.uint32(66049)) * np.uint32(2246822519)) >> bits
    lettered = (a != 32) | (b != 32)
    deep = lettered | (c != 32)
    at = np.concatenate(((doc + two)[lettered], (doc + three)[deep]))
    return np.bincount(at, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)


def parts(batches):
    """(slice of the batch, its term counts), a few hundred documents at a time."""
    for batch in batches:
        texts = pc.utf8_lower(batch.column("text"))
        _, offsets = tb.byte_view(texts)
        for i, j in tb.chunks(offsets):
            for k in range(i, j, CHUNK_DOCS):
                m = min(j, k + CHUNK_DOCS) - k
                yield batch.slice(k, m), term_counts(texts.slice(k, m))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each hashed n-gram, documents), over all documents."""

    def count(batches):
        total, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for _, counts in parts(batches):
            total[:-1] += (counts > 0).sum(0)
            n += len(counts)
        total[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(total)], names=["place", "n"])

    rows = docs.select("text").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        out[r["place"]] = r["n"]
    return out[:-1], int(out[-1])


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def sample(docs: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, np.ndarray]]:
    """(language, term counts) of the labelled sample, in a fixed order: for each language its own share of ``most``, at least one.

    A row is chosen by the hash of its doc_id and text. The least hashes are found in two steps, first within ``SPREAD``
    parts of a language, so that no task sees more than a part of a language that holds most rows.
    """
    named = docs.select("lang", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("key")).where("lang is not null and lang <> '' and text is not null")
    langs = named.agg(F.count_distinct("lang")).first()[0]
    if not langs:
        return []
    each = max(1, most // langs)
    by_part = Window.partitionBy("lang", "part").orderBy("key")
    by_lang = Window.partitionBy("lang").orderBy("key")
    few = named.select("lang", "key").withColumn("part", F.pmod("key", F.lit(SPREAD))).withColumn("n", F.row_number().over(by_part)).where(F.col("n") <= each)
    chosen = few.withColumn("n", F.row_number().over(by_lang)).where(F.col("n") <= each).select(F.col("lang").alias("lang_"), F.col("key").alias("key_")).distinct()
    # at most ``each`` rows of two short columns for each language, whatever the size of the table; copies of a row count once
    texts = named.join(F.broadcast(chosen), (named["key"] == chosen["key_"]) & (named["lang"] == chosen["lang_"])).groupBy("lang", "key").agg(F.min("text").alias("text"))

    def counted(batches):
        for part, counts in parts(batches):
            rows = [np.flatnonzero(c).astype(np.int16) for c in counts]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([c[r].astype(np.uint32).tobytes() for c, r in zip(counts, rows)], pa.binary())], names=["lang", "key", "places", "counts"])

    rows = texts.mapInArrow(counted, "lang string, key long, places binary, counts binary").collect()
    out = []
    for r in sorted(rows, key=lambda r: (r["lang"], r["key"])):
        v = np.zeros(DIMENSIONS, np.float32)
        v[np.frombuffer(r["places"], np.int16)] = np.frombuffer(r["counts"], np.uint32)
        out.append((r["lang"], v))
    return out


def cluster(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, least cosine accepted at each) by spherical k-means from far-apart starts."""
    centres = [v.mean(0) / max(np.linalg.norm(v.mean(0)), 1e-12)]
    while len(centres) < min(k, len(v)):
        centres.append(v[int((v @ np.array(centres).T).max(1).argmin())])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        for i in range(len(c)):
            if (own == i).any():
                m = v[own == i].mean(0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
    cos = v @ c.T
    own, best = cos.argmax(1), cos.max(1)
    # a centroid of few vectors takes the radius of the whole language
    least = [np.quantile(best[own == i] if (own == i).sum() >= 20 else best, RADIUS_SHARE) * RADIUS_SLACK for i in range(len(c))]
    return c, np.array(least)


def fit(docs: DataFrame) -> dict:
    seen, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    rows = sample(docs)
    langs, centroids, least = [], [], []
    for lang in sorted({x for x, _ in rows}):
        v = vectors(np.array([c for x, c in rows if x == lang]), idf)
        v = v[np.linalg.norm(v, axis=1) > 0]
        if len(v):
            c, r = cluster(v, CENTROIDS)
            langs += [lang] * len(c)
            centroids.append(c)
            least.append(r)
    return {"idf": idf, "langs": langs, "centroids": np.concatenate(centroids).astype(np.float32) if langs else np.zeros((0, DIMENSIONS), np.float32), "least": np.concatenate(least) if langs else np.zeros(0)}


def nearest(counts: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    if not model["langs"]:
        return [UNKNOWN] * len(counts), np.zeros(len(counts))
    cos = vectors(counts, model["idf"]).astype(np.float32) @ model["centroids"].T
    best = cos.argmax(1)
    top = cos[np.arange(len(cos)), best].astype(float)
    least = model["least"][best] * np.sqrt(np.minimum(1, (counts > 0).sum(1) / FULL_TEXT))
    return [model["langs"][b] if t > 0 and t >= r else UNKNOWN for b, t, r in zip(best, top, least)], np.round(np.maximum(top, 0), 4)


def classify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, lang, predicted, cosine) of each row."""
    docs = plain(docs, ["doc_id", "lang", "text"]).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    model = fit(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids for each language, whatever the size of the table

    def run(batches):
        for part, counts in parts(batches):
            langs, cosine = nearest(counts, shared.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(langs, pa.string()), pa.array(cosine)], names=["doc_id", "lang", "predicted", "cosine"])

    return docs.mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, lang string, predicted string, cosine double")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
