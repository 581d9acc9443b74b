"""Near-duplicate documents by min-max hashing.

Each document is the set of its word 3-grams (lower case; a shorter text is one gram). Under each of 64 hash
permutations both the least and the greatest value are kept, so 64 hash evaluations give a signature of 128 values,
each of which two documents share with probability equal to their Jaccard similarity. Minima and maxima are banded
apart, 16 bands of 4 rows each; documents that share a band are compared by their whole signatures, and those whose
estimated similarity reaches the threshold form groups (connected components). Equal texts are one item from the start.

Defined cases: a text without words (null, empty, only punctuation) is never in a group, and neither is a document alone
in having its words. Repeated rows (same id and text) are copies of each other; one row stays. A null doc_id sorts
last when the row to keep is chosen, else the least doc_id stays; doc_id may be of any type. Columns besides doc_id and text
are carried along whatever their names; an empty table gives an empty result. Texts of any length are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm import textbytes as tb
from quillvec.llm.columns import kind, plain, repeated, restored
from quillvec.llm.components import bucket_edges, components
from quillvec.session import cut_lineage

PERMUTATIONS, ROWS, SHINGLE, THRESHOLD = 64, 4, 3, 0.6
#: Bits of a bitmap for each key in it, the least and the most bits that one has (8 MB), and the bits of one of its rows.
BITS_PER_KEY, LEAST_BITS, MOST_BITS, ROW_BITS = 16, 1 << 20, 1 << 26, 1 << 15
U = np.uint64
_rng = np.random.default_rng(20240607)
MULTIPLIERS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
ADDENDS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
PLACES = (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93))


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the word 3-grams, their document index), document by document."""
    data, offsets = tb.byte_view(texts)
    starts, ends, doc = tb.word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    words = tb.span_hashes(data, starts, ends)
    n = len(words)
    total, own = np.zeros(n, U), np.zeros(n, np.int64)
    for k, place in enumerate(PLACES):
        shifted, there = np.zeros(n, U), np.full(n, -1)
        shifted[: n - k], there[: n - k] = words[k:], doc[k:]
        inside = there == doc
        total += np.where(inside, shifted, U(0)) * place
        own += inside
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    use = (own == SHINGLE) | first
    return tb.mix(total[use]), doc[use]


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signature uint32[documents, 128], whether the document has words)."""
    n = len(texts)
    out, has = np.zeros((n, 2 * PERMUTATIONS), np.uint32), np.zeros(n, bool)
    hashes, doc = shingle_hashes(texts)
    if len(hashes):
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        rows = doc[at]
        has[rows] = True
        for p in range(PERMUTATIONS):
            v = ((hashes * MULTIPLIERS[p] + ADDENDS[p]) >> U(32)).astype(np.uint32)
            out[rows, p] = np.minimum.reduceat(v, at)
            out[rows, PERMUTATIONS + p] = np.maximum.reduceat(v, at)
    return out, has


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """int64[documents, bands]; a band's number is part of its hash."""
    parts = signature.reshape(len(signature), -1, ROWS).astype(U)
    total = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=U) * PLACES[0], parts.shape[:2]).copy()
    for r in range(ROWS):
        total = tb.mix(total + parts[:, :, r] * PLACES[1])
    return total.view(np.int64)


def _sign(batches):
    for batch in batches:
        texts = pc.utf8_lower(batch.column("text"))
        _, offsets = tb.byte_view(texts)
        for i, j in tb.chunks(offsets):
            signature, has = signatures(texts.slice(i, j - i))
            bands = band_hashes(signature)
            keep = np.flatnonzero(has)
            part = batch.slice(i, j - i).take(pa.array(keep))
            payload = np.ascontiguousarray(signature[keep].astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("id"),
                    pa.array([row.tobytes() for row in payload], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(keep) + 1, dtype=np.int32) * bands.shape[1], bands[keep].ravel()),
                ],
                names=["doc_id", "id", "payload", "bands"],
            )


def _alike_of(payload: pa.Array):
    matrix = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in payload])
    n = matrix.shape[1]
    half, rest = np.ascontiguousarray(matrix[:, : n // 2]), np.ascontiguousarray(matrix[:, n // 2 :])
    least = THRESHOLD * n

    def alike(x: int, others: np.ndarray) -> np.ndarray:
        # most unlike items differ in so much of the first half that the second can't make up for it
        same = (half[others] == half[x]).sum(1)
        may = np.flatnonzero(same + (n - n // 2) >= least)
        out = np.zeros(len(others), bool)
        out[may] = same[may] + (rest[others[may]] == rest[x]).sum(1) >= least
        return out

    return alike


def parts_of(payload: F.Column) -> F.Column:
    """Keys of which alike items share one: the signature in more parts than it may have differences."""
    values = 2 * PERMUTATIONS
    parts = values - int(np.ceil(THRESHOLD * values)) + 1
    edges = [round(k * values / parts) for k in range(parts + 1)]
    return F.array(*(F.xxhash64(F.lit(k), F.substring(payload, 2 * a + 1, 2 * (b - a))) for k, (a, b) in enumerate(zip(edges, edges[1:]))))


def text_key() -> F.Column:
    return F.unhex(F.md5(F.col("text"))).alias("id")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, id, copies, root): all documents that are in a group of two or more; root names the group.

    ``id`` is the digest of the text; ``copies`` counts rows with that doc_id and text.
    """
    narrow = plain(docs, ["doc_id", "text"]).select("doc_id", text_key(), "text").where(F.col("text").isNotNull())
    signed = cut_lineage(narrow.mapInArrow(_sign, f"doc_id {kind(narrow, 'doc_id')}, id binary, payload binary, bands array<long>"))
    rows = signed.groupBy("id", "doc_id").agg(F.count("*").alias("copies"))
    items = signed.select("id", "payload", "bands")
    roots = components(bucket_edges(items, lambda some: some.select(F.explode("bands").alias("bucket"), "id"), _alike_of, parts_of, again=True))
    joined = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # groups of any size: their counts and first documents are aggregates, combined before they are shuffled
    first = F.min_by(F.struct("doc_id", "id"), F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("first")
    sizes = joined.groupBy("root").agg(F.sum("copies").alias("size"), first).where("size > 1")
    return joined.join(sizes, "root")


def marked(docs: DataFrame) -> DataFrame:
    """``groups`` with ``stays``: whether a row of this document and text is the one that its group keeps."""
    return groups(docs).withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of, group_size): each document to drop, with the document of its group that stays."""
    dropped = marked(docs).withColumn("times", F.when(F.col("stays"), F.col("copies") - 1).otherwise(F.col("copies"))).where("times > 0")
    return repeated(dropped.select("doc_id", F.col("first.doc_id").alias("duplicate_of"), F.col("size").alias("group_size"), "times"), "times")


def told_apart(rows: DataFrame, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be one of the n keys, rows whose key is none of them); no row is shuffled.

    The keys are hashed into a bitmap of bounded size, which is broadcast. With more keys than it is made for, more rows
    are among the first, in vain; none of the keys is ever missed.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * n - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = keys.select(place("found_key").alias("place")).distinct().select(F.expr(f"place div {ROW_BITS}").alias("piece"), F.pmod("place", F.lit(ROW_BITS)).alias("bit"))
    # all bits of a piece come together before they are set, so that each piece is made once
    pieces = cut_lineage(at.repartition("piece").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bitmap")))
    mine = F.pmod(place(rows["key"]), F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring(pieces["bitmap"], (mine / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.floor(place(rows["key"]) / ROW_BITS) == pieces["piece"]) & (F.pmod(F.floor(byte / F.pow(F.lit(2), mine % 8)), F.lit(2)) == 1)
    return tuple(rows.join(F.broadcast(pieces), hit, how) for how in ("left_semi", "left_anti"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: one row of each group, and every row that is in none.

    Rows whose text is none of those to drop are read and returned as they are; only the others are joined.
    """
    inner = plain(docs, ["doc_id", "text"])
    found = cut_lineage(marked(inner).select(F.col("doc_id").alias("found_id"), F.col("id").alias("found_key"), "copies", "stays").where("not stays or copies > 1"))
    n, n_several = found.agg(F.count("*"), F.count(F.when(F.col("stays"), 1))).first()
    if not n:
        return docs
    tagged = inner.withColumn("key", text_key())
    some, others = told_apart(tagged, found, n)
    match = lambda other: some["doc_id"].eqNullSafe(other["found_id"]) & (some["key"] == other["found_key"])
    gone = found.select("found_id", "found_key")
    rest = others.select(inner.columns).unionByName(some.join(gone, match(gone), "left_anti").select(inner.columns))
    if n_several:
        # a survivor that stands there several times: one of its rows comes back
        several = found.where("stays").select("found_id", "found_key")
        back = some.join(several, match(several), "left_semi").dropDuplicates(["doc_id", "key"]).select(inner.columns)
        rest = rest.unionByName(back)
    return restored(rest, inner, docs)


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
