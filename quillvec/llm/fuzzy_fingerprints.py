"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 bytes ends a piece wherever it is -1 modulo the block size, so that the pieces of a passage
stay the same when text before it changes. Each piece gives one of 64 letters. The block size is the least 3 * 2^k that
makes about 64 pieces at most, halved while fewer than 32 come out; the fingerprint ``size:a:b`` has the letters at that
size and at twice it. As usual for these hashes, the last of at most 64 letters covers all the rest of the text, and runs
of more than three equal letters are shortened before fingerprints are compared.

Two fingerprints are compared at equal block sizes (a with a, b with b, a with the other's b). They are alike when they
share 7 letters in a row and their edit distance (insertions and deletions) leaves a similarity of ``LEAST`` out of 100;
documents linked by alike fingerprints form a family. Candidates come from an index of all 7-letter grams, which finds
every pair that shares one, so no alike pair is missed; nothing is capped. Equal texts are one family in any case.

Defined cases: null and empty texts have no fingerprint and no family. Fingerprints of fewer than 7 letters at both sizes
say too little to compare: such documents form a family with those of the same text (by SHA-256) only. Runs are shortened
first, so a text that is nearly all one run is grouped by its whole fingerprint, not with near copies. Repeated rows are members of one
family. The family's name is its least doc_id (null ids only: null). An empty table gives an empty result; columns besides
doc_id and text are not read. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm import textbytes as tb
from quillvec.llm.columns import kind, plain
from quillvec.llm.components import bucket_edges, components
from quillvec.session import cut_lineage

WINDOW, LETTERS, GRAM, LEAST, SMALLEST = 7, 64, 7, 60.0, 3
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, of that byte and up to six before it in the same document."""
    n = len(offsets) - 1
    shift = np.repeat(np.arange(1, n + 1) * (WINDOW - 1), np.diff(offsets))
    place = np.arange(len(data)) + shift
    padded = np.zeros(len(data) + (n + 1) * (WINDOW - 1), np.uint32)
    padded[place] = data
    total = np.zeros(len(padded), np.uint32)
    for j in range(WINDOW):
        b = padded[WINDOW - 1 - j : len(padded) - j]
        total[WINDOW - 1 :] += b * np.uint32(1 + WINDOW - j)
    mixed = np.zeros(len(padded), np.uint32)
    for j in range(WINDOW):
        mixed[WINDOW - 1 :] ^= padded[WINDOW - 1 - j : len(padded) - j] << np.uint32(5 * j)
    return (total + mixed)[place]


def _letters(data, offsets, hashes, sizes) -> list[bytes]:
    """The letters of each document at its block size."""
    lengths = np.diff(offsets)
    per_byte = np.repeat(sizes, lengths)
    ends = np.flatnonzero(hashes % per_byte == per_byte - 1) + 1
    doc = np.searchsorted(offsets, ends - 1, "right") - 1
    # the last letter always ends with the document; before it at most 63 pieces
    first = np.searchsorted(doc, np.arange(len(lengths)))
    rank = np.arange(len(ends)) - first[doc]
    ok = (rank < LETTERS - 1) & (ends < offsets[doc + 1])
    ends, doc = ends[ok], doc[ok]
    filled = np.flatnonzero(lengths)
    ends, doc = np.concatenate((ends, offsets[filled + 1])), np.concatenate((doc, filled))
    order = np.lexsort((ends, doc))
    ends, doc = ends[order], doc[order]
    starts = np.where(np.concatenate(([True], doc[1:] != doc[:-1])), offsets[doc], np.concatenate(([0], ends[:-1])))
    out = ALPHABET[(tb.span_hashes(data, starts, ends) & np.uint64(63)).astype(np.int64)].tobytes()
    cut = np.searchsorted(doc, np.arange(len(lengths) + 1))
    return [out[cut[k] : cut[k + 1]] for k in range(len(lengths))]


def fingerprints(texts: pa.Array) -> list[str | None]:
    data, offsets = tb.byte_view(texts)
    lengths = np.diff(offsets)
    hashes = rolling(data, offsets)
    sizes = np.full(len(lengths), SMALLEST, np.uint32)
    while (small := sizes.astype(np.int64) * LETTERS < lengths).any():
        sizes[small] *= 2
    todo = np.flatnonzero((sizes > SMALLEST) & (lengths > 0))
    while len(todo):
        part = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in todo])
        per_byte = np.repeat(sizes[todo], lengths[todo])
        hit = hashes[part] % per_byte == per_byte - 1
        borders = np.concatenate(([0], np.cumsum(lengths[todo])))
        found = np.add.reduceat(hit.astype(np.int64), borders[:-1]) + 1
        todo = todo[(found < LETTERS // 2) & (sizes[todo] > SMALLEST)]
        sizes[todo] //= 2
        todo = todo[sizes[todo] > SMALLEST]
    one, two = (_letters(data, offsets, hashes, s) for s in (sizes, sizes * np.uint32(2)))
    return [f"{sizes[k]}:{one[k].decode()}:{two[k].decode()}" if lengths[k] else None for k in range(len(lengths))]


def _fingerprint(batches):
    for batch in batches:
        _, offsets = tb.byte_view(batch.column("text"))
        for i, j in tb.chunks(offsets):
            part = batch.slice(i, j - i)
            prints = fingerprints(part.column("text"))
            digests = [hashlib.sha256(part.column("text")[k].as_py().encode()).digest() if p and _is_short(p) else None for k, p in enumerate(prints)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.string()), pa.array(digests, pa.binary())], names=["doc_id", "fingerprint", "digest"])


def _is_short(fingerprint: str) -> bool:
    return max(map(len, fingerprint.split(":")[1:])) < GRAM


def _run_short(letters: str) -> str:
    out: list[str] = []
    for c in letters:
        if out[-3:] != [c, c, c]:
            out.append(c)
    return "".join(out)


def entries(fingerprint: str) -> list[tuple[int, str]]:
    """(block size, letters), runs shortened."""
    size, a, b = fingerprint.split(":")
    return [(int(size), _run_short(a)), (2 * int(size), _run_short(b))]


def common(letters: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a string (at most 64 letters) with each row of codes (padded with 255), by bits."""
    masks = np.zeros(256, np.uint64)
    for i, c in enumerate(letters):
        masks[c] |= np.uint64(1 << i)
    masks[255] = 0
    v = np.full(len(codes), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for column in codes.T:
        u = v & masks[column]
        v = (v + u) | (v - u)
    keep = np.uint64((1 << len(letters)) - 1)
    return np.bitwise_count(~v & keep)


def _alike_of(payload: pa.Array):
    prints = payload.to_pylist()
    items = [entries(x) for x in prints]
    sizes = np.array([[e[0] for e in item] for item in items])
    length = np.array([[len(e[1]) for e in item] for item in items])
    codes = np.full((len(items), 2, LETTERS), 255, np.uint8)
    for k, item in enumerate(items):
        for e in range(2):
            codes[k, e, : length[k, e]] = np.frombuffer(item[e][1].encode(), np.uint8)
    # how often each letter occurs: what two strings have in common can't be more than the lesser counts
    counts = np.zeros((len(items), 2, 256), np.uint8)
    for e in range(2):
        np.add.at(counts[:, e], (np.arange(len(items))[:, None], codes[:, e]), 1)
    counts = np.ascontiguousarray(counts[:, :, np.sort(ALPHABET)])

    def alike(x: int, others: np.ndarray) -> np.ndarray:
        good = np.zeros(len(others), bool)
        if _is_short(prints[x]):
            # too short to compare but by equality; among texts, ``families`` holds equal ones against their digests
            good[:] = [prints[o] == prints[x] for o in others]
        for e in range(2):
            mine = codes[x, e, : length[x, e]]
            if len(mine) < GRAM:
                continue
            for f in range(2):
                ok = np.flatnonzero((sizes[others, f] == sizes[x, e]) & (length[others, f] >= GRAM) & ~good)
                if not len(ok):
                    continue
                both = length[x, e] + length[others[ok], f]
                may = 200.0 * np.minimum(counts[x, e], counts[others[ok], f]).sum(1, dtype=np.int64) >= LEAST * both
                ok, both = ok[may], both[may]
                if not len(ok):
                    continue
                high = ok[200.0 * common(mine, codes[others[ok], f]) >= LEAST * both]
                grams = {mine[i : i + GRAM].tobytes() for i in range(len(mine) - GRAM + 1)}
                for h in high:
                    text = codes[others[h], f, : length[others[h], f]].tobytes()
                    good[h] = any(text[i : i + GRAM] in grams for i in range(len(text) - GRAM + 1))
        return good

    return alike


def _grams(batches):
    for batch in batches:
        ids, prints = batch.column("id").to_pylist(), batch.column("payload").to_pylist()
        buckets, owners = [], []
        for i, p in zip(ids, prints):
            own = {f"{size}:{s[k : k + GRAM]}" for size, s in entries(p) for k in range(len(s) - GRAM + 1)}
            buckets += own
            owners += [i] * len(own)
        text = pa.array(buckets, pa.string())
        data, offsets = tb.byte_view(text)
        hashes = tb.span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64) if len(buckets) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(owners, pa.binary())], names=["bucket", "id"])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, digest) of each row; the text's digest where the fingerprint is too short to compare."""
    docs = plain(docs, ["doc_id", "text"]).select("doc_id", "text")
    return docs.mapInArrow(_fingerprint, f"doc_id {kind(docs, 'doc_id')}, fingerprint string, digest binary")


def families(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, family, family_size): family is null for a document that is like no other."""
    prints = cut_lineage(fingerprinted(docs).withColumn("id", F.unhex(F.md5("fingerprint"))))
    items = prints.where("fingerprint is not null").groupBy("id").agg(F.first("fingerprint").alias("payload"))
    roots = components(bucket_edges(items, lambda some: some.select("id", "payload").mapInArrow(_grams, "bucket long, id binary"), _alike_of))
    own = F.when(F.col("fingerprint").isNotNull(), F.coalesce("digest", "id"))
    joined = cut_lineage(prints.join(roots, "id", "left").select("doc_id", "fingerprint", F.coalesce("root", own).alias("root")))
    # families of any size: their counts and least ids are aggregates, combined before they are shuffled
    sizes = joined.where("root is not null").groupBy("root").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    return joined.join(sizes, "root", "left").select("doc_id", "fingerprint", F.col("least").alias("family"), F.coalesce("n", F.lit(1)).cast("long").alias("family_size"))


def query(spark, sf_dir: str) -> DataFrame:
    return families(spark.read.parquet(f"{sf_dir}/documents.parquet"))
