"""Chunking: one text to several overlapping pieces.

Splitting is sequential within a text, so it runs in Python, batch by batch; overlap, section and id of the pieces are
Catalyst expressions in ``chunk_frame`` and plain Python in ``chunk_text``, with equal results.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from quillvec.errors import ChunkingError

SEPARATORS = ("\n" * 2, "\n", *(c + " " for c in ".!?;,"), " ")
HEADING = r"(?m)^(#{1,6})\s+(\S.*)$"
#: Characters of text whose pieces a worker gives back at once.
PART = 1 << 20
SUFFIXES = {"." + s for s in "markdown md pdf rst text txt".split()}


@dataclass(frozen=True)
class ChunkConfig:
    chunk_size: int = 512
    chunk_overlap: int = 64

    def __post_init__(self):
        if self.chunk_size <= 0 or self.chunk_overlap < 0:
            raise ValueError("chunk_size must be positive, chunk_overlap not negative")


def count_words(text: str) -> int:
    return len(text.split())


class BpeCount:
    """Counts tokens of a public BPE vocabulary (a ``.tiktoken`` file of ranks or a tokenizer's ``.json``); the file's path is a parameter.

    The vocabulary is read where it is used, once for each worker.
    """

    #: How byte-level BPE texts are cut before merging.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.path, self.pattern = path, pattern

    def __call__(self, text: str) -> int:
        return _bpe(self.path, self.pattern)(text)


@functools.cache
def _bpe(path: str, pattern: str) -> Callable[[str], int]:
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    e = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(e.encode_ordinary(text))


def _split(text: str, size: int, separators: tuple[str, ...], count: Callable[[str], int]) -> Iterator[str]:
    if count(text) <= size:
        yield text
        return
    for i, mark in enumerate(separators):
        parts = [p for p in (x.strip() for x in text.split(mark)) if p]
        if len(parts) > 1:
            for part in parts:
                yield from _split(part, size, separators[i + 1 :], count)
            return
    held: list[str] = []
    for word in text.split():
        if held and count(" ".join([*held, word])) > size:
            yield " ".join(held)
            held = []
        held.append(word)
    if held:
        yield " ".join(held)


def merged_segments(text: str | None, size: int, count: Callable[[str], int] = count_words) -> list[str]:
    """The pieces of a text before overlap; a blank text has none."""
    if text is None or not text.strip():
        return []
    out: list[str] = []
    held, total = [], 0
    for segment in _split(text.strip(), size, SEPARATORS, count):
        n = count(segment)
        if held and total + n > size:
            out.append(" ".join(held))
            held, total = [], 0
        held.append(segment)
        total += n
    if held:
        out.append(" ".join(held))
    return out


def overlapped(pieces: list[str], words: int) -> list[str]:
    """Each piece after the last ``words`` words of the one before it."""
    if words <= 0:
        return pieces
    return [p if i == 0 else " ".join([*pieces[i - 1].split()[-words:], p]) for i, p in enumerate(pieces)]


def chunk_id(source: str, place: int, piece: str) -> str:
    told = ":".join((source, str(place), piece[:200]))
    return "chunk-" + hashlib.sha256(told.encode()).hexdigest()[:12]


def headings(text: str) -> list[str]:
    return [m.group(2).strip() for m in re.finditer(HEADING, text)]


def chunk_text(text: str | None, source: str = "", config: ChunkConfig = ChunkConfig(), count: Callable[[str], int] = count_words) -> list[dict]:
    pieces = overlapped(merged_segments(text, config.chunk_size, count), config.chunk_overlap)
    titles = headings(text) if pieces else []
    return [
        {"chunk_id": chunk_id(source, i, p), "text": p, "source_doc": source, "section": next((t for t in titles if t in p), None), "metadata": {"chunk_index": i, "chunk_count": len(pieces)}}
        for i, p in enumerate(pieces)
    ]


@udtf(returnType="chunk_index int, chunk_count int, text string")
class ChunkText:
    """``SELECT ... FROM docs, LATERAL chunk_text(text, 512, 64)``."""

    def eval(self, text, size, overlap):
        pieces = overlapped(merged_segments(text, int(size)), int(overlap))
        for i, p in enumerate(pieces):
            yield i, len(pieces), p


def segments_udf(size: int, count: Callable[[str], int] = count_words):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: merged_segments(t, size, count))

    return run


def cut_frame(rows: DataFrame, text: str, out: str, size: int, count: Callable[[str], int] = count_words) -> DataFrame:
    """``rows`` with the pieces of a text in its place.

    What is made of a batch is given back in parts of ``PART`` characters of text, so that a worker holds one batch of texts and the
    pieces of one part, however long the texts are.
    """
    others = [c for c in rows.columns if c != text]

    def run(batches):
        for batch in batches:
            texts, at = batch.column(text), 0
            while at < len(batch):
                start, length, pieces = at, 0, []
                while at < len(batch) and length < PART:
                    t = texts[at].as_py()
                    pieces.append(merged_segments(t, size, count))
                    length, at = length + len(t or ""), at + 1
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(pieces, pa.list_(pa.string()))], names=[*others, out])

    kinds = T.StructType([*(rows.schema[c] for c in others), T.StructField(out, T.ArrayType(T.StringType()))])
    return rows.select(*others, text).mapInArrow(run, kinds)


def with_overlap(pieces, words: int):
    """Column: overlapping pieces of an array of pieces."""
    if words <= 0:
        return pieces
    tail = lambda p: F.array_join(F.slice(_words(p), F.greatest(F.size(_words(p)) - words + 1, F.lit(1)), F.lit(words)), " ")
    return F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(tail(F.get(pieces, i - 1)), F.lit(" "), p)))


def _words(c):
    return F.array_remove(F.split(c, r"\s+"), "")


def id_column(source, index, text):
    return F.concat(F.lit("chunk-"), F.substring(F.sha2(F.concat_ws(":", source, index.cast("string"), F.substring(text, 1, 200)), 256), 1, 12))


def titles_column(full_text):
    return F.transform(F.regexp_extract_all(full_text, F.lit(HEADING), F.lit(2)), lambda t: F.trim(t))


def section_column(full_text, piece):
    """The first heading of the whole text that the piece contains."""
    return section_of(titles_column(full_text), piece)


def section_of(titles, piece):
    return F.get(F.filter(titles, lambda t: F.contains(piece, t)), F.lit(0))


def chunk_frame(docs: DataFrame, text: str = "text", source: str = "source_doc", config: ChunkConfig = ChunkConfig(), count: Callable[[str], int] = count_words) -> DataFrame:
    """(chunk_id, text, source_doc, section, chunk_index, chunk_count) of each document's pieces.

    The headings are found once for each document; the whole text doesn't travel with its pieces.
    """
    base = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source_doc"), F.col(text).alias("full"))
    titled = base.select("source_doc", titles_column(F.col("full")).alias("titles"), "full")
    cut = cut_frame(titled, "full", "merged", config.chunk_size, count).where(F.size("merged") > 0)
    cut = cut.withColumn("pieces", with_overlap(F.col("merged"), config.chunk_overlap))
    rows = cut.select("source_doc", "titles", F.size("pieces").alias("chunk_count"), F.posexplode("pieces").alias("chunk_index", "text"))
    return rows.select(id_column(F.col("source_doc"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "text", "source_doc", section_of(F.col("titles"), F.col("text")).alias("section"), "chunk_index", "chunk_count")


def read_documents(spark: SparkSession, paths: list[str] | str, skip_failures: bool = False) -> DataFrame:
    """(source_doc, text) of text, Markdown and, where a PDF library is there, PDF files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    good, pdfs = [], []
    for p in paths:
        suffix = os.path.splitext(p)[1].lower()
        problem = None
        if suffix not in SUFFIXES:
            problem = f"unsupported file type: {p}"
        elif "://" not in p and not os.path.exists(p):
            problem = f"no such file: {p}"
        elif suffix == ".pdf":
            try:
                import pdfminer.high_level  # noqa: F401
            except ImportError:
                problem = f"no PDF library for {p}"
        if problem is None:
            (pdfs if suffix == ".pdf" else good).append(p)
        elif not skip_failures:
            raise ChunkingError(problem)
    schema = "source_doc string, text string"
    out = spark.createDataFrame([], schema)
    if good:
        texts = spark.read.format("text").option("wholetext", True).load(good)
        out = out.unionByName(texts.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source_doc"), F.col("value").alias("text")))
    if pdfs:

        def read(batches):
            import io

            from pdfminer.high_level import extract_text

            for pdf in batches:
                yield pd.DataFrame({"source_doc": pdf["path"].map(os.path.basename), "text": pdf["content"].map(lambda b: extract_text(io.BytesIO(b)))})

        out = out.unionByName(spark.read.format("binaryFile").load(pdfs).select("path", "content").mapInPandas(read, schema))
    return out
