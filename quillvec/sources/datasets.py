"""Data sets of records with embeddings (JSON lines, NPZ), record snapshots and query cases."""

from __future__ import annotations

import json
import os
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillvec.config import IndexConfig
from quillvec.errors import DatasetFormatError
from quillvec.operators.hydrate import Source, coerce_records
from quillvec.operators.index import VectorIndex
from quillvec.sources import backends

DATASET = "chunk_id string, text string, source_doc string, page_num int, section string, metadata string, embedding array<float>"
NPZ_OPTIONAL = {"texts": "text", "source_docs": "source_doc", "page_nums": "page_num", "sections": "section", "metadata_json": "metadata"}


def format_of(path: str, kind: str = "auto") -> str:
    if kind != "auto":
        if kind not in ("jsonl", "npz"):
            raise ValueError(f"unknown data set format {kind}")
        return kind
    suffix = os.path.splitext(path)[1].lower()
    known = {".jsonl": "jsonl", ".ndjson": "jsonl", ".npz": "npz"}
    if suffix not in known:
        raise ValueError(f"can't tell the format of {path}")
    return known[suffix]


def _all_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value); line orders the lines of all files by file, split and place in the split."""
    text = spark.read.text(path)
    return text.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place")).alias("line"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank ones of ``_all_lines``."""
    return _all_lines(spark, path).where(F.trim("value") != "")


def _number(spark: SparkSession, path: str, line) -> int:
    """A line's number in its file, from 1; counted only where a message needs it."""
    before = (F.col("line.start") < line["start"]) | (F.col("line.start") == line["start"]) & (F.col("line.place") <= line["place"])
    return _all_lines(spark, path).where((F.col("line.file") == line["file"]) & before).count()


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    rows = coerce_records(_lines(spark, path))
    problem = F.coalesce("error", F.when(F.col("embedding").isNull(), "no embedding"))
    bad = rows.withColumn("problem", problem).where("problem is not null").agg(F.min_by("problem", "line"), F.min("line")).first()
    if bad[0] is not None:
        raise DatasetFormatError(f"{path}, line {_number(spark, path, bad[1])}: {bad[0]}")
    return validated(rows.select("embedding", *backends.COLUMNS))


def _member(archive: zipfile.ZipFile, name: str):
    """An array's open file behind its header, its shape and type."""
    f = archive.open(f"{name}.npy")
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if dtype.hasobject or fortran and len(shape) > 1:
        raise DatasetFormatError(f"{name} isn't a plain array in order of rows")
    return f, shape, dtype


def _rows_of(archive: zipfile.ZipFile, name: str, a: int, b: int) -> np.ndarray:
    """Rows a to b of an array of an archive, which is not loaded whole."""
    f, shape, dtype = _member(archive, name)
    with f:
        size = dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        f.seek(a * size, os.SEEK_CUR)
        return np.frombuffer(f.read((b - a) * size), dtype).reshape(b - a, *shape[1:])


class _NpzReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        with zipfile.ZipFile(self.path) as z:
            shapes = {n.removesuffix(".npy"): _member(z, n.removesuffix(".npy"))[1] for n in z.namelist()}
        for need in ("embeddings", "ids"):
            if need not in shapes:
                raise DatasetFormatError(f"{self.path} has no {need}")
        n = shapes["ids"][0]
        if len(shapes["embeddings"]) != 2 or shapes["embeddings"][0] != n or any(k in shapes and shapes[k][0] != n for k in NPZ_OPTIONAL):
            raise DatasetFormatError("arrays of different lengths")
        return [InputPartition((i, min(n, i + self.rows))) for i in range(0, n, self.rows)]

    def read(self, partition):
        a, b = partition.value
        with zipfile.ZipFile(self.path) as z:
            known = {n.removesuffix(".npy") for n in z.namelist()}
            columns = {name: _rows_of(z, key, a, b) for key, name in NPZ_OPTIONAL.items() if key in known}
            ids, x = _rows_of(z, "ids", a, b), _rows_of(z, "embeddings", a, b).astype(np.float32)
        text = lambda name, i: str(columns[name][i]) if name in columns and str(columns[name][i]) != "" else None
        for i in range(b - a):
            page = text("page_num", i)
            yield (str(ids[i]), text("text", i) or "", text("source_doc", i), int(float(page)) if page else None, text("section", i), text("metadata", i) or "{}", x[i].tolist())


class NpzSource(DataSource):
    """``spark.read.format("quillvec_npz").load(path)``: slices of one NumPy archive."""

    @classmethod
    def name(cls):
        return "quillvec_npz"

    def schema(self):
        return DATASET

    def reader(self, schema):
        return _NpzReader(self.options["path"], int(self.options.get("rows", 50_000)))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.exists(path):
        raise DatasetFormatError(f"no such file: {path}")
    with zipfile.ZipFile(path) as z:
        for need in ("embeddings", "ids"):
            if f"{need}.npy" not in z.namelist():
                raise DatasetFormatError(f"{path} has no {need}")
    spark.dataSource.register(NpzSource)
    return validated(spark.read.format("quillvec_npz").load(path))


def read_dataset(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    return {"jsonl": read_jsonl, "npz": read_npz}[format_of(path, kind)](spark, path)


def validated(rows: DataFrame) -> DataFrame:
    """``rows``, known to be some, with vectors of one length and ids that differ."""
    size = F.size("embedding")
    r = rows.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    if not r["n"]:
        raise DatasetFormatError("the data set has no records")
    if r["least"] != r["most"] or r["least"] < 1:
        raise DatasetFormatError("vectors differ in length")
    if r["ids"] != r["n"]:
        raise DatasetFormatError("ids repeat")
    return rows


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot; of records with the same id the last one counts."""
    rows = coerce_records(_lines(spark, path)).where("error is null").drop("error", "embedding")
    columns = [c for c in rows.columns if c not in ("line", "chunk_id")]
    last = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*columns), "line").alias("r"))
    return last.select("chunk_id", "r.*")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_vector, relevant_ids) of a JSON-lines file; all three are required."""
    lines = _lines(spark, path)
    v = F.try_parse_json("value")
    rows = lines.select("line", F.try_variant_get(v, "$.query_id", "string").alias("query_id"), F.try_variant_get(v, "$.query_vector", "array<float>").alias("query_vector"), F.try_variant_get(v, "$.relevant_ids", "array<string>").alias("relevant_ids"))
    bad = rows.where("query_id is null or query_vector is null or relevant_ids is null").agg(F.min("line")).first()[0]
    if bad is not None:
        raise DatasetFormatError(f"{path}, line {_number(spark, path, bad)}: query_id, query_vector and relevant_ids are required")
    return rows.drop("line")


def build_sidecar(spark: SparkSession, dataset: DataFrame, path: str, bits: int = 3, **options) -> VectorIndex:
    """Index and record snapshot of a data set, side by side under ``path``."""
    dim = dataset.select(F.size("embedding")).first()[0]
    index = VectorIndex(spark, IndexConfig(dim=dim, bits=bits, **options))
    index.add(dataset.select("chunk_id", "embedding", "metadata"))
    index.save(path)
    write_records(dataset.drop("embedding"), f"{path.rstrip('/')}/records")
    return index


def open_sidecar(spark: SparkSession, path: str, records: DataFrame | None = None, fetch=None, config: dict | None = None, client=None) -> tuple[VectorIndex, DataFrame | Source]:
    """(index, records): records given explicitly, else fetched, else configured, else the snapshot.

    Fetched and configured records are a source, which hydration asks for the ids of the hits and nothing else.
    """
    index = VectorIndex.open(spark, path)
    if records is not None:
        return index, records
    if fetch is not None:
        return index, Source(lambda ids: backends.fetch_records(ids, fetch))
    if config is None and os.path.exists(f"{path.rstrip('/')}/adapter.json"):
        with open(f"{path.rstrip('/')}/adapter.json") as f:
            config = json.load(f)
    if config is not None:
        return index, backends.from_config(spark, config, client)
    snapshot = f"{path.rstrip('/')}/records"
    if "://" not in snapshot and not os.path.exists(snapshot):
        raise FileNotFoundError(snapshot)
    return index, read_records(spark, snapshot)
