"""The vector index: versions of a table of packed codes, sketches and metadata that only ever grows.

Layout: ``_CURRENT`` names the version; ``manifest-NNNNNN.json`` lists its parts; ``config.json`` and ``rotation.npy`` hold for all
versions; ``data/*/`` are Parquet tables (chunk_id, seq, shard, codes, sketch, metadata as JSON text) and ``gone/*/`` tables of
removed rows (chunk_id, before: rows of that id with a lesser ``seq`` are dead). Saving writes what was added and removed since,
then a manifest, and then replaces the pointer, so readers see either all of it or nothing, and a change costs what it
changes. After ``MOST_PARTS`` parts the live rows are written anew as one; ``vacuum`` deletes what no kept version names.
Files are reached through Hadoop's file system API, so that the location may be any that Spark can write to.
"""

from __future__ import annotations

import io
import json
import uuid
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.config import IndexConfig
from quillvec.errors import DuplicateIDError, IDNotFoundError, IndexConfigError
from quillvec.functions import codec
from quillvec.operators import filters, search
from quillvec.operators.ordering import numbered
from quillvec.session import cut_lineage

FAST_BEYOND, MOST_PARTS = 10_000, 64
GONE = "chunk_id string, before long"
COLUMNS = ["chunk_id", "seq", "shard", "codes", "sketch", "metadata"]
SCHEMA = "chunk_id string, seq long, shard int, codes binary, sketch binary, metadata variant"


class Files:
    """Small files beside the tables, through Hadoop's file system of the path."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark.sparkContext._jvm
        self.base = base.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def read(self, name: str) -> bytes | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def folders(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(f"{name}/{s.getPath().getName()}" for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def write(self, name: str, data: bytes) -> None:
        """Write beside and rename over."""
        temporary = self._path(f".{name.replace('/', '_')}.tmp")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(data))
        stream.close()
        target = self._path(name)
        self.fs.mkdirs(target.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri())
        options = self.jvm.org.apache.hadoop.fs.Options
        rename = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(options, "Rename").OVERWRITE
        context.rename(temporary, target, rename)


class VectorIndex:
    """An index handle. Changes are kept by the handle; ``save`` writes them as the next version."""

    def __init__(self, spark: SparkSession, config: IndexConfig, rows: DataFrame | None = None, matrix: np.ndarray | None = None):
        self.spark, self.config = spark, config
        self.matrix = codec.rotation(config.dim, config.seed, config.rotation_kind) if matrix is None else matrix
        self._stored = spark.createDataFrame([], SCHEMA) if rows is None else rows
        self._gone: DataFrame | None = None
        self._size: int | None = 0 if rows is None else None
        self._ends: tuple[int, int] | None = (0, 0) if rows is None else None
        # what isn't saved yet, and the place and manifest that the rest is saved at
        self._added: list[DataFrame] = []
        self._removed: list[DataFrame] = []
        self._home: tuple[str, int, dict] | None = None

    # -- state

    @property
    def rows(self) -> DataFrame:
        """The live rows."""
        if self._gone is None:
            return self._stored
        gone = self._gone.withColumnRenamed("chunk_id", "gone_id")
        return self._stored.join(gone, (F.col("chunk_id") == F.col("gone_id")) & (F.col("seq") < F.col("before")), "left_anti")

    def __len__(self) -> int:
        if self._size is None:
            self._size = self.rows.count()
        return self._size

    def __contains__(self, chunk_id: str) -> bool:
        return bool(self.rows.where(F.col("chunk_id") == str(chunk_id)).take(1))

    def __repr__(self) -> str:
        c = self.config
        return f"VectorIndex(dim={c.dim}, bits={c.bits}, size={len(self)})"

    def _next(self) -> tuple[int, int]:
        """The next sequence number and shard; numbers of removed rows are not used again."""
        if self._ends is None:
            last = self._stored.agg(F.max("seq"), F.max("shard")).first()
            self._ends = tuple(0 if x is None else x + 1 for x in last)
        return self._ends

    def _append(self, encoded: DataFrame) -> int:
        fresh = cut_lineage(self._numbered(encoded).select(COLUMNS))
        n, last, shard = fresh.agg(F.count("*"), F.max("seq"), F.max("shard")).first()
        if n:
            self._size = len(self) + n
            self._ends = last + 1, shard + 1
            self._stored = self._stored.select(COLUMNS).unionByName(fresh)
            self._added.append(fresh)
        return n

    def _remove(self, ids: DataFrame) -> int:
        """Mark the live rows of some ids as removed; how many there are."""
        found = self.rows.join(ids.select(F.col("chunk_id").cast("string").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
        gone = cut_lineage(found.select("chunk_id", F.lit(self._next()[0]).cast("long").alias("before")))
        n = gone.count()
        if n:
            self._size = len(self) - n
            self._gone = gone if self._gone is None else self._gone.unionByName(gone)
            self._removed.append(gone)
        return n

    # -- changes

    def _incoming(self, batch: DataFrame) -> DataFrame:
        """A batch (chunk_id, embedding[, metadata]) encoded, with metadata as VARIANT and later sequence numbers."""
        ids = F.col("chunk_id").cast("string").alias("chunk_id")
        meta = F.lit(None).cast("string")
        if "metadata" in batch.columns:
            kind = batch.schema["metadata"].dataType.typeName()
            meta = F.col("metadata") if kind == "string" else F.to_json("metadata")
        return search.encode(batch.select(ids, "embedding", meta.alias("metadata_json")), self.config, self.matrix)

    def _numbered(self, encoded: DataFrame) -> DataFrame:
        """Sequence numbers after those in use, and shards of ``shard_size``; every addition starts a new shard.

        Rows are numbered in order of chunk_id without gathering them: range-sorted partitions, each with its start.
        """
        start, shard = self._next()
        rows = numbered(encoded, ["chunk_id"], "n")
        return rows.select(
            "chunk_id",
            (F.lit(start) + F.col("n")).cast("long").alias("seq"),
            (F.lit(shard) + F.floor(F.col("n") / self.config.shard_size)).cast("int").alias("shard"),
            "codes",
            "sketch",
            F.parse_json("metadata_json").alias("metadata"),
        )

    def _check_ids(self, batch: DataFrame) -> None:
        ids = batch.select(F.col("chunk_id").cast("string").alias("chunk_id"))
        twice = ids.groupBy("chunk_id").count().where("count > 1 or chunk_id is null").agg(F.min("chunk_id"), F.count("*")).first()
        if twice[1]:
            raise ValueError(f"ids must be given and differ: {twice[0]}")

    def add(self, batch: DataFrame) -> int:
        """Append (chunk_id, embedding[, metadata]); the number of rows. Ids must be new."""
        self._check_ids(batch)
        ids = batch.select(F.col("chunk_id").cast("string").alias("chunk_id"))
        known = ids.join(self.rows.select("chunk_id"), "chunk_id", "left_semi").agg(F.min("chunk_id")).first()[0]
        if known is not None:
            raise DuplicateIDError(known)
        return self._append(self._incoming(batch))

    def add_new(self, batch: DataFrame) -> int:
        """Append those rows of a batch whose ids aren't there yet, one of each id; how streams are taken in."""
        one = batch.withColumn("chunk_id", F.col("chunk_id").cast("string")).where("chunk_id is not null").dropDuplicates(["chunk_id"])
        return self._append(self._incoming(one.join(self.rows.select("chunk_id"), "chunk_id", "left_anti")))

    def delete(self, ids: list[str] | DataFrame) -> int:
        """Remove rows by id; unknown ids are ignored; the number removed."""
        return self._remove(ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], "chunk_id string"))

    def update(self, batch: DataFrame) -> int:
        """Replace rows whose ids must all be there, in one step; metadata not given again is gone."""
        self._check_ids(batch)
        ids = batch.select(F.col("chunk_id").cast("string").alias("chunk_id"))
        missing = ids.join(self.rows.select("chunk_id"), "chunk_id", "left_anti").agg(F.min("chunk_id")).first()[0]
        if missing is not None:
            raise IDNotFoundError(missing)
        incoming = cut_lineage(self._incoming(batch))  # a batch that can't be encoded changes nothing
        self._remove(ids)
        return self._append(incoming)

    # -- search

    def prepare(self, queries) -> np.ndarray:
        q = np.asarray(queries, np.float32)
        if q.ndim not in (1, 2) or q.shape[-1] != self.config.dim:
            raise ValueError(f"a query must have {self.config.dim} dimensions")
        return codec.prepare(q, self.config, self.matrix)

    def search_batch(self, queries, k: int = 10, filters_: dict[str, Any] | None = None, query_ids: list[str] | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) of all queries in one job; always exact."""
        prepared = self.prepare(queries)
        ids = query_ids or [str(i) for i in range(len(prepared))]
        rows = self.rows if filters_ is None else self.rows.where(filters.predicate(filters_, F.col("metadata")))
        return search.search_codes(rows, self.config, prepared, ids, k)

    def search(self, query, k: int = 10, mode: str = "auto", filters_: dict[str, Any] | None = None, compat_row_order: bool = False) -> DataFrame:
        """(chunk_id, score, rank) of one query. Filters search exactly; ``auto`` is fast beyond 10,000 rows; other modes are exact."""
        prepared = self.prepare(query)
        if len(prepared) != 1:
            raise ValueError("one query at a time")
        if filters_ is None and k > 0 and (mode == "fast" or mode == "auto" and len(self) > FAST_BEYOND):
            hits = search.search_fast(self.rows, self.config, prepared, ["0"], k, len(self), compat_row_order)
        else:
            hits = self.search_batch(query, k, filters_, ["0"])
        return hits.select("chunk_id", "score", "rank").orderBy("rank")

    # -- storage

    def save(self, path: str) -> int:
        """Write what changed as the next version and point to it; the version's number."""
        files = Files(self.spark, path)
        current = files.read("_CURRENT")
        version = int(current) + 1 if current else 1
        same = self._home is not None and self._home[0] == files.base and self._home[1] == version - 1
        parts = dict(self._home[2]) if same else {"data": [], "gone": []}
        if same and len(parts["data"]) + len(parts["gone"]) < MOST_PARTS:
            fresh, removed = self._added, self._removed
        else:
            parts, fresh, removed = {"data": [], "gone": []}, [self.rows.select(COLUMNS)], []
        if fresh:
            parts["data"] = [*parts["data"], self._write(files, "data", fresh, F.to_json("metadata").alias("metadata"))]
        if removed:
            parts["gone"] = [*parts["gone"], self._write(files, "gone", removed)]
        manifest = {**parts, "size": len(self), "next": list(self._next())}
        if not same:
            buffer = io.BytesIO()
            np.save(buffer, self.matrix)
            files.write("rotation.npy", buffer.getvalue())
            files.write("config.json", self.config.to_json().encode())
        files.write(f"manifest-{version:06d}.json", json.dumps(manifest).encode())
        files.write("_CURRENT", str(version).encode())
        self._home, self._added, self._removed = (files.base, version, parts), [], []
        return version

    def _write(self, files: Files, kind: str, frames: list[DataFrame], *changed) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f)
        others = [c for c in whole.columns if not changed or c != "metadata"]
        whole.select(*others, *changed).write.parquet(f"{files.base}/{name}")
        return name

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
        files = Files(spark, path)
        if version is None:
            current = files.read("_CURRENT")
            if current is None:
                raise IndexConfigError(f"no index at {path}")
            version = int(current)
        config, matrix, manifest = (files.read(n) for n in ("config.json", "rotation.npy", f"manifest-{version:06d}.json"))
        if config is None or matrix is None or manifest is None:
            raise IndexConfigError(f"version {version} is incomplete")
        m = json.loads(manifest)
        stored = "chunk_id string, seq long, shard int, codes binary, sketch binary, metadata string"
        rows = spark.read.schema(stored).parquet(*(f"{files.base}/{p}" for p in m["data"])) if m["data"] else spark.createDataFrame([], stored)
        index = cls(spark, IndexConfig.from_json(config.decode()), rows.withColumn("metadata", F.parse_json("metadata")).select(COLUMNS), np.load(io.BytesIO(matrix)))
        if m["gone"]:
            index._gone = spark.read.schema(GONE).parquet(*(f"{files.base}/{p}" for p in m["gone"]))
        index._size, index._ends = m["size"], tuple(m["next"])
        index._home = files.base, version, {"data": m["data"], "gone": m["gone"]}
        return index

    load = open

    @staticmethod
    def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
        """Delete the parts that none of the last ``keep`` versions names, and older manifests; the number of parts deleted.

        Not while another handle saves: its parts have no manifest yet.
        """
        files = Files(spark, path)
        version = int(files.read("_CURRENT") or 0)
        used: set[str] = set()
        for v in range(version, 0, -1):
            name = f"manifest-{v:06d}.json"
            manifest = files.read(name)
            if manifest is None:
                break
            if v > version - keep:
                m = json.loads(manifest)
                used |= {*m["data"], *m["gone"]}
            else:
                files.delete(name)
        old = [p for kind in ("data", "gone") for p in files.folders(kind) if p not in used]
        for p in old:
            files.delete(p)
        return len(old)
