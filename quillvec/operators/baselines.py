"""Other searches to compare with: all vectors as floats, and float vectors by clusters (an inverted file)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.operators import search
from quillvec.session import cut_lineage


class Flat:
    """Exact search over (chunk_id, embedding)."""

    name = "flat"

    def __init__(self, vectors: DataFrame, dim: int):
        self.vectors, self.dim = vectors, dim

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search.search_floats_frame(self.vectors, queries, self.dim, k)


class Clustered:
    """Vectors by the nearest of ``clusters`` centroids; a query is scored against its ``probes`` nearest clusters.

    The centroids are fitted on a sample of at most ``SAMPLE`` vectors, those with the least hashes; all vectors are indexed. A
    cluster is scored in blocks, so that one that holds most of the vectors is not one task.
    """

    name = "clustered"
    SAMPLE = 20_000

    def __init__(self, vectors: DataFrame, dim: int, clusters: int = 64, probes: int = 8, rounds: int = 10, seed: int = 0):
        self.dim, self.probes = dim, probes
        some = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(self.SAMPLE).select("embedding").collect()
        x = self._unit(np.array([r[0] for r in some], np.float64).reshape(-1, dim))
        rng = np.random.default_rng(seed)
        self.centres = x[rng.permutation(len(x))[:clusters]] if len(x) else np.zeros((1, dim))
        for _ in range(rounds if len(x) else 0):
            own = (x @ self.centres.T).argmax(1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            self.centres = np.where(np.bincount(own, minlength=len(sums))[:, None] > 0, self._unit(sums), self.centres)
        rows = self._placed(vectors.select(F.col("chunk_id").cast("string").alias("id"), "embedding"), 1)
        blocks = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(8)))
        self.lists = cut_lineage(blocks.groupBy("cluster", "block").agg(F.collect_list(F.struct("id", "embedding")).alias("rows")))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _placed(self, rows: DataFrame, n: int) -> DataFrame:
        """(id, embedding, cluster) for the n nearest clusters of each row."""
        centres, unit = self.centres, self._unit
        n = min(n, len(centres))

        def run(batches):
            for batch in batches:
                if len(batch):
                    x = unit(np.array(batch.column("embedding").to_pylist(), np.float64))
                    near = np.argsort(-(x @ centres.T), 1, kind="stable")[:, :n]
                    at = pa.array(np.repeat(np.arange(len(x)), n))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("embedding").take(at), pa.array(near.ravel().astype(np.int32))], names=["id", "embedding", "cluster"])

        return rows.mapInArrow(run, f"id string, embedding {rows.schema['embedding'].dataType.simpleString()}, cluster int")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        asked = self._placed(queries.select(F.col("query_id").cast("string").alias("id"), "embedding"), self.probes)
        asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8))).groupBy("cluster", "part").agg(F.collect_list(F.struct("id", "embedding")).alias("asked"))
        unit = self._unit

        def score(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    x, q = (unit(np.array([v["embedding"] for v in r[c]], np.float64)) for c in ("rows", "asked"))
                    ids, names = (np.array([v["id"] for v in r[c]], object) for c in ("rows", "asked"))
                    yield search._picked(np.round(x @ q.T, search.DIGITS), ids, names, k)

        pairs = self.lists.join(asked, "cluster").select("rows", "asked")
        return search.top_k(pairs.mapInArrow(score, search.HITS), k)
