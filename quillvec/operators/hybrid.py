"""Hybrid ranking: dense hits and graph hits in one list."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.errors import EmbeddingError
from quillvec.operators import traverse
from quillvec.operators.index import VectorIndex

MODES = ("dense", "graph", "hybrid")
DENSE_NOTE = "Matched by dense similarity"
ORDERS = {"query": ("embed", "embed_query"), "adapter": ("embed_query", "embed", "encode"), "documents": ("embed_documents", "embed_texts", "encode")}


def embedder(model: Any, use: str = "query") -> Callable:
    """The function of a model that embeds, by the order in which its kinds of names are tried; else the model itself."""
    for name in ORDERS[use]:
        if callable(getattr(model, name, None)):
            return getattr(model, name)
    if callable(model):
        return model
    raise EmbeddingError("the embedder has no usable method")


def embed_column(model: Any, text: Column) -> Column:
    """A text column embedded in Arrow batches."""
    one = embedder(model, "adapter")

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else np.asarray(one(t), np.float32).ravel().tolist())

    return run(text)


class HashEmbedder:
    """A deterministic embedder for tests and for machines without a model: hashed words, normalised."""

    def __init__(self, dim: int = 64):
        self.dim = int(dim)

    def embed(self, text: str) -> np.ndarray:
        import hashlib

        v = np.zeros(self.dim, np.float32)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1.0 if (h >> 32) & 1 else -1.0
        return v / max(float(np.linalg.norm(v)), 1e-12)


class SentenceEmbedder:
    """A sentence-transformer model by name, loaded once in each worker; its library is optional."""

    def __init__(self, name: str, normalize: bool = True):
        self.name, self.normalize, self._model = name, normalize, None

    def __getstate__(self):
        return {"name": self.name, "normalize": self.normalize, "_model": None}

    def _loaded(self):
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError:
                raise EmbeddingError("the library sentence_transformers isn't installed") from None
            self._model = SentenceTransformer(self.name)
        return self._model

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self._loaded().encode(list(texts), normalize_embeddings=self.normalize), np.float32)

    def embed(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


def merge(dense: DataFrame, graph: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, path, explanation): scores of both added; what the graph says wins."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense"))
    g = graph.select("query_id", "chunk_id", F.col("score").alias("graph"), "path")
    both = d.join(g, ["query_id", "chunk_id"], "full_outer")
    return both.select("query_id", "chunk_id", (F.coalesce("dense", F.lit(0.0)) + F.coalesce("graph", F.lit(0.0))).alias("score"), "path", explain(F.lit(None).cast("string"), F.col("path")).alias("explanation"))


def explain(explanation: Column, path: Column) -> Column:
    return F.coalesce(explanation, F.concat(F.lit("Matched graph path: "), F.array_join(path, " -> ")), F.lit(DENSE_NOTE))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reranked(hits: DataFrame, records: DataFrame, queries: DataFrame, rerank: Callable) -> DataFrame:
    """New scores for all candidates of a query at once: rerank(text, [record rows]) -> scores."""
    full = hits.drop("rank").join(records.select("chunk_id", F.col("text").alias("record_text")), "chunk_id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    columns = [c for c in hits.columns if c != "rank"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scores = rerank(pdf["query_text"].iloc[0], [{"chunk_id": c, "text": t} for c, t in zip(pdf["chunk_id"], pdf["record_text"])])
        return pdf.assign(score=np.asarray(scores, float))[columns]

    return full.groupBy("query_id").applyInPandas(run, hits.select(columns).schema)


class HybridRetriever:
    """Queries over an index, its records and an entity graph (nodes, edges)."""

    def __init__(self, index: VectorIndex, records: DataFrame, nodes: DataFrame, edges: DataFrame, model: Any, graph_depth: int = 2, rerank: Callable | None = None):
        self.index, self.records, self.nodes, self.edges = index, records, nodes, edges
        self.model, self.depth, self.rerank = model, graph_depth, rerank

    def query(self, texts: list[str], k: int = 10, mode: str = MODES[2]) -> DataFrame:
        """(query_id, chunk_id, score, path, explanation, rank, text)."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        spark = self.records.sparkSession
        queries = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")
        none = spark.createDataFrame([], "query_id string, chunk_id string, score double, path array<string>")
        dense, graph = none, none
        if mode != "graph":
            vectors = np.stack([np.asarray(embedder(self.model)(t), np.float32).ravel() for t in texts])
            dense = self.index.search_batch(vectors, k, query_ids=[str(i) for i in range(len(texts))]).join(self.records.select("chunk_id"), "chunk_id", "left_semi")
        if mode != "dense":
            starts = traverse.detect(queries, self.nodes)
            graph = traverse.candidates(traverse.bfs(starts, self.edges, self.depth), self.nodes, self.records, k)
        hits = merge(dense, graph)
        if self.rerank is not None:
            hits = reranked(hits, self.records, queries, self.rerank)
        return ranked(hits, k).join(self.records.select("chunk_id", "text"), "chunk_id").orderBy("query_id", "rank")
