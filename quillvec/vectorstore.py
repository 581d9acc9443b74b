"""A vector-store façade with the method names that retrieval frameworks expect."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillvec.config import IndexConfig
from quillvec.errors import EmbeddingError
from quillvec.operators import hydrate
from quillvec.operators.hybrid import embedder
from quillvec.operators.index import VectorIndex

RECORD = "chunk_id string, text string, source_doc string, page_num int, section string, metadata string"


class Store:
    def __init__(self, index: VectorIndex, model: Any, records: DataFrame, managed: bool = True):
        self.index, self.model, self.records, self.managed = index, model, records, managed

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: list[str], model: Any, metadatas: list[dict] | None = None, ids: list[str] | None = None, bits: int = 3) -> Store:
        first = [float(x) for x in embedder(model, "adapter")(texts[0])]
        store = cls(VectorIndex(spark, IndexConfig(dim=len(first), bits=bits)), model, spark.createDataFrame([], RECORD))
        store.add_texts(texts, metadatas, ids)
        return store

    @classmethod
    def from_existing_records(cls, index: VectorIndex, records: DataFrame, model: Any = None) -> Store:
        return cls(index, model, records, managed=False)

    def _embed(self, text: str) -> list[float]:
        if self.model is None:
            raise EmbeddingError("the store has no embedder")
        return [float(x) for x in embedder(self.model, "adapter")(text)]

    def add_texts(self, texts: list[str], metadatas: list[dict] | None = None, ids: list[str] | None = None) -> list[str]:
        if not self.managed:
            raise ValueError("records of this store are kept elsewhere")
        start = len(self.index)
        ids = ids or [f"text-{start + i}" for i in range(len(texts))]
        metas = metadatas or [{}] * len(texts)
        spark = self.index.spark
        rows = [(i, t, m.get("source_doc"), m.get("page_num"), m.get("section"), json.dumps(m)) for i, t, m in zip(ids, texts, metas)]
        records = spark.createDataFrame(rows, RECORD)
        vectors = spark.createDataFrame([(i, self._embed(t), json.dumps(m)) for i, t, m in zip(ids, texts, metas)], "chunk_id string, embedding array<float>, metadata string")
        self.index.add(vectors)
        self.records = self.records.unionByName(records)
        return ids

    def similarity_search_by_vector(self, vector: list[float], k: int = 4, filters: dict | None = None) -> list[dict]:
        hits = self.index.search_batch(vector, k, filters)
        return [r.asDict() for r in hydrate.hydrate(hits, self.records, False).orderBy("rank").collect()]

    def similarity_search(self, query: str, k: int = 4, filters: dict | None = None) -> list[dict]:
        return self.similarity_search_by_vector(self._embed(query), k, filters)

    def similarity_search_with_score(self, query: str, k: int = 4, filters: dict | None = None) -> list[tuple[dict, float]]:
        return [(r, r["score"]) for r in self.similarity_search(query, k, filters)]

    def as_retriever(self, k: int = 4) -> Retriever:
        return Retriever(self, k)


class Retriever:
    def __init__(self, store: Store, k: int):
        self.store, self.k = store, k

    def invoke(self, query: str) -> list[dict]:
        return self.store.similarity_search(query, self.k)
