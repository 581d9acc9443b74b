"""The service's operations without a web framework: checked requests in, plain dictionaries out."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.errors import QueryError, ServiceError
from quillvec.operators import chunking, hydrate
from quillvec.operators.hybrid import embedder
from quillvec.operators.index import VectorIndex

QUERY_KEYS = set("filters hydrate query_text query_vector top_k".split())
RECORD_KEYS = set("chunk_id embedding metadata page_num section source_doc text".split())
MAX_K, DEFAULT_K = 1000, 5


def _vector(x: Any) -> list[float]:
    if not isinstance(x, list) or not x or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in x):
        raise QueryError("query_vector must be a list of numbers")
    return [float(v) for v in x]


def _k(payload: dict) -> int:
    k = payload.get("top_k", DEFAULT_K)
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MAX_K:
        raise QueryError(f"top_k must be a whole number from 1 to {MAX_K}")
    return k


def validate_query(payload: Any) -> dict:
    if not isinstance(payload, dict):
        raise QueryError("the request must be an object")
    if unknown := sorted(set(payload) - QUERY_KEYS):
        raise QueryError(f"unknown keys: {', '.join(unknown)}")
    text, vector = payload.get("query_text"), payload.get("query_vector")
    if (text is None) == (vector is None):
        raise QueryError("give query_text or query_vector")
    if text is not None and (not isinstance(text, str) or not text.strip()):
        raise QueryError("query_text must be a text")
    if not isinstance(payload.get("hydrate", True), bool):
        raise QueryError("hydrate must be true or false")
    wanted = payload.get("filters")
    if wanted is not None and not isinstance(wanted, dict):
        raise QueryError("filters must be an object")
    return {"text": text, "vector": None if vector is None else _vector(vector), "k": _k(payload), "hydrate": payload.get("hydrate", True), "filters": wanted}


def validate_batch(payload: Any) -> dict:
    queries = payload.get("queries") if isinstance(payload, dict) else None
    if not isinstance(queries, list) or not queries:
        raise QueryError("queries must be a list with members")
    if unknown := sorted(set(payload) - {"queries", "top_k", "hydrate"}):
        raise QueryError(f"unknown keys: {', '.join(unknown)}")
    for q in queries:
        if not isinstance(q, dict) or set(q) != {"query_vector"}:
            raise QueryError("each query has query_vector and nothing else")
    return {"vectors": [_vector(q["query_vector"]) for q in queries], "k": _k(payload), "hydrate": payload.get("hydrate", True)}


def validate_ingest(payload: Any) -> list[dict]:
    records = payload.get("records") if isinstance(payload, dict) else None
    if not isinstance(records, list) or not records:
        raise QueryError("records must be a list with members")
    out = []
    for n, r in enumerate(records):
        if not isinstance(r, dict) or set(r) - RECORD_KEYS:
            raise QueryError(f"record {n} has unknown keys or is no object")
        if not all(isinstance(r.get(k), str) and r[k] for k in ("chunk_id", "text")):
            raise QueryError(f"record {n} needs chunk_id and text")
        for key, kind in (("source_doc", str), ("section", str), ("metadata", dict), ("page_num", int)):
            if r.get(key) is not None and (not isinstance(r[key], kind) or isinstance(r[key], bool)):
                raise QueryError(f"record {n}: {key} is of the wrong type")
        out.append({**{k: r.get(k) for k in RECORD_KEYS}, "embedding": _vector(r.get("embedding"))})
    return out


class Metrics:
    """Count, total, least and greatest duration by endpoint, and errors."""

    def __init__(self):
        self._lock, self._rows, self._began = threading.Lock(), {}, time.monotonic()

    def add(self, endpoint: str, ms: float, failed: bool = False) -> None:
        with self._lock:
            r = self._rows.setdefault(endpoint, {"count": 0, "errors": 0, "total_ms": 0.0, "min_ms": None, "max_ms": None})
            r["count"] += 1
            r["errors"] += failed
            r["total_ms"] += ms
            r["min_ms"] = ms if r["min_ms"] is None else min(ms, r["min_ms"])
            r["max_ms"] = ms if r["max_ms"] is None else max(ms, r["max_ms"])

    def snapshot(self) -> dict:
        with self._lock:
            rows = {k: {**r, "avg_ms": r["total_ms"] / r["count"] if r["count"] else None} for k, r in self._rows.items()}
        return {"uptime_s": time.monotonic() - self._began, "endpoints": rows}


class Service:
    """query, query_batch, ingest, ingest_text, describe, health and metrics over one index."""

    def __init__(self, index: VectorIndex, records: DataFrame | None = None, model: Any = None, external: DataFrame | hydrate.Source | None = None, path: str | None = None):
        if isinstance(records, hydrate.Source):
            records, external = None, records
        self.index, self.records, self.model, self.external, self.path = index, records, model, external, path
        self.metrics_, self._lock = Metrics(), threading.Lock()

    def _timed(self, endpoint: str, run: Callable[[], dict]) -> dict:
        began, failed = time.perf_counter(), True
        try:
            out = run()
            failed = False
            return out
        finally:
            self.metrics_.add(endpoint, (time.perf_counter() - began) * 1000, failed)

    def _hydrated(self, hits: DataFrame) -> DataFrame:
        if self.records is not None and self.external is not None:
            return hydrate.hydrate_fallback(hits, self.records, self.external)
        source = self.records if self.records is not None else self.external
        return hits if source is None else hydrate.hydrate_batch(hits, source)

    def query(self, payload: Any) -> dict:
        def run():
            q = validate_query(payload)
            vector = q["vector"]
            if vector is None:
                if self.model is None:
                    raise ServiceError("query_text needs an embedder")
                vector = embedder(self.model, "adapter")(q["text"])
            hits = self.index.search_batch(vector, q["k"], q["filters"]) if q["filters"] is not None else self.index.search(vector, q["k"])
            rows = self._hydrated(hits) if q["hydrate"] else hits
            found = [r.asDict() for r in rows.orderBy("rank").collect()]
            return {"results": found, "count": len(found)}

        return self._timed("query", run)

    def query_batch(self, payload: Any) -> dict:
        def run():
            q = validate_batch(payload)
            hits = self.index.search_batch(q["vectors"], q["k"])
            rows = self._hydrated(hits) if q["hydrate"] else hits
            out: list[list[dict]] = [[] for _ in q["vectors"]]
            for r in rows.orderBy("query_id", "rank").collect():
                out[int(r["query_id"])].append(r.asDict())
            return {"results": out}

        return self._timed("query/batch", run)

    def ingest(self, payload: Any) -> dict:
        def run():
            rows = validate_ingest(payload)
            kind = "chunk_id string, text string, embedding array<float>, source_doc string, page_num int, section string, metadata string"
            names = [f.split()[0] for f in kind.split(", ")]
            data = [tuple(json.dumps(r[n]) if n == "metadata" and r[n] is not None else r[n] for n in names) for r in rows]
            frame = self.index.spark.createDataFrame(data, kind)
            with self._lock:
                added = self.index.add(frame.select("chunk_id", "embedding", "metadata"))
                if self.records is not None:
                    fresh = frame.drop("embedding")
                    self.records = self.records.select(fresh.columns).unionByName(fresh)
                if self.path:
                    self.index.save(self.path)
            return {"added": added, "index_size": len(self.index)}

        return self._timed("ingest", run)

    def ingest_text(self, payload: Any) -> dict:
        def run():
            if self.model is None:
                raise ServiceError("ingest-text needs an embedder")
            if not isinstance(payload, dict) or not isinstance(payload.get("text"), str) or not payload["text"].strip():
                raise QueryError("text must be a text")
            if set(payload) - {"text", "source_doc", "chunk_size", "chunk_overlap"}:
                raise QueryError("unknown keys")
            config = chunking.ChunkConfig(payload.get("chunk_size", 512), payload.get("chunk_overlap", 64))
            pieces = chunking.chunk_text(payload["text"], payload.get("source_doc", ""), config)
            embed = embedder(self.model, "adapter")
            return self.ingest({"records": [{**p, "embedding": [float(x) for x in embed(p["text"])]} for p in pieces]})

        return self._timed("ingest-text", run)

    def describe(self) -> dict:
        local, other = self.records is not None, self.external is not None
        c = self.index.config
        return {"index_size": len(self.index), "dim": c.dim, "bits": c.bits, "shard_size": c.shard_size, "normalize": c.normalize, "value_range": c.value_range, "hydration_source": "hybrid" if local and other else "local_snapshot" if local else "external_backend" if other else "id_only", "record_count": self.records.count() if local else None}

    def health(self) -> dict:
        return {"status": "ok", "index_size": len(self.index)}

    def metrics(self) -> dict:
        return self.metrics_.snapshot()


def request_log(metrics: list[tuple[str, float, bool]], spark) -> DataFrame:
    return spark.createDataFrame(metrics, "endpoint string, ms double, failed boolean").withColumn("failed", F.coalesce("failed", F.lit(False)))
