"""Retrieval quality and request metrics as aggregations."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WARM_UP = 5


class SearchBackend(Protocol):
    """What can be evaluated: a name, and hits (query_id, chunk_id, score, rank) of a table of queries (query_id, embedding)."""

    name: str

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


def evaluated(backends: list[SearchBackend], queries: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """(label, recall, mrr, qps) of each backend on the same queries, as ``comparison`` takes them."""
    out = []
    for b in backends:
        hits, seconds = timed(lambda b=b: b.search(queries, k))
        out.append(report(hits, cases, seconds).select(F.lit(b.name).alias("label"), "recall", "mrr", "qps"))
    return reduce(DataFrame.unionByName, out)


def per_query(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, recall, reciprocal_rank) for hits(query_id, chunk_id, rank) and cases(query_id, relevant_ids)."""
    relevant = cases.select("query_id", F.explode(F.array_distinct("relevant_ids")).alias("chunk_id"))
    found = hits.join(relevant, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n"), F.min("rank").alias("first"))
    out = cases.select("query_id", F.size(F.array_distinct("relevant_ids")).alias("wanted")).join(found, "query_id", "left")
    recall = F.when(F.col("wanted") > 0, F.coalesce("n", F.lit(0)) / F.col("wanted")).otherwise(F.lit(0.0))
    return out.select("query_id", recall.alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def report(hits: DataFrame, cases: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: queries, mean recall, mean reciprocal rank and, with a duration, queries a second."""
    qps = F.lit(None).cast("double") if seconds is None else F.try_divide(F.count("*").cast("double"), F.lit(float(seconds)))
    return per_query(hits, cases).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(qps, 6).alias("qps"))


def overlap(hits: DataFrame, reference: DataFrame) -> DataFrame:
    """(query_id, overlap): the share of the reference's hits that were found."""
    r = reference.select("query_id", "chunk_id").distinct()
    both = r.join(hits.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("overlap"))


def comparison(runs: DataFrame, base: str) -> DataFrame:
    """Rows (label, recall, mrr, qps) against the row named ``base``: differences, and the ratio of QPS (null without a base QPS)."""
    b = runs.where(F.col("label") == base).select(F.col("recall").alias("r0"), F.col("mrr").alias("m0"), F.col("qps").alias("q0")).limit(1)
    joined = runs.crossJoin(b)
    ratio = F.when(F.col("q0") > 0, F.round(F.col("qps") / F.col("q0"), 6))
    return joined.select("label", "recall", "mrr", "qps", F.round(F.col("recall") - F.col("r0"), 6).alias("recall_delta"), F.round(F.col("mrr") - F.col("m0"), 6).alias("mrr_delta"), ratio.alias("qps_ratio"))


def endpoint_metrics(log: DataFrame) -> DataFrame:
    """Request log (endpoint, ms, failed): count, errors, total, mean, least and most by endpoint."""
    return log.groupBy("endpoint").agg(F.count("*").alias("requests"), F.sum(F.col("failed").cast("int")).cast("long").alias("errors"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def timed(search: Callable[[], DataFrame], warm_up: int = WARM_UP) -> tuple[DataFrame, float]:
    """Hits of a batch search, collected once, and how long that took after some warm-up rounds."""
    from quillvec.session import cut_lineage

    for _ in range(min(warm_up, 1)):
        search().count()
    began = time.perf_counter()
    hits = cut_lineage(search())
    return hits, time.perf_counter() - began


def write_artifact(report_: DataFrame, path: str) -> None:
    """The report's rows as one JSON file; infinite numbers become null."""
    rows = [{k: None if isinstance(v, float) and v in (float("inf"), float("-inf")) else v for k, v in r.asDict().items()} for r in report_.collect()]
    with open(path, "w") as f:
        json.dump(rows, f, indent=1)
