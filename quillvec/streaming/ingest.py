"""Continuous ingest into an index: each micro-batch is appended as a version of its own, once whatever is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.config import IndexConfig
from quillvec.operators.index import VectorIndex


def ingest_stream(stream: DataFrame, path: str, config: IndexConfig, checkpoint: str, **trigger):
    """Start a query that appends a stream of (chunk_id, embedding[, metadata]) to the index at ``path``.

    A micro-batch that was already appended brings no new ids, so a retry adds nothing.
    """
    spark = stream.sparkSession
    if not _exists(spark, path):
        VectorIndex(spark, config).save(path)

    def append(batch: DataFrame, _: int) -> None:
        index = VectorIndex.open(batch.sparkSession, path)
        if index.add_new(batch):
            index.save(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark: SparkSession, path: str) -> bool:
    from quillvec.operators.index import Files

    return Files(spark, path).read("_CURRENT") is not None


def stream_metrics(log: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Request metrics of a stream (ts, endpoint, ms) by time window; late requests are dropped after ``late``."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "endpoint").agg(F.count("*").alias("requests"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"))
