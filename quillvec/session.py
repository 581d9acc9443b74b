"""Session helpers shared by the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends, if it is still there then."""
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the cluster's ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillvec-checkpoint-")
        delete_on_exit(spark, named)
    sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder, so that a lost executor costs only its tasks."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: as ``cut_lineage``, but compressed, and read by columns."""
    if any(kind in ("void",) or "interval" in kind for _, kind in df.dtypes):
        return cut_lineage(df)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
