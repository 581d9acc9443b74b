"""Global row numbers without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.session import cut_lineage


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in the order of some columns (which together identify a row).

    Rows are range-sorted and written once; the sizes of the partitions, one small row each, give every partition its start.
    """
    parts = cut_lineage(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()
    starts, before = [], 0
    for r in sizes:
        starts.append((r["__part"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__within", within).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__within") + F.col("__start")).cast("long")).drop("__part", "__within", "__start")
