"""Removing near duplicates shuffles the rows that may have to go, not all texts, and returns the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillvec.llm import near_dedup


def words(seed, n=40):
    return " ".join(f"w{random.Random(f'{seed} {k}').randrange(10**6)}" for k in range(n))


def shuffled(plan) -> int:
    """Rows written to shuffles by a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(shuffled(children.apply(i)) for i in range(children.size()))


@pytest.fixture
def joins_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_that_stay_are_not_shuffled(spark, joins_shuffle, tmp_path):
    """300 unlike texts, 10 near copies of the first, a row that stands there three times, texts without words."""
    rows = [(i, words(i), "x") for i in range(300)]
    rows += [(1000 + i, words(0) + f" more{i}", "y") for i in range(10)]
    rows += [(2000, words("again"), "z")] * 3 + [(3000, None, "n"), (None, words("no id"), "n"), (3001, " ?! ", "n")]
    spark.createDataFrame(rows, "doc_id long, text string, other string").write.parquet(str(tmp_path / "docs"))
    out = near_dedup.deduplicate(spark.read.parquet(str(tmp_path / "docs")))
    found = out.collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted([*range(300), 2000, 3000, None, 3001], key=str)
    assert {tuple(r) for r in found} <= set(rows)
    assert shuffled(out._jdf.queryExecution().executedPlan()) < 150 < len(rows)


@pytest.mark.parametrize("bits", [1 << 20, 1 << 15, 64])
def test_no_key_is_missed_however_small_the_bitmap(spark, monkeypatch, bits):
    monkeypatch.setattr(near_dedup, "LEAST_BITS", bits)
    monkeypatch.setattr(near_dedup, "MOST_BITS", bits)
    rows = spark.range(3000).select("id", F.when(F.col("id") > 0, F.unhex(F.md5(F.col("id").cast("string")))).alias("key")).repartition(3)
    keys = rows.where("id % 7 = 3").select(F.col("key").alias("found_key"))
    some, others = ({r["id"] for r in df.collect()} for df in near_dedup.told_apart(rows, keys, 429))
    assert some >= set(range(3, 3000, 7)) and not some & others and some | others == set(range(3000))
    if bits == 1 << 20:
        assert len(some) < 450
