"""Entities in texts, against a plain scan, and texts that aren't copied for each of their words."""

import pytest
from pyspark.sql import functions as F

from quillvec.operators import traverse

TEXTS = ["alpha beta gamma delta epsilon", "beta", "", "  ", "Alpha, Beta! alpha beta gamma delta zeta", "gamma alpha", "alphabeta gamma", None, "x beta x beta gamma delta epsilon zeta y"]
NAMES = ["Alpha", "alpha beta", "alpha-beta gamma", "Alpha Beta Gamma Delta", "beta gamma delta epsilon zeta", "beta", "BETA", "zeta y", "", "--", "gamma delta epsilon", "alpha beta gamma omega"]


def plain(t):
    return " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())


@pytest.mark.parametrize("most", [20_000, 0], ids=["broadcast", "shuffled"])
def test_equals_a_scan(spark, monkeypatch, most):
    monkeypatch.setattr(traverse, "MOST_BROADCAST", most, raising=False)
    queries = spark.createDataFrame(list(enumerate(TEXTS)), "query_id long, text string")
    nodes = spark.createDataFrame([(n,) for n in NAMES + ["Alpha"]], "name string")
    got = sorted((r["query_id"], r["name"]) for r in traverse.detect(queries, nodes).collect())
    assert got == sorted({(i, n) for i, t in enumerate(TEXTS) if t for n in NAMES if plain(n) and f" {plain(n)} " in f" {plain(t)} "})


def test_no_entities(spark):
    queries = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    out = traverse.detect(queries, spark.createDataFrame([("--",)], "name string"))
    assert out.columns == ["query_id", "name"] and out.collect() == []


def test_a_long_text_of_many_words(spark):
    """40,000 different words: a copy of the text for each would be 10 GB."""
    queries = spark.range(1).select(F.col("id").alias("query_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text"))
    names = spark.createDataFrame([("w39998 w39999",), ("w1 w2 w3 w4",), ("w1 w3",)], "name string")
    seen = traverse.detect(queries, names)
    assert sorted(r["name"] for r in seen.collect()) == ["w1 w2 w3 w4", "w39998 w39999"]
    made = [x for x in seen._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(" in x]
    assert made and not any("line#" in x for x in made)
