"""Chunking gives a batch back in parts."""

from pyspark.sql import functions as F

from quillvec.operators import chunking


def test_pieces_are_given_back_in_parts(spark):
    config = chunking.ChunkConfig(50, 5)
    texts = ["word. " * 200_000, None, " ", "# Head\nHead and more. Second part!", "other words, " * 150_000, ""]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_doc string, text string").coalesce(1)
    out = chunking.chunk_frame(docs, config=config)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.select("source_doc", "chunk_index", "chunk_id", "section", F.md5("text").alias("m")).collect()
    expected = [(f"d{i}", c["metadata"]["chunk_index"], c["chunk_id"], c["section"]) for i, t in enumerate(texts) for c in chunking.chunk_text(t, f"d{i}", config)]
    assert sorted((r["source_doc"], r["chunk_index"], r["chunk_id"], r["section"]) for r in rows) == sorted(expected)


def test_empty(spark):
    docs = spark.createDataFrame([], "source_doc string, text string")
    assert chunking.chunk_frame(docs).collect() == []
