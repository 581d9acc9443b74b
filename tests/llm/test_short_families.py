"""Equal texts are a family, however short their fingerprints."""

from quillvec.llm import fuzzy_fingerprints


def test_short_and_low_entropy_copies(spark):
    run, other = "ab" * 3000, "cd" * 3000
    texts = ["Die tz.", "Die tz.", "Die tz.", "Die tx.", "x", "y", "x", run, run, other, "", None]
    rows = fuzzy_fingerprints.families(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: (r["family"], r["family_size"]) for r in rows}
    assert len(rows) == len(texts)
    assert found == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (None, 1), 4: (4, 2), 6: (4, 2), 5: (None, 1), 7: (7, 2), 8: (7, 2), 9: (None, 1), 10: (None, 1), 11: (None, 1)}
