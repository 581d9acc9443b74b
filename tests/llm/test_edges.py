"""Defined results of the corner cases, for every operator and stage."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillvec.llm import fuzzy_fingerprints, language_id, mixing, near_dedup, pii_crf, quality_classifier, quality_rules, secret_scan, sentencepiece, url_filter


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_mixing(odd, none):
    out = mixing.mix(odd, budget_fraction=1.0)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert mixing.mix(odd.union(odd), budget_fraction=1.0).count() == 2 * odd.count()
    kept = {(r["queue"], r["doc_id"], r["copies"]) for r in mixing.schedule(odd, budget_fraction=1.0).collect()}
    assert ("s", 4, 2) in kept and ("", 9, 1) in kept
    assert mixing.mix(odd, weights={"s": 0.0}, budget_fraction=1.0).where("source = 's'").count() == 0
    assert mixing.mix(odd, budget_tokens=0).select(F.sum(mixing.n_tokens())).first()[0] in (0, None)
    assert mixing.mix(none).count() == 0


def test_near_dedup(odd, none):
    gone = [(r["doc_id"], r["duplicate_of"], r["group_size"]) for r in near_dedup.duplicates(odd).collect()]
    assert sorted(gone) == [(4, 4, 3), (5, 4, 3)]
    kept = near_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert ids(kept) == Counter([1, 2, 3, None, None, 4, 6, 7, 8, 9, 10])
    assert near_dedup.deduplicate(none).count() == 0 and near_dedup.duplicates(none).count() == 0


def test_sentencepiece(odd, none):
    out = sentencepiece.encode(odd, check="ok")
    rows = out.collect()
    # the input has a column token_ids of its own
    assert out.columns == [*odd.columns, "token_ids_", "ok"]
    assert {r["token_ids"] for r in rows} == {"t"}
    out = out.drop("token_ids", "text_").withColumnRenamed("token_ids_", "token_ids")
    rows = out.collect()
    assert all(r["token_ids"] is None and r["ok"] is None for r in rows if r["text"] is None)
    assert all(r["ok"] for r in rows if r["text"] is not None) and any(r["token_ids"] == [] for r in rows)
    back = sentencepiece.decode(out.select("doc_id", F.col("text").alias("was"), "token_ids"), text="text")
    assert back.where("not (was <=> text)").count() == 0
    assert sentencepiece.encode(none).count() == 0


def test_quality_rules(odd, none):
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns
    found = ids(kept)
    assert not {1, 2, 3} & set(found) and found[4] == 2 and found[9] == 1
    assert quality_rules.keep(none).count() == 0
    verdict = {r["doc_id"]: r["broken"] for r in quality_rules.judged(quality_rules.measured(odd, "doc_id", "lang", "source")).collect()}
    assert verdict[2] == ["no_words"]


def test_quality_rules_shuffled_fences(odd, monkeypatch):
    whole = ids(quality_rules.keep(odd))
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert ids(quality_rules.keep(odd)) == whole


def test_language_id(odd, none):
    rows = language_id.classify(odd).collect()
    assert len(rows) == odd.count()
    assert all((r["predicted"], r["cosine"]) == ("und", 0.0) for r in rows if r["doc_id"] in (1, 2, 3, 7))
    assert language_id.classify(none).count() == 0
    assert {r["predicted"] for r in language_id.classify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pii(odd, none):
    out = pii_crf.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("doc_id = 8").first()["text"].endswith("mail [EMAIL]")
    assert out.where("text is null").count() == 2
    rows = {r["doc_id"]: r for r in pii_crf.detect(odd).collect()}
    assert rows[8]["n_entities"] == 1 and rows[2]["entities"] == [] and rows[1]["text"] is None
    assert pii_crf.detect(none).count() == 0


def test_secrets(odd, none):
    out = secret_scan.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    r = out.where("doc_id = 8").first()
    assert r["text"] == 'password = "[SECRET]"\nmail bob@site.org' and r["n_chars"] == len(r["text"])
    assert [(x["doc_id"], x["name"]) for x in secret_scan.findings(odd).collect()] == [(8, "password")]
    assert secret_scan.findings(none).count() == 0 and secret_scan.redact(none).count() == 0


def test_fingerprints(odd, none):
    rows = fuzzy_fingerprints.families(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["fingerprint"] is None and r["family"] is None for r in rows if r["doc_id"] in (1, 2))
    same = [r for r in rows if r["doc_id"] in (4, 5)]
    assert {(r["family"], r["family_size"]) for r in same} == {(4, 3)}
    assert fuzzy_fingerprints.families(none).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "https://casino-win.example.com/en/1", "c"), (3, "https://casino-win.example.com/en/1", "c"), (4, "http://library.example.org/" + "é" * 30_000, "d"), (5, "x", "e")], "page_id long, url string, t string")
    rows = url_filter.scored(pages).collect()
    keep = Counter((r["page_id"], r["keep"]) for r in rows)
    assert keep == Counter({(1, True): 1, (2, True): 1, (3, False): 2, (4, True): 1, (5, True): 1})
    clash = url_filter.scored(pages.withColumns({"logit": F.lit("mine"), "keep": F.lit("mine"), "a.b": F.lit(1)}))
    assert clash.columns == ["page_id", "url", "t", "logit", "keep", "a.b", "logit_", "unwanted", "keep_"]
    assert {(r["logit"], r["keep"]) for r in clash.collect()} == {("mine", "mine")}
    assert all(r["logit"] is None for r in rows if r["page_id"] in (1, 2))
    assert url_filter.scored(pages.limit(0)).count() == 0


def test_quality_classifier(spark, odd, none):
    kind = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 1, 1), (5, 0, 0), (5, 1, 0), (None, 1, 0), (99, 0, None), (9, None, 0)], kind)
    out = quality_classifier.scored(odd, labels)
    assert out.count() == odd.count() and out.columns[: len(odd.columns)] == odd.columns and out.columns[-2:] == ["score_", "keep_"]
    unknown = quality_classifier.scored(odd, spark.createDataFrame([], kind)).select("score_").distinct().collect()
    assert [r["score_"] for r in unknown] == [0.5]
    assert quality_classifier.scored(none, labels).count() == 0


def test_stages(spark, odd, none, tmp_path, sf_small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "secret scan", "source mixture", "sentencepiece"]
    for start in (odd, none):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_small)
            path = str(tmp_path / f"{name}-{start is none}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert (docs.columns == start.columns) == (k < 4)
        assert (docs.count() > 0) == (start is odd)


def test_ids_of_text(odd):
    """doc_id may be a string; nothing is cast."""
    docs = odd.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    assert {r["doc_id"] for r in language_id.classify(docs).collect()} == {None, *(f"d-{i}" for i in range(1, 11))}
    assert sorted((r["doc_id"], r["duplicate_of"]) for r in near_dedup.duplicates(docs).collect()) == [("d-4", "d-4"), ("d-5", "d-4")]
    assert near_dedup.deduplicate(docs).count() == 11
    assert {r["doc_id"]: r["n_entities"] for r in pii_crf.detect(docs).collect()}["d-8"] == 1
    assert [r["doc_id"] for r in secret_scan.findings(docs).collect()] == ["d-8"]
    assert {r["family"] for r in fuzzy_fingerprints.families(docs).collect()} == {None, "d-4"}
    assert mixing.mix(docs, budget_fraction=1.0).count() == odd.count() and quality_rules.keep(docs).count() == quality_rules.keep(odd).count()


def test_names_that_differ_in_case(spark):
    """The column of the very name is read, another one that differs in case only is carried."""
    docs = spark.createDataFrame([(1, "wrong", "a text of a few words here", "en", "s")], "doc_id long, `Text` string, text string, lang string, source string")
    for out in (near_dedup.deduplicate(docs), pii_crf.redact(docs), secret_scan.redact(docs), mixing.mix(docs, budget_fraction=1.0)):
        assert out.columns == docs.columns and out.collect()[0][1] == "wrong"
    assert [r[2] for r in near_dedup.deduplicate(docs).collect()] == ["a text of a few words here"]


def test_language_sample_is_bounded_for_each_language(spark):
    """Null and repeated ids, and more languages than the bound: no language is left out."""
    words = {"de": "der schnelle braune fuchs springt über den faulen hund und", "en": "the quick brown fox jumps over the lazy dog and", "fr": "le renard brun rapide saute par dessus le chien paresseux et"}
    rows = [(None if k % 2 else 7, f"{text} {k} {text.split()[k % 8]}", lang) for lang, text in words.items() for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = Counter(lang for lang, _ in language_id.sample(docs, 60))
    assert sizes == {"de": 20, "en": 20, "fr": 20}
    assert all(r["predicted"] == r["lang"] for r in language_id.classify(docs).collect())
    many = spark.createDataFrame([(k, "ab " * (k + 1), f"l{k:03d}") for k in range(90)], "doc_id long, text string, lang string")
    assert len({lang for lang, _ in language_id.sample(many, 30)}) == 90


def test_many_texts_of_one_id(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(k, ("word " if k % 2 else "%% ") * (3 + j)) for k in range(60) for j in range(5)], "doc_id long, text string")
    x, y = quality_classifier.labelled(docs, labels, 40)
    assert len(x) == len(y) == 40


def test_many_documents_without_tokens(spark, monkeypatch):
    """Ties of virtual time beyond what one sort takes don't meet in one task."""
    monkeypatch.setattr(mixing, "CELL_ROWS", 1)
    docs = spark.createDataFrame([(k, "" if k < 300 else "some words", "s") for k in range(310)], "doc_id long, text string, source string")
    assert mixing.mix(docs, budget_tokens=10).where("text <> ''").count() == 5
    assert mixing.mix(docs, budget_tokens=20).count() == 310
