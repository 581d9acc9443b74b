"""Texts of one line without blanks, and other awkward ones, take time in proportion to their length."""

import time

import pyarrow as pa
import pytest

from quillvec.llm import pii_crf, secret_scan, url_filter

SIZE, SECONDS = 300_000, 30


def repeated(piece):
    return piece * (SIZE // len(piece))


@pytest.mark.parametrize("piece", ["a-1=", "a=", "pwd=1", "token=your_", 'a=a+"y";', '="', '="""', "]=", "a:", '{"token":"abc123DEF456ghi789"},', '="\\', "&token=abc123def456ghi78", "=bearer x #", "key=1", 'x = "=+" + ', "a=(", "token='", "salt=a,", "((", "a = " + " " * 500])
def test_secrets(piece):
    began = time.perf_counter()
    secret_scan.scan(repeated(piece))
    assert time.perf_counter() - began < SECONDS


def test_chained_constants():
    text = 'a="hunter2-Xy9!"\n' + "".join(f'v{k}=a-{k}=x{k}; a=a+"y{k}Zq-{k}";' for k in range(SIZE // 40)) + "\npassword=a"
    began = time.perf_counter()
    found = secret_scan.scan(text)
    assert time.perf_counter() - began < SECONDS and text[found[0][0] : found[0][1]] == "hunter2-Xy9!" and len(found) > 1000


@pytest.mark.parametrize("piece", ["1", "1.", "(", "a@", "1:", "ab1:", "::1", "DE12 3456 ", "é bob@x.org ", "020 7946 0958 ", "1,111,", "1-", "://a1@", "4111 ", "a1b2"])
def test_personal_data(piece):
    model = pii_crf.model()
    began = time.perf_counter()
    pii_crf.entities(pa.array([repeated(piece)]), model)
    assert time.perf_counter() - began < SECONDS


def test_places_in_long_texts_of_other_letters(spark):
    text = "é bob@site.org " * 20_000
    began = time.perf_counter()
    found = pii_crf.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["entities"]
    assert time.perf_counter() - began < SECONDS + 20 and len(found) == 20_000
    assert all(text[e["start"] : e["end"]] == "bob@site.org" for e in found[::997])


def test_long_urls(spark):
    """One of 100,000 plain characters, none of which is cut off."""
    url = "http://casino-win.net/" + "free-slots/" * 9_000
    began = time.perf_counter()
    row = url_filter.scored(spark.createDataFrame([(url,)], "url string")).first()
    assert time.perf_counter() - began < SECONDS
    weights, intercept = url_filter.model()
    assert row["logit"] == intercept + sum(weights[g] for g in url_filter.grams(url))
