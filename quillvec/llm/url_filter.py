"""URL filter: logistic regression on hashed character n-grams of host and path.

The model is fitted here, in a fraction of a second and without randomness, on a small labelled table of URLs
(``labelled_urls``); query strings, fragments, the scheme and the port are left out. A URL's 3- and 4-grams, between a
start and an end mark, are hashed into ``BUCKETS`` weights. Weights are stored as whole numbers, so a score is an exact
sum and the same in every engine; scoring is one Catalyst expression, without Python.

Defined cases: a null URL has a null score and is kept, and so is an empty one, which has no host; characters outside
printable ASCII count as "?"; letter case is ignored. Repeated rows are scored alike; URLs of any length are read whole, in
time proportional to their length. An empty table gives an empty result. ``scored`` carries the columns of its input whatever
their names; where the input has a column ``logit``, ``unwanted`` or ``keep``, the new one gets underscores behind its name.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from quillvec.functions.exprs import made_once
from quillvec.llm.columns import plain, with_added

BUCKETS, SCALE, SIZES = 16384, 10_000, (3, 4)
REJECT_AT = 0.5

#: Host words, endings and paths of the labelled table, for unwanted and for ordinary pages.
_BAD = (
    "spam casino pills viagra cialis bets betting poker roulette xxx porn sex adult escort webcam-girls nude loans payday cash-advance debt-relief replica-watches fake-rolex cheap-meds "
    "steroids free-money win-big jackpot slots lottery ads adserver adclick tracker clickbait popunder doorway malware phishing warez crack keygen torrent nulled hot-deals coupon-dump "
    "weight-loss diet-pills get-rich bitcoin-doubler crypto-giveaway seo-links link-farm backlinks essay-writers hookup pharmacy-rx forex-signals make-money miracle-cure"
).split()
_TAILS = "farm win shop online track click best now 24 world hub zone deals vip pro king club".split()
_GOOD = (
    "library university news recipes garden museum history science school weather travel music city council research forum journal books health docs wiki archive kernel sports league photo "
    "paper studio market river mountain bridge theatre bank hospital clinic transport energy harbour valley poet drama family pets blog chess astronomy botany geology opera railway cycling "
    "maps parliament court census climate ocean forest physics chemistry linguistics pottery knitting bakery vineyard brewery orchard stadium marathon swimming ballet orchestra cinema gallery "
    "bookshop publisher gazette tribune herald observer chronicle academy institute college faculty laboratory observatory planetarium aquarium zoo farm-shop village county parish"
).split()
_GOOD_ENDS = "com org net edu gov io co.uk ac.uk de fr es it nl se ch ca info eu dev gov.au edu.au or.jp com.br".split()
_BAD_ENDS = "com net biz info top xyz click loan win bid site online club ru cc tk ws org".split()
_GOOD_PATHS = (
    "/ /about /index.html /articles/#/# /post/# /news/#/#/%-% /wiki/% /docs/%/%.html /en/# /de/#.html /fr/%-%/ /es/%/# /product/#-% /papers/#.pdf /2021/#/%-%-% /category/%/page/# /users/% /help/faq "
    "/blog/%-%-% /events/# /img/#.png /download/%.tar.gz /contact /search/% /team/% /courses/%/#/ /issues/# /~%/ /static/%.css /en/#/ /it/% /archive/#/#/"
).split()
_BAD_PATHS = (
    "/ /buy-% /cheap-%-online /free-%/click.php /win/# /bonus/100-free-spins /go.php /out/# /aff/#/ /track/click/# /best-%-no-prescription /signup-bonus /order-now/% /xxx/%-hot /landing/#/ /lp# "
    "/redirect/% /download-crack-% /claim/# /promo/#-off /adult/%/# /popup.html /banner/#.gif /offers/%-% /cgi-bin/clk#"
).split()
#: Paths that either class may have.
_ANY_PATHS = "/ /en/# /en/#/ /en/#.html /de/# /de/#.html /fr/# /fr/#/ /es/#.html /es/# /it/# /post/# /index.html /# /p/# /a/b/c /about /page/#".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: (url, 1 for unwanted). Hosts, endings and paths differ between the classes; some of each are shared."""
    rng, rows = np.random.default_rng(11), []
    pick = lambda xs: str(xs[int(rng.integers(len(xs)))])

    def name() -> str:
        """A made-up name, as most hosts have one: it says nothing."""
        return "".join(pick("bcdfghklmnprstvwz") + pick(["a", "e", "i", "o", "u", "ea", "ou", "y"]) + pick(["", "", "n", "r", "s", "th", "l", "nt"]) for _ in range(int(rng.integers(1, 5))))

    def filled(path: str, words) -> str:
        return "".join(str(int(rng.integers(1, 10_000))) if c == "#" else pick(words) if c == "%" else c for c in path)

    def url(host: str, ends, paths, words) -> str:
        front = pick(["", "", "www.", "www.", "m.", "blog.", "en.", f"{name()}."])
        return f"{pick(['https', 'https', 'http'])}://{front}{host}.{pick(ends)}{filled(pick(paths), words)}"

    for w in _BAD:
        for j in range(17):
            tail = pick(_TAILS)
            host = (f"{w}-{tail}", f"{w}{tail}", f"{tail}-{w}", f"best-{w}", w, f"free-{w}", f"cheap-{w}", f"{w}-{pick(_BAD)}", f"{w}-{name()}", f"{w}-{tail}.{name()}", f"{name()}{w}", name(), f"{w}-{tail}.{name()}", f"{tail}-{w}.{name()}", f"{w}.{name()}", f"{w}{tail}", f"{w}-{name()[:2]}.{name()}")[j]
            # the last host says nothing: the path alone gives the page away
            rows.append((url(host, _BAD_ENDS, _BAD_PATHS if j in (2, 6, 11) else _ANY_PATHS, _BAD), 1))
    for w in _GOOD:
        for j, host in enumerate((w, f"{w}-{pick(_GOOD)}", f"{w}{pick(_GOOD)}.{name()}", f"{name()}-{w}", f"{pick(_GOOD)}{w}", f"{w}{name()}")):
            rows.append((url(host, _GOOD_ENDS, _ANY_PATHS if j % 2 else _GOOD_PATHS, _GOOD), 0))
    for j in range(1500):
        rows.append((url(name() + pick(["", "", str(int(rng.integers(1, 99))), "-" + name(), "." + name()]), _GOOD_ENDS + _BAD_ENDS[:4], _ANY_PATHS if j % 2 else _GOOD_PATHS, [*_GOOD, name()]), 0))
    return rows


def host_path(url: str) -> str:
    m = re.match(r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^?#]*)", re.sub(r"[^ -~]", "?", url.lower()))
    return "^" + m.group(1) + "$"


def grams(url: str) -> list[int]:
    s = [ord(c) for c in host_path(url)]
    out = []
    for n in SIZES:
        for i in range(len(s) - n + 1):
            h = n
            for c in s[i : i + n]:
                h = (h * 131 + c) % 1_000_003
            out.append(h % BUCKETS)
    return out


@functools.cache
def model() -> tuple[list[int], int]:
    """(weights, intercept) as whole numbers of 1/SCALE: L2-penalised logistic regression by full gradient steps with momentum."""
    rows = labelled_urls()
    bags = [np.unique(grams(u), return_counts=True) for u, _ in rows]
    at, row = np.concatenate([g for g, _ in bags]), np.repeat(np.arange(len(rows)), [len(g) for g, _ in bags])
    count, y = np.concatenate([c for _, c in bags]).astype(float), np.array([r[1] for r in rows], float)
    w, b, v = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS)
    for _ in range(500):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[at] * count, len(rows)) + b)))
        v = 0.9 * v + np.bincount(at, (p - y)[row] * count, BUCKETS) / len(y) + 0.0005 * w
        w -= 0.2 * v
        b -= 0.2 * float((p - y).mean())
    return [int(v) for v in np.rint(w * SCALE)], round(b * SCALE)


def codes(url: Column) -> Column:
    """The character codes of host and path between their marks."""
    text = F.regexp_replace(F.lower(url), "[^ -~]", "?")
    text = F.concat(F.lit("^"), F.regexp_extract(text, r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^?#]*)", 1), F.lit("$"))
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def logit(url: Column, made: Column) -> Column:
    """The exact score as a whole number of 1/SCALE; ``made`` is the column of the URL's codes, which must not be an expression."""
    weights, intercept = model()
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")

    def total(n: int) -> Column:
        places = F.when(F.size(made) >= n, F.sequence(F.lit(0), F.size(made) - n)).otherwise(F.array().cast("array<int>"))

        def one(acc, i):
            h = F.lit(n).cast("long")
            for k in range(n):
                h = (h * 131 + F.get(made, i + k)) % 1_000_003
            return acc + F.get(table, (h % BUCKETS).cast("int"))

        return F.aggregate(places, F.lit(0).cast("long"), one)

    return F.when(url.isNotNull() & (url != ""), F.lit(intercept) + total(SIZES[0]) + total(SIZES[1]))


def scored(pages: DataFrame) -> DataFrame:
    """``pages`` with logit (whole number), unwanted (probability) and keep."""
    inner = plain(pages, ["url"])
    # the codes are generated, so that the lambdas that read them find a value, not an expression to repeat for each place
    made = inner.select("*", made_once(codes(F.col("url"))).alias("codes"))
    z = made.select(*inner.columns, logit(F.col("url"), F.col("codes")).alias("logit"))
    z = z.withColumn("unwanted", F.round(1 / (1 + F.exp(-F.col("logit") / F.lit(float(SCALE)))), 6))
    return with_added(z, inner, pages, logit=F.col("logit"), unwanted=F.col("unwanted"), keep=F.coalesce(F.col("unwanted") < REJECT_AT, F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def sql() -> str:
    weights, intercept = model()

    def total(n: int) -> str:
        h = str(n)
        for k in range(n):
            h = f"(({h}) * 131 + c[i + {k}]) % 1000003"
        return f"coalesce(list_sum(list_transform(range(1, len(c) - {n} + 2), lambda i: w[(({h}) % {BUCKETS}) + 1])), 0)"

    return f"""
WITH m AS (SELECT CAST(string_split('{",".join(map(str, weights))}', ',') AS BIGINT[]) AS w),
s AS (SELECT page_id, url, '^' || regexp_extract(regexp_replace(lower(url), '[^ -~]', '?', 'g'), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^?#]*)', 1) || '$' AS t FROM pages),
c AS (SELECT page_id, url, list_transform(string_split(t, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS c FROM s),
z AS (SELECT page_id, url, CASE WHEN url <> '' THEN CAST({intercept} + {total(SIZES[0])} + {total(SIZES[1])} AS BIGINT) END AS logit FROM c, m)
SELECT page_id, url, logit, round(1 / (1 + exp(-logit / CAST({SCALE} AS DOUBLE))), 6) AS unwanted,
       coalesce(round(1 / (1 + exp(-logit / CAST({SCALE} AS DOUBLE))), 6) < {REJECT_AT}, true) AS keep FROM z
"""
