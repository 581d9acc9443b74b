"""Quality rules whose thresholds follow the corpus.

Each document gets a few statistics, all Catalyst expressions. Thresholds come from mergeable quantile sketches per language
and source (the Greenwald-Khanna digest behind ``percentile_approx``, combined map side and merged across tasks). A first
sketch gives each group's medians. A statistic's deviation from its group's median is multiplied by the square root of the
number of words, since shares of short texts vary more by nature; a second sketch gives the quartiles of these deviations,
and the fences lie ``FENCE`` interquartile ranges beyond the quartiles. No threshold is a constant: ``LEAST_SPREAD`` stands in for
the range only where it is smaller, which is the case where more than three quarters of a group have the very same value.
Groups of fewer than ``LEAST_GROUP`` documents take the quantiles of their language, those of small languages the ones of all
documents. The fences are joined to the documents, and a document stays when it breaks no rule.

Defined cases: null and empty texts, and texts of blanks only, are rejected (they have no words) and don't count in the
sketches. A null language or source is a group of its own. A statistic that is undefined (no letters, one word) is null
and breaks no rule. Repeated rows and ties are judged alike, row by row; an empty table gives an empty result. ``keep``
returns the columns of its input whatever their names; texts of any length are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.columns import plain, restored
from quillvec.session import cut_lineage, written

WORD = r"[^ \t\n\r\f]+"
BLANKS = r"[ \t\n\r\f]+"
SYMBOL = r"[#$%&*|!~^=<>{}_+\\]"
ACCURACY, FENCE, LEAST_SPREAD, LEAST_GROUP = 10_000, 12.0, 0.02, 40
BROADCAST_GROUPS, SALTS = 20_000, 32
#: rule: (fence below, fence above)
RULES = {
    "mean_word_chars": (True, True),
    "symbol_share": (False, True),
    "upper_share": (False, True),
    "letter_share": (True, False),
    "distinct_bigrams": (True, False),
}


def measured(docs: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept``, n_words, and one column for each rule, null where undefined.

    Word pairs are counted by their 64-bit hashes. The arrays are columns of their own, so that each is made once.
    """
    text = F.col("text")
    base = docs.select(
        *(F.col(c).alias(f"kept_{c}") for c in kept),
        F.array_remove(F.split(text, BLANKS), "").alias("words"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("letters"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("uppers"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("symbols"),
    )
    carried = [f"kept_{c}" for c in kept]
    base = base.select(*carried, "letters", "uppers", "symbols", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n"), F.length(F.array_join("words", "")).cast("long").alias("solid"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    # the last word is paired with nothing, which is one kind more
    pairs = F.zip_with("hashes", F.slice("hashes", F.lit(2), F.size("hashes")), lambda a, b: F.xxhash64(a, b))
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double"))
    n = F.when(F.col("hashes").isNull(), F.lit(0)).otherwise(F.col("n")).cast("long")
    return base.select(
        *(F.col(f"kept_{c}").alias(c) for c in kept),
        n.alias("n_words"),
        ratio(F.col("solid"), n).alias("mean_word_chars"),
        ratio(F.col("symbols"), F.col("solid")).alias("symbol_share"),
        ratio(F.col("uppers"), F.col("letters")).alias("upper_share"),
        ratio(F.col("letters"), F.col("solid")).alias("letter_share"),
        ratio((F.size(F.array_distinct(pairs)) - 1).cast("long"), n - 1).alias("distinct_bigrams"),
    )


def quantiles(stats: DataFrame, of: dict[str, str], shares: list[float]) -> tuple[DataFrame, int]:
    """(lang_, source_ and, for each rule, an array of quantiles of its column), one row for each group of documents with words; the rows."""
    sketches = [F.percentile_approx(column, F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias(rule) for rule, column in of.items()]
    sets = stats.where("n_words > 0").select("lang", "source", *of.values())
    levels = cut_lineage(sets.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *sketches))
    fine = levels.where("level = 0").withColumn("all", F.lit(0))
    by_lang = levels.where("level = 1").select(F.col("lang").alias("lang1"), F.struct("n", *of).alias("q1"))
    overall = levels.where("level = 3").select(F.lit(0).alias("all2"), F.struct("n", *of).alias("q2"))
    joined = fine.join(by_lang, F.col("lang").eqNullSafe(F.col("lang1")), "left").join(F.broadcast(overall), F.col("all") == F.col("all2"))  # one row
    own = lambda r: F.when(F.col("n") >= LEAST_GROUP, F.col(r)).when(F.col("q1.n") >= LEAST_GROUP, F.col(f"q1.{r}")).otherwise(F.col(f"q2.{r}"))
    return joined.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), *(own(r).alias(r) for r in of)), fine.count()


def with_quantiles(stats: DataFrame, limits: DataFrame, groups: int, suffix: str) -> DataFrame:
    """``stats`` with the quantiles of each row's group, the rule's name and ``suffix`` as names.

    A few thousand groups are broadcast, once their number is known; more of them are joined by shuffling, each copied
    ``SALTS`` times, so that a hot source spreads over as many tasks.
    """
    limits = limits.withColumnsRenamed({r: r + suffix for r in RULES})
    match = stats["lang"].eqNullSafe(limits["lang_"]) & stats["source"].eqNullSafe(limits["source_"])
    if groups <= BROADCAST_GROUPS:
        return stats.join(F.broadcast(limits), match, "left").drop("lang_", "source_")
    salted = stats.withColumn("salt", F.pmod(F.xxhash64(*RULES, "n_words"), F.lit(SALTS)))
    copies = limits.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = salted["lang"].eqNullSafe(copies["lang_"]) & salted["source"].eqNullSafe(copies["source_"]) & (salted["salt"] == copies["salt_"])
    return salted.join(copies, match, "left").drop("lang_", "source_", "salt", "salt_")


def judged(stats: DataFrame) -> DataFrame:
    """``stats`` (what ``measured`` gives, lang and source among it) with ``broken``, the names of the rules that a row breaks."""
    columns = stats.columns
    middle = with_quantiles(stats, *quantiles(stats, {r: r for r in RULES}, [0.5]), "_m")
    deviations = {f"{r}_z": (F.col(r) - F.col(f"{r}_m")[0]) * F.sqrt(F.col("n_words").cast("double")) for r in RULES}
    deviating = middle.withColumns(deviations).drop(*(f"{r}_m" for r in RULES))
    fenced = with_quantiles(deviating, *quantiles(deviating, {r: f"{r}_z" for r in RULES}, [0.25, 0.75]), "_q")
    checks = [F.when(F.col("n_words") == 0, F.lit("no_words"))]
    for r, (below, above) in RULES.items():
        z, q = F.col(f"{r}_z"), F.col(f"{r}_q")
        gap = F.greatest(q[1] - q[0], F.lit(LEAST_SPREAD)) * F.lit(FENCE)
        bad = (z < q[0] - gap) if below else F.lit(False)
        bad = bad | (z > q[1] + gap) if above else bad
        checks.append(F.when(bad, F.lit(r)))
    return fenced.withColumn("broken", F.filter(F.array(*checks), lambda x: x.isNotNull())).select(*columns, "broken")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that break no rule.

    The texts are measured in one pass, which writes the documents with their statistics as a table in the shared folder; the
    sketches read its narrow columns only.
    """
    inner = plain(docs, ["lang", "source", "text"])
    stats = written(measured(inner, *inner.columns), "quality")
    return restored(judged(stats).where(F.size("broken") == 0), inner, docs)


def query(spark, sf_dir: str) -> DataFrame:
    """The documents that stay, with their statistics."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = cut_lineage(measured(docs, "doc_id", "lang", "source"))
    return judged(stats).where(F.size("broken") == 0).select("doc_id", "lang", "source", "n_words", *RULES)


def _sql() -> str:
    def levels(name: str, of: str, columns: list[tuple[str, str, float]]) -> str:
        """Quantiles by group, by language and of all, and those that hold for each group."""
        all_of = ", ".join(f"quantile_disc({c}, {p}) AS {n}" for n, c, p in columns)
        picks = ", ".join(f"CASE WHEN f.n >= {LEAST_GROUP} THEN f.{n} WHEN l.n >= {LEAST_GROUP} THEN l.{n} ELSE o.{n} END AS {n}" for n, _, _ in columns)
        return f"""{name}f AS (SELECT lang, source, count(*) AS n, {all_of} FROM {of} WHERE n_words > 0 GROUP BY lang, source),
{name}l AS (SELECT lang, count(*) AS n, {all_of} FROM {of} WHERE n_words > 0 GROUP BY lang),
{name}o AS (SELECT count(*) AS n, {all_of} FROM {of} WHERE n_words > 0),
{name} AS (SELECT f.lang, f.source, {picks} FROM {name}f f LEFT JOIN {name}l l ON f.lang IS NOT DISTINCT FROM l.lang CROSS JOIN {name}o o)"""

    tests = []
    for r, (below, above) in RULES.items():
        gap = f"greatest(q.{r}_b - q.{r}_a, {LEAST_SPREAD}::DOUBLE) * {FENCE}::DOUBLE"
        tests += [f"coalesce(z.{r}_z < q.{r}_a - {gap}, false)"] * below + [f"coalesce(z.{r}_z > q.{r}_b + {gap}, false)"] * above
    symbol = SYMBOL.replace("'", "''")
    same = "s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source"
    return rf"""
WITH b AS (
  SELECT doc_id, lang, source, regexp_extract_all(text, '{WORD}') AS words,
         length(regexp_replace(text, '[ \t\n\r\f]+', '', 'g')) AS solid, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters,
         length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS uppers, len(regexp_extract_all(text, '{symbol}')) AS symbols
  FROM documents),
c AS (SELECT *, coalesce(len(words), 0) AS n_words,
  CASE WHEN len(words) > 1 THEN len(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) END AS kinds FROM b),
s AS (
  SELECT doc_id, lang, source, CAST(n_words AS BIGINT) AS n_words,
    CASE WHEN n_words > 0 THEN solid::DOUBLE / n_words::DOUBLE END AS mean_word_chars, CASE WHEN solid > 0 THEN symbols::DOUBLE / solid::DOUBLE END AS symbol_share,
    CASE WHEN letters > 0 THEN uppers::DOUBLE / letters::DOUBLE END AS upper_share, CASE WHEN solid > 0 THEN letters::DOUBLE / solid::DOUBLE END AS letter_share,
    CASE WHEN n_words > 1 THEN kinds::DOUBLE / (n_words - 1)::DOUBLE END AS distinct_bigrams FROM c),
{levels("m", "s", [(f"{r}_m", r, 0.5) for r in RULES])},
z AS (SELECT s.*, {", ".join(f"(s.{r} - g.{r}_m) * sqrt(s.n_words::DOUBLE) AS {r}_z" for r in RULES)} FROM s LEFT JOIN m g ON {same}),
{levels("q", "z", [(f"{r}_{e}", f"{r}_z", p) for r in RULES for e, p in (("a", 0.25), ("b", 0.75))])}
SELECT z.doc_id, z.lang, z.source, z.n_words, {', '.join('z.' + r for r in RULES)}
FROM z LEFT JOIN q ON z.lang IS NOT DISTINCT FROM q.lang AND z.source IS NOT DISTINCT FROM q.source
WHERE z.n_words > 0 AND NOT ({' OR '.join(tests)})
"""


SQL = _sql()
