"""Graph traversal: entities named in a query, breadth-first search from them, and the chunks found on the way."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillvec.functions.exprs import made_once
from quillvec.session import cut_lineage

#: Tokens of an entity that are joined on, and how many entities are broadcast.
KEY, MOST_BROADCAST = 3, 20_000


@F.pandas_udf(T.StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of a text, accents removed."""
    plain = F.when(text.rlike("[^\\x00-\\x7f]"), decomposed(F.when(text.rlike("[^\\x00-\\x7f]"), text))).otherwise(text)
    return F.array_remove(F.split(F.lower(plain), "[^a-z0-9]+"), "")


def padded(tokens_: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" "))


def _grams(words: str, n: int) -> Column:
    """The runs of n words, each once; ``words`` is a column of its own, as a lambda reads it."""
    if n == 1:
        return F.array_distinct(words)
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>")))


def detect(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, name): entities whose tokens stand one after another in the query (query_id, text).

    Joined on runs of words: an entity's first ``KEY`` tokens, or all if there are fewer. Only where an entity is longer is its
    whole name looked for, in the texts that have its first tokens; so a text is never copied for each of its words.
    """
    e = nodes.select("name", tokens(F.col("name")).alias("words")).where(F.size("words") > 0).distinct()
    e = cut_lineage(e.select("name", padded(F.col("words")).alias("needle"), F.array_join(F.slice("words", 1, KEY), " ").alias("gram"), F.least(F.size("words"), F.lit(KEY + 1)).alias("n")))
    sizes = {r["n"]: r["count"] for r in e.groupBy("n").count().collect()}
    if not sizes:
        return queries.select("query_id").join(e.select("name"), how="cross")
    small = sum(sizes.values()) <= MOST_BROADCAST
    held = F.broadcast(e) if small else e
    q = queries.select("query_id", made_once(tokens(F.col("text"))).alias("words"))
    grams = [_grams("words", n) for n in sorted({min(n, KEY) for n in sizes})]
    runs = q.select("query_id", F.explode(F.concat(*grams)).alias("gram"))
    found = runs.join(held, "gram")
    short = found.where(F.col("n") <= KEY).select("query_id", "name").distinct()
    if KEY + 1 not in sizes:
        return short
    maybe = found.where(F.col("n") > KEY).select("query_id", "name", "needle").distinct()
    lines = queries.select("query_id", padded(tokens(F.col("text"))).alias("line"))
    return short.unionByName(lines.join(maybe, "query_id").where(F.contains("line", "needle")).select("query_id", "name").distinct())


def bfs(starts: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, start, name, depth, path): each node within ``depth`` steps of a start (query_id, name), on its first path.

    One join a level; nodes reached before are dropped at once, so that no path is followed twice. Of several paths of the
    same length the least by its names is kept.
    """
    near = edges.where("src <> dst").select("src", "dst")
    near = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = starts.select("query_id", F.col("name").alias("start"), "name", F.lit(0).alias("depth"), F.array("name").alias("path")).distinct()
    seen = front
    for level in range(1, depth + 1):
        step = front.join(near, front["name"] == near["src"]).select("query_id", "start", F.col("dst").alias("name"), F.lit(level).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("query_id", "start", "name", "depth").agg(F.min("path").alias("path"))
        front = cut_lineage(step.join(seen.select("query_id", "start", "name"), ["query_id", "start", "name"], "left_anti").select(seen.columns))
        seen = seen.unionByName(front)
    return seen


def candidates(reached: DataFrame, nodes: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, path, rank): chunks of the reached nodes, 1 / (depth + 1), the best of several, top k."""
    chunks = reached.join(nodes.select("name", "chunk_ids"), "name").select("query_id", "depth", "path", F.explode("chunk_ids").alias("chunk_id"))
    chunks = chunks.join(records.select("chunk_id"), "chunk_id", "left_semi")
    scored = chunks.withColumn("score", 1.0 / (F.col("depth") + 1))
    best = scored.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min_by("path", F.struct("depth", "path")).alias("path"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
