"""Quality classifier: a sparse rule ensemble over document statistics.

Boosted regression trees of depth 3 are grown on the statistics of labelled documents; every path from a root to an
inner node or leaf is a candidate rule, a conjunction of comparisons. An L1-penalised logistic regression over all rules
keeps few of them, and the surviving rules are compiled into one Spark column expression, so that scoring runs in the
JVM over all documents. Labels come from ``labels`` (quality 1 or 0); at most ``MAX_LABELLED`` labelled documents, those
with the least hashes of doc_id, are used to fit, which bounds what the driver receives.

Defined cases: statistics that don't exist (no words, no letters) count as -1, so that null and empty texts are scored
like other texts without words. Labels that are null, that contradict each other for one doc_id, or that belong to no
document are not used. With no labels, only one class, or too few rows for a split (20), no rule can be fitted: every
document gets the share of good labels (one half with no labels) as its score. Repeated rows are scored alike and count once
in the sample. ``scored`` keeps the columns of its input whatever their names; where one of them has the name of an added
column, the added one gets underscores behind its name. An empty table gives an empty result; texts of any length are measured
whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.columns import plain, with_added
from quillvec.llm.quality_rules import measured

MAX_LABELLED, TREES, DEPTH, SHRINK, L1, KEEP_AT = 4000, 40, 3, 0.3, 0.004, 0.5
FEATURES = ["n_words", "mean_word_chars", "symbol_share", "upper_share", "letter_share", "distinct_bigrams"]
Rule = tuple[tuple[int, bool, float], ...]


def features(docs: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` and the statistics, -1 where undefined."""
    return measured(docs, *kept).select(*kept, *(F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f) for f in FEATURES))


def _tree(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Grow one regression tree greedily; collect its paths, add its prediction to ``out``."""
    if path:
        rules.append(path)
    r = residual[rows]
    best = None
    if len(path) < DEPTH and len(rows) >= 20:
        base = r.sum() ** 2 / len(r)
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v, c = x[rows[order], f], np.cumsum(r[order])
            n = np.arange(1, len(rows))
            gain = c[:-1] ** 2 / n + (c[-1] - c[:-1]) ** 2 / (len(rows) - n) - base
            gain[(v[1:] <= v[:-1]) | (n < 5) | (len(rows) - n < 5)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), f, float(f"{(v[k] + v[k + 1]) / 2:.6g}"))
    if best is None:
        out[rows] += SHRINK * r.mean()
        return
    _, f, at = best
    low = x[rows, f] <= at
    if low.all() or not low.any():
        out[rows] += SHRINK * r.mean()
        return
    _tree(x, residual, rows[low], (*path, (f, True, at)), rules, out)
    _tree(x, residual, rows[~low], (*path, (f, False, at)), rules, out)


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, low, at in rule:
        hit &= (x[:, f] <= at) if low else (x[:, f] > at)
    return hit


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with their weights)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
    intercept = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return intercept, []
    score, rules = np.full(len(y), intercept), []
    sample = np.random.default_rng(3)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(sample.permutation(len(y))[: max(40, len(y) * 7 // 10)])
        step = np.zeros(len(y))
        found: list[Rule] = []
        _tree(x, 4 * (y - p), rows, (), found, step)
        # rows outside the sample take the value of their leaf as well
        for rule in found:
            hit = covers(rule, x)
            inner = np.intersect1d(np.flatnonzero(hit), rows)
            if len(inner) and np.ptp(step[inner]) == 0:
                step[hit] = step[inner[0]]
        score += step
        rules += found
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in rules))
    if not rules:
        return round(intercept, 6), []
    z = np.stack([covers(r, x) for r in rules], 1).astype(float)
    _, one_of_each = np.unique(z, axis=1, return_index=True)
    rules, z = [rules[i] for i in sorted(one_of_each)], z[:, sorted(one_of_each)]
    mean, spread = z.mean(0), z.std(0)
    use = spread > 0
    rules, z, mean, spread = [r for r, u in zip(rules, use) if u], z[:, use], mean[use], spread[use]
    s = (z - mean) / spread
    # FISTA on the penalised logistic loss
    step = 4 * len(y) / max(np.linalg.norm(s, 2) ** 2, 1e-9)
    w = v = np.zeros(s.shape[1])
    b, t = intercept, 1.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(s @ v + b)))
        g = v - step * (s.T @ (p - y)) / len(y)
        new = np.sign(g) * np.maximum(np.abs(g) - step * L1, 0)
        b -= float((p - y).mean())
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    kept = np.flatnonzero(w)
    return round(float(b - (w * mean / spread).sum()), 6), [(rules[i], round(float(w[i] / spread[i]), 6)) for i in kept]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The model as one column: the probability that a document is good."""
    z = F.lit(intercept)
    for rule, weight in rules:
        hit = F.lit(True)
        for f, low, at in rule:
            hit &= (F.col(FEATURES[f]) <= at) if low else (F.col(FEATURES[f]) > at)
        z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(1 / (1 + F.exp(-z)), 6)


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, classes) of a bounded sample of labelled documents, one row for each doc_id.

    Where a doc_id has several texts, the one with the least hash is taken, so that the sample never has more rows than ids.
    """
    clean = labels.select(F.col("doc_id").alias("label_id"), "quality").where("label_id is not null and quality in (0, 1)")
    clean = clean.groupBy("label_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    # ids that have a document: labels without one don't use up the sample
    there = clean.join(docs.select(F.col("doc_id").alias("label_id")), "label_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    # at most ``most`` rows of two numbers, whatever the size of the tables
    both = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["label_id"]).groupBy("label_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = features(both, "label_id", "quality").toPandas().sort_values("label_id", kind="stable")
    return rows[FEATURES].to_numpy(float), rows["quality"].to_numpy(float)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the statistics, score and keep."""
    inner = plain(docs, ["doc_id", "text"])
    intercept, rules = fit(*labelled(inner.select("doc_id", "text"), labels))
    out = features(inner, *inner.columns).withColumn("score", compiled(intercept, rules))
    return with_added(out, inner, docs, **{f: F.col(f) for f in FEATURES}, score=F.col("score"), keep=F.col("score") >= KEEP_AT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "score", "keep")
