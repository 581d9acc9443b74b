"""Mixing sources to target weights by weighted fair queueing.

The documents of each source stand in a queue in a seeded random order. A document's virtual finish time is the number
of its source's tokens up to and with it, divided by the source's target weight. Sorting all documents by that time
interleaves the sources in proportion to their weights at every prefix; the sorted sequence is cut where the total
budget of tokens is spent. A source that runs dry leaves its share to the others.

No queue is ever ordered in one task: a queue is split by the leading digits of the shuffled key, whose totals give each
part its start; the cut is found by narrowing a histogram of virtual times to the one cell that holds it. Documents without
tokens, of which any number may have one virtual time, take no part in finding it.

Defined cases: tokens are runs of non-blank characters; a null or empty text has none, costs nothing, and is kept if its
time comes before the cut. A null source queues with the empty source name. Sources without a weight get the default; a
weight of zero or less leaves a source out. A null doc_id is a value like others, and doc_id may be of any type. Rows that
repeat (source, doc_id and text) are scheduled as one unit, stay or go together, and all come back. Ties of virtual time
are broken by source, then by key. An empty table gives an empty result; extra columns are carried by ``mix``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.llm.columns import plain, repeated, restored
from quillvec.session import cut_lineage

TOKEN = r"[^ \t\n\r\f]+"
SEED, PREFIX_DIGITS, BUDGET_FRACTION, DEFAULT_WEIGHT = 7, 3, 0.7, 1.0
WEIGHTS = {"src1": 2.0, "src2": 0.5, "src3": 3.0}
#: Cells of the histogram in which the cut is sought, and the rows of a cell that one sort may take.
CELLS, CELL_ROWS = 4096, 200_000
ORDER = ["virtual_finish", "queue", "key", "tie"]


def n_tokens(text="text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def keys(seed: int = SEED) -> dict[str, F.Column]:
    return {
        "queue": F.coalesce(F.col("source").cast("string"), F.lit("")),
        # of id and text, so that rows which share an id, or have none, are spread as well
        "key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))),
        "tie": F.xxhash64("text"),
    }


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, budget_fraction: float = BUDGET_FRACTION, budget_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """(queue, key, tie, doc_id, copies, n_tokens, source_tokens, virtual_finish) of what is kept, unsorted."""
    weights = WEIGHTS if weights is None else weights
    pairs = [F.lit(x) for item in weights.items() for x in (item[0], float(item[1]))]
    own = F.try_element_at(F.create_map(*pairs), F.col("queue")) if pairs else F.lit(None).cast("double")
    units = plain(docs, ["doc_id", "source", "text"]).select(*(c.alias(n) for n, c in keys(seed).items()), "doc_id", n_tokens().alias("n_tokens"))
    # copies are put together before they are shuffled
    units = units.withColumn("part", F.substring("key", 1, PREFIX_DIGITS)).groupBy("queue", "part", "key", "tie", "doc_id").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("n_tokens"))
    units = cut_lineage(units)
    totals = units.groupBy("queue", "part").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("queue", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("queue", "part").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0)
    timed = units.join(starts, ["queue", "part"]).withColumn("source_tokens", F.col("start") + F.sum("n_tokens").over(inside))
    timed = timed.withColumn("weight", F.coalesce(own, F.lit(float(default_weight)))).where("weight > 0")
    timed = timed.withColumn("virtual_finish", F.col("source_tokens").cast("double") / F.col("weight"))
    timed = cut_lineage(timed.select("queue", "key", "tie", "doc_id", "copies", "n_tokens", "source_tokens", "virtual_finish"))
    if budget_tokens is None:
        # The fraction is of all tokens of the table, including sources that the weights leave out.
        budget_tokens = int((totals.agg(F.sum("t")).first()[0] or 0) * budget_fraction)
    return truncate(timed, budget_tokens)


def truncate(timed: DataFrame, budget: int) -> DataFrame:
    """The leading rows, in the order of virtual time, whose tokens sum up to at most ``budget``."""
    costly = timed.where("n_tokens > 0")
    ends = costly.agg(F.min("virtual_finish"), F.max("virtual_finish")).first()
    if ends[0] is None:
        return timed
    low, high = ends
    spent = 0
    inside = F.lit(True)
    while high > low:
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col("virtual_finish") - F.lit(low)) / F.lit(width)), F.lit(CELLS - 1))
        cells = costly.where(inside).groupBy(cell.alias("cell")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.min("virtual_finish").alias("a"), F.max("virtual_finish").alias("b")).orderBy("cell").collect()
        for c in cells:
            if spent + c["t"] > budget:
                break
            spent += c["t"]
        else:
            return timed  # nothing is cut
        shrunk = (c["a"], c["b"]) != (low, high)
        low, high = c["a"], c["b"]
        inside = F.col("virtual_finish").between(F.lit(low), F.lit(high))
        if c["n"] <= CELL_ROWS or not shrunk:
            break
    # within a source no two of these rows share a virtual time, so that the cell holds few rows
    up_to = F.sum("n_tokens").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    over = costly.where(inside).withColumn("up_to", up_to).where(F.col("up_to") + F.lit(spent) > F.lit(budget))
    cut = over.agg(F.min(F.struct(*ORDER))).first()[0]
    return timed if cut is None else timed.where(F.struct(*ORDER) < F.struct(*(F.lit(cut[n]).alias(n) for n in ORDER)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` cut and sorted as scheduled, with their own columns."""
    inner = plain(docs, ["doc_id", "source", "text"])
    kept = schedule(inner, **options)
    tagged = inner.select("*", *(c.alias(n) for n, c in keys(options.get("seed", SEED)).items()))
    plan = kept.select(*(F.col(n).alias(f"kept_{n}") for n in (*ORDER, "doc_id")))
    match = (tagged["doc_id"].eqNullSafe(plan["kept_doc_id"])) & (tagged["queue"] == plan["kept_queue"]) & (tagged["key"] == plan["kept_key"]) & (tagged["tie"] == plan["kept_tie"])
    return restored(tagged.join(plan, match).orderBy(*(f"kept_{n}" for n in ORDER)), inner, docs)


def query(spark, sf_dir: str) -> DataFrame:
    """The kept rows, copies and all; those of one unit have its cumulative tokens and time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = repeated(schedule(docs).withColumn("n_tokens", (F.col("n_tokens") / F.col("copies")).cast("long")), "copies")
    return rows.orderBy(*ORDER).select("doc_id", F.col("queue").alias("source"), "n_tokens", "source_tokens", "virtual_finish")


SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS BIGINT) AS n_tokens
  FROM documents),
w AS (
  SELECT *, CASE source {' '.join(f"WHEN '{s}' THEN CAST({x} AS DOUBLE)" for s, x in WEIGHTS.items())} ELSE CAST({DEFAULT_WEIGHT} AS DOUBLE) END AS weight,
         CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY k RANGE UNBOUNDED PRECEDING) AS BIGINT) AS source_tokens
  FROM t),
v AS (SELECT *, CAST(source_tokens AS DOUBLE) / weight AS virtual_finish FROM w),
c AS (SELECT *, sum(n_tokens) OVER (ORDER BY virtual_finish, source, k RANGE UNBOUNDED PRECEDING) AS up_to FROM v)
SELECT doc_id, source, n_tokens, source_tokens, virtual_finish
FROM c WHERE up_to <= floor((SELECT sum(n_tokens) FROM t) * CAST({BUDGET_FRACTION} AS DOUBLE))
"""
