"""Groups of similar items from buckets: exact search inside each bucket, then distributed connected components.

A bucket is never turned into its pairs. Inside one, a breadth-first walk compares each reached item with the items
not yet reached, so a bucket of n alike items costs n comparisons, and the groups are those that all pairs would give.

A bucket may hold a third of all items. Such hot buckets are found by counting a sample of the items (by hash of their ids,
one of ``SAMPLE``); the sample only decides how a bucket is worked on, never what comes out. A hot bucket is cut into blocks
that are walked each for itself; one item of each group that a block finds goes on to the next round, so that a bucket of
alike items shrinks by the size of a block each time. What is then left are links between items of different groups: the
bucket's blocks are compared with each other, each pair of blocks in some task. Where that would copy its items more often
than ``PAIR_COPIES``, the bucket is first split by keys of which any two alike items share at least one, if the operator has
such keys. Items of one group are never compared again, and blocks of one group's items are never paired. All this works on
the items of hot buckets only, which are gathered once. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.session import cut_lineage

Alike = Callable[[int, np.ndarray], np.ndarray]
#: One item of so many is counted; a bucket with so many of them is hot. Hot buckets, and items of them, that are broadcast at most.
SAMPLE, HOT_SEEN, BROADCAST_BUCKETS = 64, 16, 50_000
#: Items of a block, when groups are sought in it and when two of them are compared.
BLOCK, PAIR_BLOCK = 2048, 4096
#: Copies of a bucket's items, on average, up to which its blocks are paired as they are: keys cost more than so many.
PAIR_COPIES = 4


def walk(n: int, alike: Alike) -> Iterator[tuple[int, np.ndarray]]:
    """Spanning edges (item, reached items) of the similarity graph over n items."""
    left = np.arange(n)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            hit = alike(x, left)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                frontier.extend(found)
                yield x, found


def across(roots: np.ndarray, first: np.ndarray, alike: Alike) -> Iterator[tuple[int, int]]:
    """Edges that join groups: one for each two groups (``roots``) that an alike pair links, one item of each side.

    ``first`` tells the items of the first block from those of the second; with one block only, all are compared.
    """
    label = roots.copy()
    one = first.all()
    for x in np.flatnonzero(first):
        others = np.arange(x + 1, len(label)) if one else np.flatnonzero(~first)
        others = others[label[others] != label[x]]
        if not len(others):
            continue
        hit = others[alike(x, others)]
        while len(hit):
            y = hit[0]
            yield x, y
            label[label == label[y]] = label[x]
            hit = hit[label[hit] != label[x]]


def _batch(ids: list, left: list[int], right: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in left], pa.binary()), pa.array([ids[i] for i in right], pa.binary())], names=["a", "b"])


def _lists(batches):
    """(ids, payloads, all fields) of each list of members, one list at a time."""
    for batch in batches:
        column = batch.column(0)
        offsets, flat = column.offsets.to_numpy(), column.values
        for k in range(len(batch)):
            part = flat.slice(int(offsets[k]), int(offsets[k + 1] - offsets[k]))
            yield part.field("id").to_pylist(), part.field("payload"), part


def _walked(alike_of: Callable) -> Callable:
    def run(batches):
        for ids, payload, _ in _lists(batches):
            left, right = [], []
            for x, found in walk(len(ids), alike_of(payload)):
                left.extend([x] * len(found))
                right.extend(found)
            yield _batch(ids, left, right)

    return run


def _crossed(alike_of: Callable) -> Callable:
    def run(batches):
        for ids, payload, part in _lists(batches):
            names: dict[bytes, int] = {}
            roots = np.array([names.setdefault(r, len(names)) for r in part.field("root").to_pylist()])
            if len(names) < 2:
                continue
            side = np.array(part.field("block").to_pylist())
            pairs = list(across(roots, side == side[0], alike_of(payload)))
            yield _batch(ids, [x for x, _ in pairs], [y for _, y in pairs])

    return run


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by keys into as many parts as the session asks for: comparing costs more than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bucket_edges(items: DataFrame, members_of: Callable[[DataFrame], DataFrame], alike_of: Callable, parts_of: Callable[[Column], Column] | None = None, again: bool = False) -> DataFrame:
    """Edges (a, b) between similar items that share a bucket.

    items(id BINARY, payload, ...): what is compared. members_of(items): (bucket LONG, id), the buckets of each item.
    alike_of(payloads) gives alike(x, others). parts_of(payload): keys of which alike items share at least one.
    again: whether an item may stand there several times; those of hot buckets are then picked before repeats are dropped.
    """
    rows, items = items, items.dropDuplicates(["id"]) if again else items
    members = members_of(items)
    sampled = members_of(items.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(SAMPLE)) == 0))
    hot = cut_lineage(sampled.groupBy("bucket").count().where(F.col("count") >= HOT_SEEN).select("bucket"))
    n_hot = hot.count()
    if not n_hot:
        return ordinary_edges(members, items, alike_of)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot
    inside = members_of(rows).join(hot, "bucket", "left_semi")
    inside = cut_lineage(inside.distinct() if again else inside)
    found = hot_edges(inside, hot_items(rows.select("id", "payload"), inside, again), alike_of, parts_of)
    return ordinary_edges(members.join(hot, "bucket", "left_anti"), items, alike_of).unionByName(found)


def ordinary_edges(members: DataFrame, items: DataFrame, alike_of: Callable) -> DataFrame:
    """Edges of buckets of a few thousand items at most. Buckets with the same items are compared once."""
    lists = members.groupBy("bucket").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    lists = lists.select(F.sort_array("ids").alias("ids"))
    # the list itself is the key of a set of buckets; its digest keeps the later shuffles narrow
    lists = lists.select(F.unhex(F.md5(F.array_join(F.transform("ids", F.hex), ""))).alias("group"), "ids").dropDuplicates(["group"])
    pairs = _spread(lists.select("group", F.explode("ids").alias("id")).join(items.select("id", "payload"), "id"), "group")
    full = pairs.groupBy("group").agg(F.collect_list(F.struct("id", "payload")).alias("members"))
    return full.select("members").mapInArrow(_walked(alike_of), "a binary, b binary")


def hot_items(items: DataFrame, members: DataFrame, again: bool) -> DataFrame:
    """The items that have members, gathered once, so that no later step shuffles all items for the few."""
    ids = cut_lineage(members.select("id").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_BUCKETS else ids
    some = items.join(ids, "id", "left_semi")
    return cut_lineage(some.dropDuplicates(["id"]) if again else some)


def hot_edges(members: DataFrame, items: DataFrame, alike_of: Callable, parts_of: Callable[[Column], Column] | None) -> DataFrame:
    """Edges of buckets of any size, all of whose members (bucket, id) and items (id, payload) are given."""
    left, n, edges = members, members.count(), None
    while True:
        # blocks by hash, as many as the bucket's size asks for
        sizes = left.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        blocks = left.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id", F.lit(n)), F.col("blocks")))
        lists = _spread(blocks.join(items, "id"), "bucket", "block").groupBy("bucket", "block").agg(F.collect_list(F.struct("id", "payload")).alias("members"))
        found = cut_lineage(lists.select("members").mapInArrow(_walked(alike_of), "a binary, b binary"))
        edges = found if edges is None else cut_lineage(edges.unionByName(found))
        roots = cut_lineage(components(edges))
        of_group = lambda df: df.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        left = cut_lineage(of_group(left).groupBy("bucket", "root").agg(F.min("id").alias("id")).select("bucket", "id"))
        before, n = n, left.count()
        if n > before / 2:
            break
    # what remains: links between items of different groups that share a bucket
    open_ = cut_lineage(_of_several(of_group(members)))
    if parts_of is not None:
        dear = cut_lineage(_often_copied(_groups(open_)))
        if dear.count():
            keys = open_.join(dear, "bucket", "left_semi").join(items, "id").select("bucket", "id", "root", F.explode(parts_of(F.col("payload"))).alias("key"))
            split = _of_several(keys.select(F.xxhash64("bucket", "key").alias("bucket"), "id", "root"))
            open_ = cut_lineage(open_.join(dear, "bucket", "left_anti").unionByName(split))
    return edges.unionByName(paired_edges(open_, items, alike_of))


def _of_several(members: DataFrame) -> DataFrame:
    """The members (bucket, id, root) of buckets that hold more than one group."""
    several = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return members.join(several, "bucket", "left_semi")


def _groups(members: DataFrame) -> DataFrame:
    """(bucket, root, n, own): the groups in each bucket, and how many blocks of their own they fill."""
    group = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    return group.withColumn("own", F.when(F.col("n") > PAIR_BLOCK, F.ceil(F.col("n") / PAIR_BLOCK)).otherwise(0).cast("long"))


def _often_copied(group: DataFrame) -> DataFrame:
    """The buckets whose items ``paired_edges`` would copy more often than ``PAIR_COPIES``: to each block but those of their group."""
    shared = F.ceil(F.sum(F.when(F.col("own") == 0, F.col("n")).otherwise(0)) / PAIR_BLOCK)
    of = group.groupBy("bucket").agg(F.sum("n").alias("all"), (F.sum("own") + shared).alias("blocks"), F.sum(F.col("n") * F.col("own")).alias("spared"))
    return of.where(F.col("all") * F.col("blocks") - F.col("spared") > PAIR_COPIES * F.col("all")).select("bucket")


def paired_edges(members: DataFrame, items: DataFrame, alike_of: Callable) -> DataFrame:
    """Edges between items (bucket, id, root) of one bucket and of different groups, block against block.

    Groups larger than a block have blocks of their own, which meet all blocks but those of the same group; the members of
    smaller groups share blocks, which meet all blocks and themselves.
    """
    group = cut_lineage(_groups(members))
    large = group.where("own > 0").select("bucket", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "own"), lambda k: F.struct(F.col("root").alias("root"), k.alias("k")))).alias("b"))
    mixed = group.where("own = 0").groupBy("bucket").agg(F.ceil(F.sum("n") / PAIR_BLOCK).alias("mixed"))
    shared = mixed.select("bucket", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "mixed"), lambda k: F.struct(F.unhex(F.lit("")).alias("root"), k.alias("k")))).alias("b"))
    blocks = cut_lineage(large.unionByName(shared))
    placed = members.join(group.select("bucket", "root", "own"), ["bucket", "root"]).join(mixed, "bucket", "left")
    by_id, by_root = (F.pmod(F.xxhash64(c, F.lit(3)), F.greatest(n, F.lit(1))) + 1 for c, n in (("id", F.col("own")), ("root", F.col("mixed"))))
    mine = F.when(F.col("own") > 0, F.struct(F.col("root"), by_id.alias("k"))).otherwise(F.struct(F.unhex(F.lit("")).alias("root"), by_root.alias("k")))
    placed = placed.withColumn("mine", mine)
    # each item goes to every pair that its block is part of; a pair is named by its blocks in order
    met = placed.join(blocks, "bucket").where((F.col("mine.root") != F.col("b.root")) | (F.length("mine.root") == 0))
    pairs = met.select("bucket", F.least("mine", "b").alias("low"), F.greatest("mine", "b").alias("high"), "id", "root", F.xxhash64("mine.root", "mine.k").alias("block"))
    lists = _spread(pairs.join(items, "id"), "bucket", "low", "high").groupBy("bucket", "low", "high").agg(F.sort_array(F.collect_list(F.struct("block", "root", "id", "payload"))).alias("members"))
    return lists.select("members").mapInArrow(_crossed(alike_of), "a binary, b binary")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for each item in an edge: root is the least id of its connected component.

    Alternates large-star and small-star rounds, whose number grows with the logarithm of a component's size. The least
    neighbour is an aggregate, combined before it is shuffled, and joined back, so that the many edges of one item need
    not meet in one task (the join splits skewed keys). Each round is written to the shared checkpoint folder.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = cut_lineage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.where("u <> v").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not converge")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
