"""Physical plans of vector search over a table of packed codes.

All plans are one scan: queries are prepared on the driver and travel inside the Arrow function (their number times the
dimension; ``MAX_QUERY_BYTES`` bounds it, more queries are searched in turns). Each batch of rows is unpacked once, scored
against all queries by one matrix product, and reduced to its own best k, so that only tasks x queries x k rows are
shuffled; ``row_number`` picks the global best. Queries that are a table themselves are scored block against block, without
passing the driver: time grows with queries x rows, what is shuffled with their sum, and no worker holds more than some blocks. Scores are rounded to nine digits, so that equal vectors tie in any plan; the order is score descending,
then chunk_id ascending.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillvec.config import IndexConfig
from quillvec.functions import codec

MAX_QUERY_BYTES = 64 << 20
HITS = "query_id string, chunk_id string, score double"
SHORTLIST_FACTOR, SHORTLIST_SHARE, DIGITS, CELLS = 20, 10, 9, 1024
#: Of searches whose queries are a table: rows and queries in a block, queries and rows of a tile (which a core's cache holds), rows that
#: give a first limit, pairs scored exactly at once, partitions for each core.
ROWS, ASKED, STRIP, TILE, SEED, PAIRS, TASKS = 16384, 4096, 256, 1024, 2048, 1 << 16, 4


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores; among equals at the edge, the least ids."""
    n = len(scores)
    if n > k:
        edge = np.partition(scores, n - k)[n - k]
        sure = np.flatnonzero(scores > edge)
        equal = np.flatnonzero(scores == edge)
        if len(sure) + len(equal) > k:
            equal = equal[np.argsort(ids[equal], kind="stable")][: k - len(sure)]
        return np.concatenate((sure, equal))
    return np.arange(n)


def _picked(scores: np.ndarray, ids: np.ndarray, names: np.ndarray, k: int) -> pa.RecordBatch:
    """The best k rows of each query (a column of scores) as hits."""
    by_query = np.ascontiguousarray(scores.T)
    places = [_best(own, ids, k) for own in by_query]
    sizes, flat = [len(p) for p in places], np.concatenate(places)
    columns = [pa.array(np.repeat(names, sizes), pa.string()), pa.array(ids[flat], pa.string()), pa.array(by_query[np.repeat(np.arange(len(names)), sizes), flat])]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])


def _turns(prepared: np.ndarray):
    step = max(1, MAX_QUERY_BYTES // max(1, prepared.shape[1] * 8))
    return range(0, len(prepared), step), step


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], HITS)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_codes(vectors: DataFrame, config: IndexConfig, prepared: np.ndarray, query_ids: Sequence[str], k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact scores of all rows (chunk_id, codes), best k for each query."""
    if k <= 0 or not len(prepared):
        return top_k(_empty(vectors), 0)
    rows = vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), "codes")
    parts = []
    turns, step = _turns(prepared)
    for at in turns:
        weights, bias = codec.affine(prepared[at : at + step], config.bits, config.value_range)
        names = np.array(list(query_ids)[at : at + step], object)

        def scan(batches, weights=weights, bias=bias, names=names):
            for batch in batches:
                ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
                levels = codec.unpack(codec.bytes_of(batch.column("codes"), config.code_bytes), config.dim, config.bits) if len(batch) else None
                if levels is None:
                    continue
                scores = np.round(levels.astype(np.float64) @ weights + bias, DIGITS)
                yield _picked(scores, ids, names, k)

        parts.append(rows.mapInArrow(scan, HITS))
    return top_k(reduce(DataFrame.unionByName, parts), k)


def search_floats(vectors: DataFrame, queries: np.ndarray, query_ids: Sequence[str], k: int, normalize: bool = True) -> DataFrame:
    """The exact float baseline over (chunk_id, embedding)."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), codec.TINY) if normalize else x
    q = unit(np.atleast_2d(np.asarray(queries, np.float64)))
    dim, names = q.shape[1], np.array(list(query_ids), object)
    if k <= 0 or not len(q):
        return top_k(_empty(vectors), 0)
    rows = _rows(vectors, "embedding")
    parts = []
    turns, step = _turns(q)
    for at in turns:

        def scan(batches, some=q[at : at + step], own=names[at : at + step]):
            for batch in batches:
                if len(batch):
                    ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
                    yield _picked(np.round(unit(codec.matrix_of(batch.column("embedding"), dim, np.float64)) @ some.T, DIGITS), ids, own, k)

        parts.append(rows.mapInArrow(scan, HITS))
    return top_k(reduce(DataFrame.unionByName, parts), k)


def _sorted_blocks(rows: DataFrame, key: str, size: int, of, ids: str, data: str) -> DataFrame:
    """The rows (key, value...) spread evenly and cut into blocks of up to 2 x ``size``: the keys in order, and of(batch) as bytes."""

    def block(held, part):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        order = pc.sort_indices(batch.column(0))
        columns = [pa.array([part], pa.int32()), pa.array([batch.column(0).take(order)], pa.list_(pa.string())), pa.array([of(batch)[order.to_numpy()].tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[f"{ids}_part", ids, data])

    def run(batches):
        held, part = [], 0
        for batch in batches:
            for i in range(0, len(batch), size):
                held.append(batch.slice(i, size))
                if sum(map(len, held)) >= size:
                    yield block(held, part)
                    held, part = [], part + 1
        if held:
            yield block(held, part)

    spread = rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, key)
    return spread.mapInArrow(run, f"{ids}_part int, {ids} array<string>, {data} binary")


def _against(rows: DataFrame, asked: DataFrame, start, schema: str) -> DataFrame:
    """Each block of queries meets all blocks of rows in one task, one after another.

    start(query_ids, query_data) makes what is fed by add(ids, data) and asked for its result() at the end. The blocks of rows are shuffled
    once, into one partition that every task reads; a task holds one block of queries, and Arrow's batch of blocks of rows.
    """

    def run(batches):
        last, state = None, None
        for batch in batches:
            part, ids, data, names, asked_data = (batch.column(c) for c in ("query_ids_part", "ids", "data", "query_ids", "query_data"))
            for i in range(len(batch)):
                if part[i].as_py() != last:
                    if state is not None:
                        yield state.result()
                    last, state = part[i].as_py(), start(pa.array(names[i].as_py(), pa.string()), bytes(asked_data[i].as_buffer()))
                state.add(ids[i].values, data[i].as_buffer())
        if state is not None:
            yield state.result()

    return asked.hint("shuffle_replicate_nl").crossJoin(rows.repartition(1)).mapInArrow(run, schema)


class _Block(NamedTuple):
    """A block of rows as a block of queries sees it. A cost is less for a better row."""

    #: Rough costs of queries x rows (two slices), written to an array.
    tile: Callable[[slice, slice, np.ndarray], None]
    #: How far rough and exact costs of a query may be apart.
    slack: np.ndarray
    #: Exact costs of pairs (places of queries, places of rows), infinite for pairs that don't count.
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: Whether pairs of queries x rows count, where some don't.
    counts: Callable[[slice, slice], np.ndarray] | None = None


class _Best:
    """The k rows of least exact cost of each query of a block, ties by id, while blocks of rows (in order of id) come by.

    Rough costs of tiles tell which pairs may be among the best; the slack is a bound of their error, so that none is missed. Exact
    costs are found for these few alone. Between blocks a query holds its best k and what ties with them, cut to k by id where
    that is much.
    """

    def __init__(self, names: pa.Array, k: int, block, kind=np.float32, shown=lambda cost: 0.0 - cost):
        self.names, self.n, self.k, self.block, self.kind, self.shown = names, len(names), k, block, kind, shown
        self.limit = np.full(self.n, np.inf)
        self.ids, self.size, self.fresh = [], 0, 0
        self.q, self.row, self.cost = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _first(self, q: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by query and some values (the last one first), and each one's place in its query."""
        order = np.lexsort((*values, q))
        q = q[order]
        return order, np.arange(len(q)) - np.searchsorted(q, np.arange(self.n))[q]

    def add(self, ids: pa.Array, data) -> None:
        size, b = len(ids), self.block(data, len(ids))
        found = []
        for at in range(0, self.n, STRIP):
            qs = slice(at, min(at + STRIP, self.n))
            if np.isinf(self.limit[qs]).any():
                self._seed(b, qs, min(size, max(SEED, 4 * self.k)))
            q, row = self._near(b, qs, size)
            cost = np.concatenate([b.exact(q[i : i + PAIRS], row[i : i + PAIRS]) for i in range(0, len(q), PAIRS)] or [np.zeros(0)])
            good = np.flatnonzero((cost <= self.limit[q]) & (cost < np.inf))
            q, row, cost = q[good], row[good], cost[good]
            order, place = self._first(q, row, cost)  # rows are in order of id
            order = order[place < self.k]
            found.append((q[order], row[order] + self.size, cost[order]))
        self.ids.append(ids.take(pa.array(np.arange(size))))  # a copy: a slice would keep the whole batch
        self.size += size
        q, row, cost = (np.concatenate(x) for x in zip(*found))
        self.q, self.row, self.cost = np.concatenate((self.q, q)), np.concatenate((self.row, row)), np.concatenate((self.cost, cost))
        self.fresh += len(q)
        if self.fresh >= self.n * self.k // 4:
            self._trim()

    def _seed(self, b: _Block, qs: slice, size: int) -> None:
        """A first limit, from some rows."""
        if size < self.k:
            return
        some = np.empty((qs.stop - qs.start, size), self.kind)
        b.tile(qs, slice(0, size), some)
        if b.counts is not None:
            some[~b.counts(qs, slice(0, size))] = np.inf
        some = np.partition(some, self.k - 1, axis=1)[:, self.k - 1]
        self.limit[qs] = np.fmin(self.limit[qs], some + b.slack[qs])

    def _near(self, b: _Block, qs: slice, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) whose rough cost doesn't rule them out."""
        n, bound = qs.stop - qs.start, self.limit[qs] + b.slack[qs]
        if np.issubdtype(self.kind, np.floating):
            bound = np.nextafter(bound.astype(self.kind), self.kind(np.inf))
        else:
            bound = np.minimum(bound, np.iinfo(self.kind).max).astype(self.kind)
        costs, over = np.empty((n, TILE), self.kind), np.empty((n, TILE), bool)
        q, row = [], []
        for at in range(0, size, TILE):
            width = min(TILE, size - at)
            if width < TILE:
                costs, over = np.empty((n, width), self.kind), np.empty((n, width), bool)
            b.tile(qs, slice(at, at + width), costs)
            np.greater(costs, bound[:, None], out=over)
            flat = np.flatnonzero(np.logical_not(over, out=over))
            q.append(flat // width + qs.start)
            row.append(flat % width + at)
        return np.concatenate(q), np.concatenate(row)

    def _trim(self) -> None:
        order, place = self._first(self.q, self.cost)
        self.q, self.row, self.cost = self.q[order], self.row[order], self.cost[order]
        last, worst = np.flatnonzero(place == self.k - 1), np.full(self.n, np.inf)
        worst[self.q[last]] = self.cost[last]
        self.limit, self.fresh = np.fmin(self.limit, worst), 0
        good = self.cost <= worst[self.q]
        self.q, self.row, self.cost = self.q[good], self.row[good], self.cost[good]
        if len(self.q) > 4 * self.n * self.k:
            self._cut()

    def _cut(self) -> pa.Array:
        """Exactly the best k, ties by id; their ids."""
        all_ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.string())
        ids = all_ids.take(pa.array(self.row))
        t = pa.table({"q": self.q, "cost": self.cost, "id": ids})
        order = pc.sort_indices(t, [("q", "ascending"), ("cost", "ascending"), ("id", "ascending")]).to_numpy()
        q = self.q[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, np.arange(self.n))[q] < self.k]
        self.q, self.row, self.cost = self.q[order], self.row[order], self.cost[order]
        return ids.take(pa.array(order))

    def result(self) -> pa.RecordBatch:
        self._trim()
        ids = self._cut()
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.q)), ids, pa.array(self.shown(self.cost))], names=["query_id", "chunk_id", "score"])


def _dots(queries: np.ndarray, rows: np.ndarray):
    """(tile, slack) of the costs -queries . rows: single precision, and a bound of what that can be wrong by."""
    rough = np.ascontiguousarray(-queries, np.float32)
    own = np.ascontiguousarray(rows, np.float32)
    size = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1))
    most = float(size(own).max(initial=0.0))
    slack = (queries.shape[1] + 8) * 2.0**-23 * size(queries) * most + 10.0**-DIGITS

    def tile(qs, rs, out):
        np.matmul(rough[qs], own[rs].T, out=out)

    return tile, slack


def _pair_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.astype(np.float64, copy=False), b.astype(np.float64, copy=False))


def _words(data, n: int, width: int) -> np.ndarray:
    """Rows of sketches as words of 64 bits."""
    out = np.zeros((n, -(-width // 8) * 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.view(np.uint64)


def _distance_kind(width: int):
    return np.uint8 if width * 8 <= 255 else np.uint16


def _differing(asked: np.ndarray, own: np.ndarray):
    """(tile, pairs) of the Hamming distances of sketches in words."""
    some = functools.lru_cache(2)(lambda shape: (np.empty(shape, np.uint64), np.empty(shape, np.uint8)))  # fresh memory would cost more than counting

    def tile(qs, rs, out):
        words, bits = some(out.shape)
        for w in range(asked.shape[1]):
            np.bitwise_count(np.bitwise_xor(asked[qs, None, w], own[rs, w], out=words), out=bits if w or out.dtype != np.uint8 else out)
            if out.dtype != np.uint8 and not w:
                out[:] = bits
            elif w:
                out += bits

    return tile, lambda q, r: np.bitwise_count(asked[q] ^ own[r]).sum(1, dtype=np.float64)


def _code_block(prepared: np.ndarray, config: IndexConfig):
    """Makes the blocks of levels (one byte each) that prepared queries are scored against."""
    weights, bias = codec.affine(prepared, config.bits, config.value_range)
    weights, top = np.ascontiguousarray(weights.T), 2**config.bits - 1
    values = np.arange(top + 1) / top * 2 * config.value_range - config.value_range

    def block(levels: np.ndarray) -> _Block:
        tile, slack = _dots(prepared, values[levels])
        return _Block(tile, slack, lambda q, r: -np.round(_pair_dots(levels[r], weights[q]) + bias[q], DIGITS))

    return block


def _rows(vectors: DataFrame, *columns: str) -> DataFrame:
    return vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), *columns)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")


def _levels(config: IndexConfig):
    return lambda b: codec.unpack(codec.bytes_of(b.column(1), config.code_bytes), config.dim, config.bits)


def _sizes(row_bytes: int, query_bytes: int) -> tuple[int, int]:
    """Rows in a block of rows and in one of queries: some MB each."""
    return max(256, min(ROWS, (4 << 20) // row_bytes)), max(64, min(ASKED, (2 << 20) // query_bytes))


def search_frame(vectors: DataFrame, queries: DataFrame, config: IndexConfig, matrix: np.ndarray, k: int) -> DataFrame:
    """``search_codes`` for queries that are a table (query_id, embedding) of any size.

    Both sides are cut into blocks. Every block of queries meets all blocks of rows in one task, which keeps the best k so far, so that
    only queries x k rows are shuffled.
    """
    if k <= 0:
        return top_k(_empty(vectors), 0)
    dim, (row_size, query_size) = config.dim, _sizes(config.dim, config.dim * 8)

    def start(names, query_data):
        block = _code_block(np.frombuffer(query_data).reshape(len(names), dim), config)
        return _Best(names, k, lambda data, n: block(np.frombuffer(data, np.uint8).reshape(n, dim)))

    rows = _sorted_blocks(_rows(vectors, "codes"), "chunk_id", row_size, _levels(config), "ids", "data")
    asked = _sorted_blocks(_asked(queries), "query_id", query_size, lambda b: codec.prepare(codec.matrix_of(b.column(1), dim), config, matrix), "query_ids", "query_data")
    return top_k(_against(rows, asked, start, HITS), k)


def search_floats_frame(vectors: DataFrame, queries: DataFrame, dim: int, k: int, normalize: bool = True) -> DataFrame:
    """``search_floats`` for queries that are a table (query_id, embedding) of any size, as ``search_frame``."""
    if k <= 0:
        return top_k(_empty(vectors), 0)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), codec.TINY) if normalize else x
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    row_size, query_size = _sizes(dim * np.dtype(kind).itemsize, dim * 8)

    def start(names, query_data):
        asked = np.frombuffer(query_data).reshape(len(names), dim)

        def block(data, n):
            own = unit(np.frombuffer(data, kind).reshape(n, dim).astype(np.float64))
            tile, slack = _dots(asked, own)
            return _Block(tile, slack, lambda q, r: -np.round(_pair_dots(own[r], asked[q]), DIGITS))

        return _Best(names, k, block)

    rows = _sorted_blocks(_rows(vectors, "embedding"), "chunk_id", row_size, lambda b: codec.matrix_of(b.column(1), dim, kind), "ids", "data")
    asked = _sorted_blocks(_asked(queries), "query_id", query_size, lambda b: unit(codec.matrix_of(b.column(1), dim, np.float64)), "query_ids", "query_data")
    return top_k(_against(rows, asked, start, HITS), k)


def shortlist_size(k: int, size: int) -> int:
    return max(SHORTLIST_FACTOR * k, size // SHORTLIST_SHARE)


def _distances(own: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Hamming distances [rows, queries]."""
    return np.stack([codec.hamming(own, q) for q in asked], 1)


def _cut(counts: np.ndarray, wanted: int) -> int:
    """The first place by which ``wanted`` are counted, the last one if there are fewer."""
    return min(int(np.searchsorted(np.cumsum(counts), wanted)), len(counts) - 1)


def search_fast(vectors: DataFrame, config: IndexConfig, prepared: np.ndarray, query_ids: Sequence[str], k: int, size: int, compat_row_order: bool = False) -> DataFrame:
    """Two stages: a shortlist by Hamming distance of the sketches (chunk_id, seq, sketch), then exact scores of it.

    The shortlist holds all rows as near as the ``shortlist_size``-th nearest. It is never gathered: a first scan counts the
    rows at each distance (dim + 1 numbers a query), which gives the distance that bounds the shortlist, and a second scan
    scores exactly what lies within it. With ``compat_row_order`` the shortlist holds the first ``shortlist_size`` rows in
    order of ``seq`` among all within the distance of the next one after the shortlist; their last ``seq`` is found by
    counting in the same way, in cells that narrow.
    """
    if k <= 0 or not len(prepared):
        return top_k(_empty(vectors), 0)
    keep = shortlist_size(k, size)
    q_sketch = codec.sketch(prepared)
    names = np.array(list(query_ids), object)
    n, width, places = len(names), q_sketch.shape[1], config.dim + 1

    def counted(cells: int, cell_of) -> np.ndarray:
        """Rows by query and cell; cell_of(distances, seq) numbers the cells, ``cells`` stands for none."""

        def run(batches):
            total = np.zeros((n, cells + 1), np.int64)
            for batch in batches:
                if len(batch):
                    at = cell_of(_distances(codec.bytes_of(batch.column("sketch"), width), q_sketch), batch.column("seq").to_numpy())
                    for q in range(n):
                        total[q] += np.bincount(at[:, q], minlength=cells + 1)
            q, c = np.nonzero(total[:, :cells])
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[q, c])], names=["q", "c", "n"])

        rows = vectors.select(F.col("seq").cast("long").alias("seq"), "sketch").mapInArrow(run, "q int, c int, n long").groupBy("q", "c").agg(F.sum("n").alias("n")).collect()
        out = np.zeros((n, cells), np.int64)
        for r in rows:
            out[r["q"], r["c"]] = r["n"]
        return out

    by_distance = counted(places, lambda d, _: d)
    edge = np.array([_cut(c, keep + compat_row_order) for c in by_distance])
    last = np.full(n, np.iinfo(np.int64).max)
    if compat_row_order:
        ends = vectors.agg(F.min("seq"), F.max("seq")).first()
        low, high, before = np.full(n, ends[0] or 0), np.full(n, ends[1] or 0), np.zeros(n, np.int64)
        while (high > low).any():
            step = np.maximum(1, -(-(high - low + 1) // CELLS))

            def cell(d, seq, low=low, high=high, step=step):
                at = (seq[:, None] - low) // step
                return np.where((d <= edge) & (seq[:, None] >= low) & (seq[:, None] <= high), at, CELLS)

            for q, c in enumerate(counted(CELLS, cell)):
                place = _cut(c, keep - before[q])
                before[q] += c[:place].sum()
                low[q], high[q] = low[q] + place * step[q], min(high[q], low[q] + (place + 1) * step[q] - 1)
        last = high
    weights, bias = codec.affine(prepared, config.bits, config.value_range)

    def rescored(batches):
        for batch in batches:
            if not len(batch):
                continue
            inside = _distances(codec.bytes_of(batch.column("sketch"), width), q_sketch) <= edge
            inside &= batch.column("seq").to_numpy()[:, None] <= last
            some = np.flatnonzero(inside.any(1))
            if len(some):
                part = batch.take(pa.array(some))
                yield _within(codec.bytes_of(part.column("codes"), config.code_bytes), inside[some], part.column("chunk_id").to_numpy(zero_copy_only=False), names)

    def _within(codes, inside, ids, names):
        scores = np.round(codec.unpack(codes, config.dim, config.bits).astype(np.float64) @ weights + bias, DIGITS)
        return _picked_inside(scores, inside, ids, names, k)

    rows = _rows(vectors, F.col("seq").cast("long").alias("seq"), "codes", "sketch")
    return top_k(rows.mapInArrow(rescored, HITS), k)


def _picked_inside(scores: np.ndarray, inside: np.ndarray, ids: np.ndarray, names: np.ndarray, k: int) -> pa.RecordBatch:
    """As ``_picked``, of the rows that are inside each query's shortlist."""
    places = []
    for q in range(len(names)):
        own = np.flatnonzero(inside[:, q])
        places.append(own[_best(scores[own, q], ids[own], k)])
    sizes, flat = [len(p) for p in places], np.concatenate(places)
    columns = [pa.array(np.repeat(names, sizes), pa.string()), pa.array(ids[flat], pa.string()), pa.array(scores[flat, np.repeat(np.arange(len(names)), sizes)])]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])


class _Counts:
    """How many rows are at each distance of each query of a block, up to the distance by which ``keep`` are counted."""

    def __init__(self, names: pa.Array, asked: np.ndarray, width: int, places: int, keep: int):
        self.names, self.asked, self.width, self.keep = names, asked, width, keep
        self.total = np.zeros((len(names), places), np.int64)

    def add(self, ids: pa.Array, data) -> None:
        own, size = _words(data, len(ids), self.width), len(ids)
        tile, _ = _differing(self.asked, own)
        for at in range(0, len(self.names), STRIP // 4):
            qs = slice(at, min(at + STRIP // 4, len(self.names)))
            for r in range(0, size, TILE * 4):
                rs = slice(r, min(r + TILE * 4, size))
                d = np.empty((qs.stop - qs.start, rs.stop - rs.start), _distance_kind(self.width))
                tile(qs, rs, d)
                for q, own_distances in enumerate(d, at):
                    self.total[q] += np.bincount(own_distances, minlength=self.total.shape[1])

    def result(self) -> pa.RecordBatch:
        q, c = np.nonzero((self.total > 0) & (self.total.cumsum(1) - self.total < self.keep))
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(q)), pa.array(c.astype(np.int32)), pa.array(self.total[q, c])], names=["query_id", "distance", "n"])


def _fast_start(config: IndexConfig, k: int):
    """Starts the second stage for queries with their bounds: the best k within them."""
    dim, width = config.dim, -(-config.dim // 8)

    def start(names, query_data):
        both = np.frombuffer(query_data).reshape(len(names), dim + 1)
        prepared, edge = np.ascontiguousarray(both[:, :-1]), both[:, -1]
        scored, sketch = _code_block(prepared, config), np.ascontiguousarray(codec.sketch(prepared))

        def block(data, n):
            own = np.frombuffer(data, np.uint8).reshape(n, dim + width)
            codes = scored(np.ascontiguousarray(own[:, :dim]))
            tile, pairs = _differing(_words(sketch, len(names), width), _words(np.ascontiguousarray(own[:, dim:]), n, width))

            def counts(qs, rs):
                d = np.empty((qs.stop - qs.start, rs.stop - rs.start), _distance_kind(width))
                tile(qs, rs, d)
                return d <= edge[qs, None]

            def exact(q, r):
                cost, inside = np.full(len(q), np.inf), np.flatnonzero(pairs(q, r) <= edge[q])
                cost[inside] = codes.exact(q[inside], r[inside])
                return cost

            return _Block(codes.tile, codes.slack, exact, counts)

        return _Best(names, k, block)

    return start


def search_fast_frame(vectors: DataFrame, queries: DataFrame, config: IndexConfig, matrix: np.ndarray, k: int, size: int) -> DataFrame:
    """``search_fast`` for queries that are a table (query_id, embedding) of any size, as ``search_frame``.

    What is shuffled between the scans is one row for each query and distance that occurs up to its bound, which comes back
    with the query.
    """
    if k <= 0:
        return top_k(_empty(vectors), 0)
    keep, width, dim = shortlist_size(k, size), -(-config.dim // 8), config.dim
    prepare, levels = lambda c: codec.prepare(codec.matrix_of(c, dim), config, matrix), _levels(config)
    row_size, query_size = _sizes(width, width)
    sketches = _sorted_blocks(_rows(vectors, "sketch"), "chunk_id", row_size, lambda b: codec.bytes_of(b.column(1), width), "ids", "data")
    asked = _sorted_blocks(_asked(queries), "query_id", query_size, lambda b: codec.sketch(prepare(b.column(1))), "query_ids", "query_data")

    found = _against(sketches, asked, lambda names, query_data: _Counts(names, _words(query_data, len(names), width), width, dim + 1, keep), "query_id string, distance int, n long")
    # each query's bound: its counts, a short array, in order of distance
    tally = found.groupBy("query_id", "distance").agg(F.sum("n").alias("n")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "n"))).alias("t"))
    enough = F.aggregate("t", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("edge")), lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.when(a["sum"] < keep, x["distance"]).otherwise(a["edge"]).alias("edge")))
    bounds = tally.select("query_id", enough["edge"].alias("edge"))
    bounded = _asked(queries).join(bounds, "query_id")

    def packed(b):
        """Prepared queries and their bounds, side by side."""
        return np.concatenate((prepare(b.column(1)), b.column(2).to_numpy()[:, None].astype(np.float64)), 1)

    def stored(b):
        return np.concatenate((codec.bytes_of(b.column(1), config.code_bytes), codec.bytes_of(b.column(2), width)), 1)

    row_size, query_size = _sizes(dim + width, (dim + 1) * 8)
    stored = lambda b: np.concatenate((levels(b), codec.bytes_of(b.column(2), width)), 1)
    rows = _sorted_blocks(_rows(vectors, "codes", "sketch"), "chunk_id", row_size, stored, "ids", "data")
    return top_k(_against(rows, _sorted_blocks(bounded, "query_id", query_size, packed, "query_ids", "query_data"), _fast_start(config, k), HITS), k)


def hamming_frame(vectors: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, chunk_id, distance, rank): the k nearest sketches (chunk_id, sketch) of each query (query_id, sketch), ties by id."""

    def start(names, query_data):
        asked = _words(query_data, len(names), width)

        def block(data, n):
            tile, pairs = _differing(asked, _words(data, n, width))
            return _Block(tile, np.zeros(len(names)), pairs)

        return _Best(names, k, block, _distance_kind(width))

    row_size, query_size = _sizes(width, width)
    of = lambda b: codec.bytes_of(b.column(1), width)
    asked = _sorted_blocks(queries.select(F.col("query_id").cast("string").alias("query_id"), "sketch"), "query_id", query_size, of, "query_ids", "query_data")
    hits = top_k(_against(_sorted_blocks(_rows(vectors, "sketch"), "chunk_id", row_size, of, "ids", "data"), asked, start, HITS), k)
    return hits.select("query_id", "chunk_id", (-F.col("score")).cast("int").alias("distance"), "rank")


def encode(rows: DataFrame, config: IndexConfig, matrix: np.ndarray) -> DataFrame:
    """Columns ``codes`` and ``sketch`` in place of ``embedding``; other columns are kept."""
    others = [c for c in rows.columns if c != "embedding"]

    def run(batches):
        for batch in batches:
            x = codec.matrix_of(batch.column("embedding"), config.dim)
            codes, signs = codec.encode(x, config, matrix) if len(x) else (np.zeros((0, config.code_bytes), np.uint8), np.zeros((0, -(-config.dim // 8)), np.uint8))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), codec.binary_of(codes), codec.binary_of(signs)], names=[*others, "codes", "sketch"])

    kinds = T.StructType([*(rows.schema[c] for c in others), T.StructField("codes", T.BinaryType()), T.StructField("sketch", T.BinaryType())])
    return rows.select(*others, "embedding").mapInArrow(run, kinds)
