"""Exact top-k inner products by block-at-a-time pruning over a forward index of document ranges.

Vectors are laid out in an order that puts alike ones near each other and cut into blocks; a block
keeps its rows as one matrix (the forward index) and the greatest and least value of each
component. A query orders blocks by the sum of its weights times those extremes, scores whole
blocks in that order and stops where the bound falls below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotspot.llm.common import by_value, shuffle_partitions, stored

by_value(__name__)

#: Rows of a block; blocks that a task holds at a time; components of the queries of one pass over the index
#: (which are broadcast); sampled vectors that set the order of the rows (and nothing else).
BLOCK, HELD, PASS, PIVOTS = 64, 1024, 4_000_000, 256
_EXACT = 2.0**53  # doubles are exact integers below
_LONG = (-(2**63), 2**63 - 1)

_INDEX = "first_id long, n int, dims int, ids binary, keys binary, vectors binary, high binary, low binary"
_INDEX_FIELDS = [("first_id", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("vectors", pa.binary()), ("high", pa.binary()), ("low", pa.binary())]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)`` with ``floor(scale * x)`` as doubles; rows without an id, null vectors and vectors
    with a component that is null or, scaled, not finite are left out."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    # doubles of 2^52 and more have no fraction
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)).alias("v"))


def _matrix(rows: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _rows_of(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _places(matrix: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the number of its nearest pivot by direction, and how far it goes that way."""
    dims = max(matrix.shape[1], pivots.shape[1])
    m, p = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (matrix, pivots))
    with np.errstate(all="ignore"):
        p = p / np.maximum(np.sqrt((p * p).sum(1, keepdims=True)), 1e-300)
        along = np.nan_to_num(m @ p.T)
    near = np.argmax(along, axis=1)
    return near.astype(np.int32), along[np.arange(len(m)), near]


def build_index(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows(id, v, key)`` as a written table.

    ``PIVOTS`` vectors of least hashed id give every row its place (nearest pivot, then its product
    with it); rows are range-partitioned by place and cut into blocks of ``BLOCK``.
    """
    picked = rows.orderBy(F.xxhash64("id"), "id", "key").limit(PIVOTS).select("v").collect()
    found = [np.array(r["v"]) for r in picked]
    pivots = _matrix(found or [np.zeros(1)], max([1, *map(len, found)]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _rows_of(b.column(1))
            m = _matrix(v, max([1, *map(len, v)]))
            near, along = _places(m, pivots)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(along)], ["id", "v", "key", "place", "along"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        keys: list[int] = []
        held: list[np.ndarray] = []

        def block() -> tuple:
            dims = max(len(r) for r in held[:BLOCK])
            m = _matrix(held[:BLOCK], dims)
            own, key = np.array(ids[:BLOCK], np.int64), np.array(keys[:BLOCK], np.int64)
            del ids[:BLOCK], keys[:BLOCK], held[:BLOCK]
            ends = (m.max(0).tobytes(), m.min(0).tobytes())
            return int(own.min()), len(own), dims, own.tobytes(), key.tobytes(), m.tobytes(), *ends

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, (_, t) in enumerate(_INDEX_FIELDS)], [n for n, _ in _INDEX_FIELDS])

        for b in batches:
            ids += b.column(0).to_pylist()
            keys += b.column(2).to_pylist()
            held += [r.copy() for r in _rows_of(b.column(1))]
            done = []
            while len(ids) >= BLOCK:
                done.append(block())
            if done:
                yield out(done)
        if ids:
            yield out([block()])

    placed = rows.select("id", "v", "key").mapInArrow(place, "id long, v array<double>, key long, place int, along double")
    order = ["place", "along", "id", "key"]  # the last cut a place that holds many equal rows
    laid = placed.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stored(laid.select("id", "v", "key").mapInArrow(blocks, _INDEX), "topk-index")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in whole numbers: in doubles where no partial sum can lose a digit, else in
    Python's own integers, cut to the range of a long."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        plain = dims * np.abs(a).max() * np.abs(b).max() < _EXACT
    if plain:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b.tolist()]
    exact = [[min(max(sum(int(x) * y for x, y in zip(r, w)), _LONG[0]), _LONG[1]) for w in whole] for r in a.tolist()]
    return np.array(exact, np.int64).reshape(len(a), len(b))


class _Held:
    """Some blocks in a task: their extremes as two matrices, their rows as views."""

    def __init__(self, batch: list[dict]):
        self.ids = [np.frombuffer(r["ids"], np.int64) for r in batch]
        self.keys = [np.frombuffer(r["keys"], np.int64) for r in batch]
        self.rows = [np.frombuffer(r["vectors"]).reshape(r["n"], r["dims"]) for r in batch]
        dims = max(r["dims"] for r in batch)
        self.high = _matrix([np.frombuffer(r["high"]) for r in batch], dims)
        self.low = _matrix([np.frombuffer(r["low"]) for r in batch], dims)


class _Best:
    """The best ``k`` of every query so far: scores, ids, and the least score that still counts."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: list[np.ndarray], score: list[np.ndarray], ids: list[np.ndarray]) -> None:
        q, s, i = np.concatenate((self.query, *query)), np.concatenate((self.score, *score)), np.concatenate((self.id, *ids))
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, at both ends of the range
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        kept, last = rank < self.k, rank == self.k - 1
        self.query, self.score, self.id = q[kept], s[kept], i[kept]
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])


def search_blocks(held: _Held, queries: np.ndarray, keys: np.ndarray, best: _Best) -> None:
    """Every query over the held blocks in the order of its bounds, more blocks at each step, until the
    bound of its next block falls below its k-th score (an equal one may hold a smaller id)."""
    dims = min(queries.shape[1], held.high.shape[1])
    q = queries[:, :dims]
    with np.errstate(all="ignore"):
        bounds = np.maximum(q, 0) @ held.high[:, :dims].T + np.minimum(q, 0) @ held.low[:, :dims].T
        # beyond exact doubles a bound is rounded: raise it by more than it, or the score beside it, can lose
        big = np.abs(q) @ np.maximum(np.abs(held.high), np.abs(held.low))[:, :dims].T
        bounds = np.where(big < _EXACT, bounds, bounds + big * (dims + 2) * 2.0**-50)
    bounds = np.maximum(np.where(np.isnan(bounds), np.inf, bounds), float(_LONG[0]))  # scores are cut there
    order = np.argsort(-bounds, axis=1, kind="stable")
    n_blocks, at, width = len(held.ids), 0, 1
    active = np.arange(len(q))
    while at < n_blocks and len(active):
        chosen = order[active, at : at + width]
        open_ = bounds[active[:, None], chosen] >= best.least[active][:, None]
        who, which = np.repeat(active, chosen.shape[1])[open_.ravel()], chosen.ravel()[open_.ravel()]
        by_block = np.argsort(which, kind="stable")
        who, which = who[by_block], which[by_block]
        found: tuple[list, list, list] = ([], [], [])
        for k in np.unique(which):
            mine = who[np.searchsorted(which, k) : np.searchsorted(which, k, side="right")]
            scores = _product(queries[mine], held.rows[k])
            good = (scores >= best.least[mine][:, None]) & (held.keys[k][None, :] != keys[mine][:, None])
            row, col = np.nonzero(good)
            found[0].append(mine[row])
            found[1].append(scores[row, col])
            found[2].append(held.ids[k][col])
        if found[0]:
            best.add(*found)
        at += width
        width = min(2 * width, 64)
        if at < n_blocks:
            active = active[bounds[active, order[active, at]] >= best.least[active]]


def _searched(batches: Iterator[pa.RecordBatch], queries: np.ndarray | None, keys: np.ndarray | None, least: np.ndarray | None, k: int, every: int) -> Iterator[tuple]:
    """``(query, key, best)`` of a task; without queries each group of blocks answers for its own."""
    best = None if queries is None else _Best(least, k)
    group: list[dict] = []

    def rest():
        held = _Held(group)
        if queries is not None:
            search_blocks(held, queries, keys, best)
            return None
        dims = max(x.shape[1] for x in held.rows)
        own = [np.flatnonzero(i % every == 0) for i in held.ids]
        if not any(len(o) for o in own):
            return None
        q = _matrix([r[j] for r, o in zip(held.rows, own) for j in o], dims)
        key = np.concatenate([x[o] for x, o in zip(held.keys, own)])
        ids = np.concatenate([x[o] for x, o in zip(held.ids, own)])
        b = _Best(np.full(len(q), _LONG[0], np.int64), k)
        search_blocks(held, q, key, b)
        return ids, key, q, b.least

    for b in batches:
        for r in b.to_pylist():
            group.append(r)
            if len(group) >= HELD:
                if (out := rest()) is not None:
                    yield out
                group = []
    if group and (out := rest()) is not None:
        yield out
    if best is not None:
        yield best


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` greatest inner products of every query over all other rows, exact.

    Queries are the rows whose id is divisible by ``every``; a component ``x`` counts as ``floor(scale * x)``.
    Returns ``(query_id, rank, vec_id, score)``, rank from 1, equal scores by smaller id; all rows where
    there are fewer than ``k``. Shorter vectors are as if followed by zeros, so an empty one scores 0. Rows
    without an id, null vectors and those with null or non-finite components take no part. Rows that repeat
    an id stay rows of their own: each is a candidate for the others, and each such query gets its ranks (a
    row is only kept from itself). Scores beyond a long are cut to it, after ranking. An empty table gives
    an empty result; other columns are ignored.

    A first pass gives each query the k-th score among the blocks beside its own; passes over the index, of about
    ``PASS`` components of queries each, then start from it, and what their tasks still find is merged by rank.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_col, vector_col, scale).withColumn("key", F.monotonically_increasing_id()), "topk-rows")
    index = build_index(rows)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, q, least in _searched(batches, None, None, None, k, every):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(list(q), pa.list_(pa.float64())), pa.array(least)], ["query_id", "key", "v", "least"])

    queries = stored(index.mapInArrow(seed, "query_id long, key long, v array<double>, least long"), "topk-queries")
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    passes = -(-size["n"] * max(1, size["dims"]) // PASS) or 1
    out = None
    for number in range(passes):
        found = stored(_pass(index, queries.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == number), k), "topk-found")
        out = found if out is None else out.unionByName(found)
    return out


def _pass(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Ranks of a bounded set of queries over the whole index."""
    spark = index.sparkSession
    got = queries.orderBy("key").collect()
    dims = max([1, *(len(r["v"]) for r in got)])
    sent = spark.sparkContext.broadcast((_matrix([np.array(r["v"]) for r in got], dims), np.array([r["key"] for r in got], np.int64), np.array([r["least"] for r in got], np.int64)))
    ids = np.array([r["query_id"] for r in got], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, keys, least = sent.value
        for best in _searched(batches, q, keys, least, k, 0):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(keys[best.query]), pa.array(best.id), pa.array(best.score)], ["query_id", "key", "vec_id", "score"])

    found = index.mapInArrow(run, "query_id long, key long, vec_id long, score long")
    w = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
