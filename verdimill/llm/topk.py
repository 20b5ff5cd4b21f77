"""Exact top-k search by tiled matrix products.

Query vectors and candidate vectors are packed into blocks of fixed size, and the
blocks are dealt to rows and columns of a grid whose size follows their number.
A cell of the grid is a task's work: it holds its query blocks and takes its
candidate blocks one by one.  A tile is the product of one query block and
one candidate block; of its scores only the best k of each query are selected, and merged into the query's
list.  The lists of a query are merged twice more: among some cells of
its row, then over the row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, tidied

K, SCALE, EVERY = 20, 64.0, 20
QUERY_BLOCK, SHARD_BLOCK = 512, 4096
#: Tasks among which cells are dealt at most.
TASKS = 10_000
#: Query and candidate blocks of one cell at most, on average; columns of the grid that small tables get if they have the blocks.
CELL_QUERIES, CELL_SHARDS, COLUMNS = 64, 16, 24
_EXACT = float(1 << 53)


def _whole(x: np.ndarray) -> list[int]:
    """floor(SCALE * x) as Python integers; doubles of 2 ** 53 and more are whole."""
    return [int(v) * int(SCALE) if abs(v) >= _EXACT else int(np.floor(v * SCALE)) for v in x.tolist()]


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of one dimension: dim, ids and values as bytes (wide: values beyond 32 bits, as text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            wide = bool(x.size) and bool(np.abs(x).max() * SCALE >= (1 << 31) - 1)
            data = " ".join(map(str, _whole(x.ravel()))).encode() if wide else np.floor(x * SCALE).astype(np.int32).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([data]), pa.array([wide])], names=["dim", "ids", "vals", "wide"])

        def blocks(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            done = 0
            while len(ids) - done >= least:
                yield block(dim, ids[done : done + size], x[done : done + size])
                done += size
            if done < len(ids):
                held[dim] = [(ids[done:], x[done:])]

        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component reads as NaN
            begin = np.cumsum(length) - length
            odd = np.r_[0, np.cumsum(~np.isfinite(flat))]
            good = ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False) & (odd[begin + length] == odd[begin])
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(length[good]).tolist():
                at = np.flatnonzero(good & (length == dim))
                held.setdefault(dim, []).append((ids[at], flat[begin[at][:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[dim]) >= size:
                    yield from blocks(dim, size)
        for dim in list(held):
            yield from blocks(dim, 1)

    return rows.mapInArrow(tidied(run), "dim int, ids binary, vals binary, wide boolean")


def _unpack(ids: bytes, data: bytes, wide: bool, dim: int):
    n = np.frombuffer(ids, np.int64)
    if wide:
        return n, np.array([int(v) for v in data.split()], object).reshape(len(n), dim)
    return n, np.frombuffer(data, np.int32).reshape(len(n), dim).astype(np.float64)


def _best(score: np.ndarray, ids: np.ndarray, k: int):
    """Columns of the k best of each row: score descending, then smaller id (ids ascend)."""
    n = score.shape[1]
    if n > k:
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    for i in range(score.shape[0]):
        row = score[i]
        at = np.flatnonzero(row >= kth[i]) if n > k else np.arange(n)
        yield at[np.lexsort((ids[at], -row[at]))][:k]


def tile(qid, q, cid, c, k: int):
    """(number of the query in its block, vec_id, score) arrays: the best k of each query in one tile, rows with the query's own id left out."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    exact = q.dtype != object and c.dtype != object and (not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < _EXACT)
    if exact:
        score = q @ c.T
    else:  # beyond exact doubles: Python integers, held to the range of a long
        big = np.array([[int(v) for v in r] for r in q], object).dot(np.array([[int(v) for v in r] for r in c], object).T)
        score = np.array([[max(-(1 << 63), min((1 << 63) - 1, v)) for v in r] for r in big], object)
        # ranks stand in for the scores, so that the selection stays exact
        levels = sorted({v for r in score for v in r})
        rank = {v: float(j) for j, v in enumerate(levels)}
        plain, score = score, np.array([[rank[v] for v in r] for r in score], np.float64)
    # A query's own rows go below every score before the selection: there may be more than k of them.
    ranked = np.where(cid == qid[:, None], -np.inf, score)
    out_q, out_c, out_s = [], [], []
    for i, at in enumerate(_best(ranked, cid, k)):
        at = at[cid[at] != qid[i]]
        out_q.append(np.full(len(at), i))
        out_c.append(cid[at])
        out_s.append(score[i, at].astype(np.int64) if exact else np.array([int(plain[i][j]) for j in at], np.int64))
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _merge(held: tuple | None, new: tuple, k: int) -> tuple:
    """(query number, vec_id, score) of the k best of each query in both."""
    if held is not None:
        new = tuple(np.concatenate(c) for c in zip(held, new, strict=True))
    q, c, s = new
    order = np.lexsort((c, ~s, q))  # ~s falls as s rises, and can't overflow
    q, c, s = q[order], c[order], s[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return q[place < k], c[place < k], s[place < k]


def _cells(blocks: DataFrame, k: int) -> DataFrame:
    """The best k of each query in each cell; blocks come sorted by cell and dimension, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, lists = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            for (ids, *_), best in zip(queries, lists, strict=True):
                if best is not None:
                    q, c, s = best
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), cell[1]), pa.int32()), pa.array(ids[q]), pa.array(c), pa.array(s)], names=["grp", "query_id", "vec_id", "score"])

        for batch in batches:
            for row, grp, dim, is_shard, ids, vals, wide in zip(*(batch.column(n) for n in ("row", "grp", "dim", "shard", "ids", "vals", "wide")), strict=True):
                now = row.as_py(), grp.as_py(), dim.as_py()
                if now != cell:
                    yield from done()
                    cell, queries, lists = now, [], []
                block = _unpack(ids.as_py(), vals.as_py(), wide.as_py(), now[2])
                if not is_shard.as_py():
                    queries.append(block)
                    lists.append(None)
                    continue
                for n, q in enumerate(queries):
                    lists[n] = _merge(lists[n], tile(*q, *block, k), k)
        yield from done()

    return blocks.mapInArrow(tidied(run), "grp int, query_id long, vec_id long, score long")


def grid(queries: int, vectors: int) -> tuple[int, int]:
    """Rows and columns of the grid: both follow the numbers of blocks."""
    shards = -(-vectors // SHARD_BLOCK)
    return max(1, -(-queries // (QUERY_BLOCK * CELL_QUERIES))), max(1, -(-shards // CELL_SHARDS), min(shards, COLUMNS))


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every``, its k best rows but itself.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without vec_id.  Vectors of different lengths are never
    compared.  Rows that repeat a vec_id are candidates each; rows with a
    query's own id are its own.  Sums beyond a long are held to its range.
    Equal scores are ordered by vec_id; an empty table gives no rows, and other columns play no part.
    """
    rows = embeddings.select("vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % every == 0)
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    n_rows, n_columns = grid(n.q, n.n)
    to = lambda m: F.pmod(F.xxhash64("ids"), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    shards = _pack(rows, SHARD_BLOCK).select("*", F.lit(True).alias("shard"), to(n_columns).alias("grp"), all_of(n_rows).alias("row"))
    queries = _pack(asked, QUERY_BLOCK).select("*", F.lit(False).alias("shard"), to(n_rows).alias("row"), all_of(n_columns).alias("grp"))
    blocks = shards.unionByName(queries).repartition(min(2 * n_rows * n_columns, TASKS), "row", "grp", "dim").sortWithinPartitions("row", "grp", "dim", "shard")
    found = settle(_cells(blocks, k))
    best = [F.col("score").desc(), F.col("vec_id")]
    some = F.pmod("grp", F.lit(math.isqrt(n_columns) + 1))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", some).orderBy(*best))).where(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOPK_SQL = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE:g} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
