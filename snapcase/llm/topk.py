"""Exact top-k inner products by the threshold algorithm over sorted lists.

Vectors are dealt to blocks; a block keeps, for each dimension, its vectors sorted by
that component.  A query walks the lists of all dimensions from the end where its
component contributes most, some rows deeper each step.  Vectors seen for the first time
are scored in full.  No unseen vector can score more than the sum of the contributions
at the depth reached; once that bound is below the kth best score the walk stops.  A
bound equal to the kth score goes on, so ties are complete.  A walk that has seen nearly
the whole block scores the rest of it.

Queries are grouped into blocks as well, and every block of queries meets every block
of vectors once, each as a packed array of bounded size; a query's k best of each block
are merged by rank.

Rows: vectors that are null, or hold a null or a component that is not finite, take no
part; shorter vectors count as padded with zeros; an empty vector scores 0.  A query
never meets its own row, nor others with its id.  A score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Emitter, rows_of, run_folder, stored

K = 10
SCALE = 1024
QUERY_EVERY = 100
# Vectors and queries of a block: 64 components of 8 bytes make 8 MB and 0.25 MB.
BLOCK, QUERY_BLOCK = 16_384, 512
FIRST_DEPTH = 16
# Share of a block that a walk has seen when the few vectors left are scored outright.
NEARLY_ALL = 0.95

_PACKED = "at int, ids binary, width int, values binary"


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that take part."""
    usable = F.col("v").isNotNull() & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                           F.col(vector_col).cast("array<double>").alias("v"))
            .filter(usable & F.col("vec_id").isNotNull())
            .select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")))


def _pack(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (at, vec_id, v), sorted by at, into arrays of at most ``size`` vectors."""
    schema = pa.schema([("at", pa.int32()), ("ids", pa.binary()), ("width", pa.int32()),
                        ("values", pa.binary())])
    held, now = [], None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            width = max(1, max(len(v) for _, v in held))
            values = np.zeros((len(held), width), dtype=np.int64)
            for i, (_, v) in enumerate(held):
                values[i, :len(v)] = v
            ids = np.array([i for i, _ in held], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([width], pa.int32()), pa.array([values.tobytes()], pa.binary())],
                schema=schema)
        held.clear()

    for at, vec_id, v in rows_of(batches, "at", "vec_id", "v"):
        if at != now or len(held) >= size:
            yield from flush()
            now = at
        held.append((vec_id, v))
    yield from flush()


def packed(vectors: DataFrame, size: int, n: int) -> DataFrame:
    """Blocks of about ``size`` vectors as packed arrays, dealt by the hash of the id."""
    blocks = max(1, -(-n // size))
    return (vectors.withColumn("at", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
            .repartition("at").sortWithinPartitions("at", "vec_id")
            .mapInArrow(lambda b: _pack(b, 2 * size), _PACKED))


def _unpack(ids: bytes, width: int, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(ids, dtype=np.int64),
            np.frombuffer(values, dtype=np.int64).reshape(-1, width))


class SortedLists:
    """A block of vectors with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.int32)
        self.largest = float(np.abs(values.astype(np.float64)).max(initial=0.0))
        self.floats = values.astype(np.float64)

    def scores(self, rows: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        """Exact inner products; in floating point where every partial sum is exact."""
        bound = self.largest * float(np.abs(query.astype(np.float64)).sum())
        if bound < 2.0**53:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        if bound < 2.0**62:
            return self.values[rows] @ query
        exact = self.values[rows].astype(object) @ query.astype(object)
        return exact.astype(np.int64)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[tuple], int]:
        """The k best (score, id) of the block, and how many vectors the bound left unseen."""
        n, width = self.values.shape
        used = min(width, len(query))
        query = np.concatenate((query[:used], np.zeros(width - used, dtype=np.int64)))
        dims = np.flatnonzero(query)
        up = query[dims] > 0
        seen = np.zeros(n, dtype=bool)
        best: list[tuple] = []
        depth, done = min(FIRST_DEPTH, n) if len(dims) else n, 0
        while True:
            if depth == n:
                new = np.flatnonzero(~seen)
            else:
                met = np.zeros(n, dtype=bool)
                met[self.order[n - depth:n - done][:, dims[up]]] = True
                met[self.order[done:depth][:, dims[~up]]] = True
                new = np.flatnonzero(met & ~seen)
            seen[new] = True
            scores = self.scores(new, query)
            if len(best) >= k:
                good = scores >= best[-1][0]
                new, scores = new[good], scores[good]
            found = [(s, i) for s, i in zip(scores.tolist(), self.ids[new].tolist())
                     if i != query_id]
            best = sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
            if depth == n:
                return best, 0
            edge = np.where(up, self.values[self.order[n - depth, dims], dims],
                            self.values[self.order[depth - 1, dims], dims])
            bound = sum(int(a) * int(b) for a, b in zip(edge, query[dims]))
            if len(best) >= k and bound < best[-1][0]:
                return best, n - int(seen.sum())
            done, depth = depth, min(n, 2 * depth)
            if seen.sum() >= NEARLY_ALL * n:
                depth = n


def _meet(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    out = Emitter(pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()),
                             ("score", pa.int64())]))
    at, lists = None, None
    for row in rows_of(batches, "at", "ids", "width", "values", "q_ids", "q_width", "q_values"):
        if lists is None or at != row[:2]:
            at, lists = row[:2], SortedLists(*_unpack(*row[1:4]))
        for query_id, query in zip(*_unpack(*row[4:7])):
            for score, vec_id in lists.top(int(query_id), query, k)[0]:
                out.add((int(query_id), vec_id, score))
        if out.full:
            yield out.batch()
    yield out.batch()


def top_scores(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
               query_every: int = QUERY_EVERY, k: int = K, scale: int = SCALE,
               block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, ties to smaller ids.

    Queries are the rows whose id is divisible by ``query_every``.
    """
    folder = run_folder(vectors.sparkSession, "topk")
    table = stored(whole(vectors, id_col, vector_col, scale), f"{folder}/vectors")
    is_query = F.col("vec_id") % query_every == 0
    queries = table.filter(is_query)
    sizes = table.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    blocks = stored(packed(table, block, sizes.n), f"{folder}/blocks")
    asked = stored(packed(queries, query_block, sizes.q).select(
        F.col("at").alias("q_at"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"),
        F.col("values").alias("q_values")), f"{folder}/queries")
    n_queries = max(1, -(-sizes.q // query_block))
    found = blocks.withColumn("q_at", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    # Every pair of blocks is a task's unit of work: all queries against all rows, in blocks.
    pairs = found.join(asked, "q_at").repartition(F.col("at"), F.col("q_at"))
    local = pairs.mapInArrow(lambda b: _meet(b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
