"""Near-duplicate vectors by spherical-cap filters of a structured random product code.

Filter directions are the words of product codes: after a random rotation a vector is cut
into ``PARTS`` blocks, each block has its own short list of random unit vectors, and every
way to take one of each is a direction.  In each code a vector lies in the ``HITS`` filters
whose directions it exceeds furthest (a cap whose height is its own).  The directions are
never listed: list decoding takes the largest sums over two blocks, then over all.

1. Equal vectors fold into one row with their number of copies.
2. Rows are decoded to filters; filters that hold one row say nothing and go.
3. The rows of a filter meet in blocks of bounded size and are compared exactly (cosine in
   double precision).  A pair counts in the lowest filter that both lie in, so numbers of
   links add up over filters, and each block gives out one sum for each row and a spanning
   forest of its links: never the pairs themselves.
4. Connected components of the forests' edges are the groups.

The codes grow with the number of rows, so that a filter holds few unrelated rows at any
size, and more rotations make up for it.  Of 4,000 random pairs at the threshold none missed
all common filters, at any of the sizes; nearer pairs share more (tested against brute force).

Rows: vectors that are null, empty, zero or hold a null or a component that is not finite
link with nothing; shorter vectors count as padded with zeros; rows with a null id link
with nothing; rows that repeat an id are each a row, and each other's neighbours where
their vectors are near; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, rows_of, run_folder, stored
from .components import connected

THRESHOLD = 0.9
# Blocks of a product code, filters of a vector in each, rows that meet at once.
PARTS = 4
HITS = 8
BLOCK = 512
# Unrelated rows that a filter holds on average, and the most directions of a block.
CROWD = 0.005
WIDEST = 1024
SEED = 20_240_607


class ProductCode:
    """One rotation's filter directions for vectors of ``dims`` components."""

    def __init__(self, dims: int, words: int, turn: int):
        self.words, self.width = words, max(2, -(-dims // PARTS))
        size = self.width * PARTS
        rng = np.random.default_rng([SEED, dims, words, turn])
        self.rotation = np.linalg.qr(rng.standard_normal((size, size)))[0][:dims]
        blocks = rng.standard_normal((PARTS, words, self.width))
        self.blocks = blocks / np.linalg.norm(blocks, axis=2, keepdims=True)

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Numbers (rows, ``HITS``) of the directions that unit vectors exceed furthest."""
        turned = (unit @ self.rotation).reshape(len(unit), PARTS, self.width)
        best = []
        for i in range(PARTS):
            products = turned[:, i] @ self.blocks[i].T
            names = np.broadcast_to(np.arange(self.words), products.shape)
            best.append(_largest(products, names))
        scale = self.words
        while len(best) > 1:
            best = [_joined(a, b, scale) for a, b in zip(best[::2], best[1::2])]
            scale *= scale
        return best[0][1]


def _largest(values: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``HITS`` largest values of each row, in order, with their names."""
    order = np.argsort(-values, axis=1, kind="stable")[:, :HITS]
    return np.take_along_axis(values, order, 1), np.take_along_axis(names, order, 1)


def _joined(left: tuple, right: tuple, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest sums of one entry of each side.

    A sum of the i-th and the j-th largest has i * j - 1 sums before it, so most are not tried.
    """
    i, j = np.indices((left[0].shape[1], right[0].shape[1]))
    near = (i + 1) * (j + 1) <= HITS
    i, j = i[near], j[near]
    return _largest(left[0][:, i] + right[0][:, j],
                    left[1][:, i].astype(np.int64) * scale + right[1][:, j])


def code_size(rows: int) -> tuple[int, int]:
    """(words of a block, rotations) of the codes for that many rows.

    A filter holds about ``CROWD`` unrelated rows.  Pairs at 0.9 lie in about 16 common
    filters: at 16 words a rotation gives 2.2, and each doubling leaves 0.66 of them (measured).
    """
    words = min(WIDEST, max(16, math.ceil((rows * HITS / CROWD) ** (1 / PARTS))))
    return words, math.ceil(7 * (words / 16) ** 0.6)


@lru_cache(maxsize=128)
def product_code(dims: int, words: int, turn: int) -> ProductCode:
    return ProductCode(dims, words, turn)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, usable): vectors in double precision and whether they can link."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .withColumn("usable", F.coalesce(F.col("v").isNotNull() & F.col("id").isNotNull()
                                             & some & ~bad, F.lit(False))))


def _filters(batches: Iterable[pa.RecordBatch], dims: int, words: int,
             turns: int) -> Iterator[pa.RecordBatch]:
    """(rep, filter) for every filter of a vector."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            unit = _units(_matrix(part.column(1).to_pylist(), dims))
            for turn in range(turns):
                found = product_code(dims, words, turn).decode(unit) + turn * words ** PARTS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), found.shape[1])),
                     pa.array(found.ravel())], names=["rep", "filter"])


def _matrix(vectors: list, dims: int) -> np.ndarray:
    x = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        x[i, :len(v)] = v
    return x


def _units(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component goes first, so no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shared_before(left: list, right: list, value: int) -> np.ndarray:
    """Whether rows share a filter lower than ``value``."""
    cut = [[f[:np.searchsorted(f, value)] for f in side] for side in (left, right)]
    flat = np.concatenate([np.asarray(f, dtype=np.int64) for side in cut for f in side])
    found, at = np.unique(flat, return_inverse=True)
    table = np.zeros((len(left) + len(right), max(1, len(found))), dtype=np.float32)
    table[np.repeat(np.arange(len(table)), [len(f) for side in cut for f in side]), at] = 1
    return table[:len(left)] @ table[len(left):].T > 0


def _forest(pairs: Iterable[tuple[int, int]], ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges (a, b) of a spanning forest of the links between row positions."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            yield int(ids[x]), int(ids[y])


def _compared(left: list, right: list | None, value: int, threshold: float) -> tuple[dict, list]:
    """Links of rows (rep, copies, unit, filters): sums by rep, and edges of a forest.

    ``right`` is another block of the filter; without it the rows of ``left`` meet each other.
    """
    a = left
    b = left if right is None else right
    near = np.array([r[2] for r in a]) @ np.array([r[2] for r in b]).T >= threshold
    if right is None:
        np.fill_diagonal(near, False)
    if not near.any():
        return {}, []
    ids = np.array([r[0] for r in (a if right is None else a + b)])
    shift = 0 if right is None else len(a)
    edges = list(_forest(zip(*(x.tolist() for x in np.nonzero(near))), ids) if right is None else
                 _forest(((x, y + shift) for x, y in zip(*(i.tolist() for i in np.nonzero(near)))), ids))
    # A pair counts in the lowest filter that both rows lie in.
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(rows, columns)]
    near &= ~_shared_before([a[i][3] for i in rows], [b[i][3] for i in columns], value)
    sums: dict[int, int] = {}
    copies = np.array([b[i][1] for i in columns], dtype=np.int64)
    for i, n in zip(rows, near.astype(np.int64) @ copies):
        sums[a[i][0]] = sums.get(a[i][0], 0) + int(n)
    if right is not None:
        copies = np.array([a[i][1] for i in rows], dtype=np.int64)
        for i, n in zip(columns, near.T.astype(np.int64) @ copies):
            sums[b[i][0]] = sums.get(b[i][0], 0) + int(n)
    return sums, edges


_FOUND = "a long, b long, n long"
_MEETING = ("filter", "i", "j", "side", "rep", "copies", "unit", "filters")


def _carry(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Vectors of length 1 and lists of filters as packed bytes."""
    out = Emitter(pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary()),
                             ("filters", pa.binary())]), max_rows=512)
    for rep, copies, v, filters in rows_of(batches, "rep", "copies", "v", "filters"):
        out.add((rep, copies, _units(_matrix([v], dims))[0].tobytes(),
                 np.array(filters, dtype=np.int64).tobytes()))
        if out.full:
            yield out.batch()
    yield out.batch()


def _meet(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (filter, i, j, side) to sums (a, null, n) and edges (a, b, null)."""
    out = Emitter(pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))
    place, sides = None, ([], [])

    def finish() -> None:
        if place is None or not sides[0]:
            return
        same = place[1] == place[2]
        if not same and not sides[1]:
            return
        sums, edges = _compared(sides[0], None if same else sides[1], place[0], threshold)
        for rep, n in sums.items():
            if n:
                out.add((rep, None, n))
        for a, b in edges:
            out.add((a, b, None))

    for value, i, j, side, rep, copies, unit, filters in rows_of(batches, *_MEETING):
        if (value, i, j) != place:
            finish()
            place, sides = (value, i, j), ([], [])
            if out.full:
                yield out.batch()
        sides[side].append((rep, copies, np.frombuffer(unit, np.float64),
                            np.frombuffer(filters, np.int64)))
    finish()
    yield out.batch()


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    folder = run_folder(vectors.sparkSession, "caps")
    table = stored(_usable(vectors, id_col, vector_col), f"{folder}/vectors")
    # Zeros at the end change no cosine, nor does the sign of a zero.
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    usable = (table.filter("usable").withColumn("v", plain)
              .withColumn("print", F.sha2(F.to_binary(F.array_join(F.col("v").cast("array<string>"), ","),
                                                      F.lit("utf-8")), 256)))
    # A repeated id may stand for several classes, so they are told apart by numbers.
    classes = stored(usable.groupBy("print").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"))
        .withColumn("number", F.monotonically_increasing_id()), f"{folder}/classes")
    sizes = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims, (words, turns) = sizes.dims or 1, code_size(sizes.n)
    places = stored(classes.select(F.col("number").alias("rep"), "v").mapInArrow(
        lambda b: _filters(b, dims, words, turns), "rep long, filter long"), f"{folder}/places")
    crowded = stored(places.groupBy("filter").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"),
                     f"{folder}/crowded")
    held = stored(places.join(crowded, "filter"), f"{folder}/held")
    # A vector lies in a bounded number of filters, so its list is one row's array.
    lists = held.groupBy("rep").agg(F.array_sort(F.collect_list("filter")).alias("filters"))
    carried = stored(classes.select(F.col("number").alias("rep"), "copies", "v").join(lists, "rep")
                     .mapInArrow(lambda b: _carry(b, dims),
                                 "rep long, copies long, unit binary, filters binary"),
                     f"{folder}/carried")
    full = (held.join(carried, "rep")
            .withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
            # Block i meets block j for every i <= j.
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .withColumn("side", F.when(F.col("own") <= F.col("other"), 0).otherwise(1)))
    meeting = (full.select(*_MEETING).repartition("filter", "i", "j")
               .sortWithinPartitions("filter", "i", "j", "side"))
    found = stored(meeting.mapInArrow(lambda b: _meet(b, threshold), _FOUND), f"{folder}/found")
    sums = found.filter("n is not null").groupBy(F.col("a").alias("number")).agg(F.sum("n").alias("n"))
    final = connected(found.filter("b is not null").select("a", "b"), f"{folder}/final")
    placed = classes.join(final.withColumnRenamed("node", "number"), "number", "left").select(
        "number", "print", "rep", "copies", F.coalesce("component", "number").alias("component"))
    low = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = stored(placed.join(low, "component").join(sums, "number", "left").select(
        "print", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        f"{folder}/of-class")
    linked = usable.select("id", "print").join(of_class, "print").select("id", "n_links", "component_id")
    alone = table.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
