"""Near-duplicate documents by bottom-k sketches of word shingles.

1. Every document becomes its set of word shingles (64-bit hashes).  Documents with
   equal sets form one class; only class representatives go on.
2. One hash function orders all shingles; the bottom-k sketch of a set is its k lowest.
3. Inverted lists (retained shingle -> classes) generate pairs.  Of two similar sketches the
   smaller number of values that they can share is known: all but 1 - t of them where both
   sets are kept whole (certain), else a Binomial(k, t) number, of which ``SIGMAS`` standard
   deviations are allowed for (where one set contains the other; about three misses in a
   billion such pairs).  So similar sets meet in a list of the rarest values of each, and a
   class enters only those lists: shingles of passages that many documents share generate
   pairs only between documents that consist mostly of such shingles.
4. Two sketches give the union's sketch; its overlap estimates the similarity.  Pairs that
   are ``SIGMAS`` standard errors below the threshold are dropped, the rest verified on the
   full sets.
5. First each member of a list is compared with two pivots only, so a large group of near
   copies costs a few rows per member and list.  Then lists whose members are not all
   connected are taken up again: up to ``LONG_LIST`` members as pairs.  The members of longer
   ones get longer sketches (the next of ``SKETCHES``), whose lists are shorter, and go through
   the same passes.  What is long even then is compared in blocks: lists around one pivot
   form one table, whose blocks meet once each inside a task and give out a link for each two
   components, not for each pair.  No link between different components is lost.

Rows: a null or empty text has an empty set and links with nothing; a text of fewer words
than a shingle is one shingle of all its words.  Documents are told apart by id: rows that
repeat an id count as one document in components, with the links of all its texts.  A null id
links with nothing.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, drop_shuffles, mix64, remove, rows_of, run_folder, stored
from .components import connected

SHINGLE_WORDS = 5
THRESHOLD = 0.8
# Values kept of a set: at first, and for members of lists that stay long.
SKETCHES = (96, 512)
SIGMAS = 6.4
# Members beyond which a list is compared in blocks, and the members of a block.
LONG_LIST = 32
BLOCK = 256

_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    width, factor = 1, base & (2**64 - 1)
    with np.errstate(over="ignore"):
        while width < n:
            take = min(width, n - width)
            out[width:width + take] = out[:take] * np.uint64(factor)
            width, factor = width * 2, factor * factor & (2**64 - 1)
    return out


class Shingler:
    """Sets of shingle hashes of texts; holds tables that grow to the longest text."""

    def __init__(self, words: int):
        self.words = words
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up = _powers(n, int(_BASE))
            self.down = _powers(n, pow(int(_BASE), -1, 1 << 64))

    def word_hashes(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of a text (its bytes, A-Z already in lower case)."""
        b = np.frombuffer(raw, dtype=np.uint8)
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
        if not len(edges):
            return np.empty(0, dtype=np.uint64)
        starts, ends = edges[::2], edges[1::2]
        self._tables(len(b) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64),
                                   np.cumsum(_BYTE_VALUES[b] * self.up[:len(b)])))
            h = (sums[ends] - sums[starts]) * self.down[starts]
            return mix64(h + (ends - starts).astype(np.uint64))

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes, ascending."""
        words = self.word_hashes((text or "").encode().lower())
        n = min(self.words, len(words))
        if n == 0:
            return words
        with np.errstate(over="ignore"):
            h = np.full(len(words) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = mix64(h * _BASE + words[i:len(words) - n + 1 + i])
        return np.unique(h)


def _lowest(s: np.ndarray, size: int) -> np.ndarray:
    """The bottom sketch; its values keep the order of the hashes when read as signed numbers."""
    return (s[:size] ^ np.uint64(1 << 63)).view(np.int64)


def _sketches(batches: Iterable[pa.RecordBatch], words: int, size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()),
                        ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("sketch", pa.list_(pa.int64()))])
    shingler, out = Shingler(words), Emitter(schema)
    for doc, mark, text in rows_of(batches, "id", "print", "text"):
        s = shingler.shingles(text)
        with np.errstate(over="ignore"):
            a, b = np.add.reduce(mix64(s + _BASE)), np.bitwise_xor.reduce(mix64(s ^ _BASE))
        low = _lowest(s, size)
        out.add((doc, mark, len(s), int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64)),
                 low), 8 * len(low))
        if out.full:
            yield out.batch()
    yield out.batch()


def least_shared(size: int, threshold: float) -> float:
    """The share of a sketch of that size that similar sets have in common at least."""
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / size)


class Corpus:
    """The texts behind the classes: ``keys`` has a row (rep, id, print) for each class."""

    def __init__(self, rows: DataFrame, keys: DataFrame, words: int):
        self.rows, self.keys, self.words = rows, keys, words

    def texts(self, members: DataFrame) -> DataFrame:
        """(rep, text) of the classes in ``members`` (rep), each once."""
        # A merge join at any size: what is wanted grows with the corpus.
        wanted = self.keys.join(members, "rep").hint("merge")
        # One text for each key: rows that repeat it lie together after the join.
        return (self.rows.join(wanted, ["id", "print"]).dropDuplicates(["id", "print"])
                .select("rep", "text"))

    def sketches(self, members: DataFrame, size: int) -> DataFrame:
        """(rep, n, sketch) of the classes in ``members``, with up to ``size`` values."""
        words = self.words

        def low(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(words)
            out = Emitter(pa.schema([("rep", pa.int64()), ("n", pa.int64()),
                                     ("sketch", pa.list_(pa.int64()))]))
            for rep, text in rows_of(batches, "rep", "text"):
                s = shingler.shingles(text)
                out.add((rep, len(s), _lowest(s, size)), 8 * size)
                if out.full:
                    yield out.batch()
            yield out.batch()

        return self.texts(members).mapInArrow(low, "rep long, n long, sketch array<bigint>")


def _estimate(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Share of the union's sketch that both sketches hold."""
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    distinct = np.cumsum(np.concatenate(([True], ~twice)))
    k = min(size, int(distinct[-1]))
    return int(np.count_nonzero(twice & (distinct[1:] <= k))) / k


def _estimated(pairs: DataFrame, sketches: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs whose union sketch gives an estimated similarity of at least ``least``."""
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            lv, lo = left.values.to_numpy(), left.offsets.to_numpy()
            rv, ro = right.values.to_numpy(), right.offsets.to_numpy()
            good = [_estimate(lv[lo[i]:lo[i + 1]], rv[ro[i]:ro[i + 1]], size) >= least
                    for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "sketch_b")
            .mapInArrow(keep, "a long, b long"))


def _verified(pairs: DataFrame, corpus: Corpus, percent: int, folder: str) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets.

    The texts of the members are written to ``folder`` and meet as texts, which compress;
    sets of 64-bit hashes are larger and do not.
    """
    spark, words = pairs.sparkSession, corpus.words
    members = stored(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(),
                     f"{folder}/reps", rows=2 * pairs.count())
    texts = stored(corpus.texts(members), f"{folder}/texts")
    drop_shuffles(spark)

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        last, y = None, None
        for batch in batches:
            good = []
            for b, left, right in rows_of([batch], "b", "left", "right"):
                x = shingler.shingles(left)
                # Pairs come in the order of b where the join sorts them.
                if b != last:
                    last, y = b, shingler.shingles(right)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("right"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
            .mapInArrow(check, "a long, b long"))


def _lists(classes: DataFrame, size: int, threshold: float, folder: str, most: int) -> DataFrame:
    """Inverted lists with more than one member: value, rep, n (set size), fame.

    ``classes`` has sketches of ``size`` values; ``most`` bounds their number.  ``fame`` is the
    summed length of the lists of a sketch: among near copies of a text the least changed ones
    have most.
    """
    retained = classes.select("rep", "n", F.size("sketch").alias("k"),
                              F.explode("sketch").alias("value"))
    # Values that a single class retains generate nothing; they come first in its order.
    sizes = stored(retained.groupBy("value").agg(F.count(F.lit(1)).alias("members"))
                   .filter("members > 1"), f"{folder}/sizes", rows=most * size // 2)
    drop_shuffles(classes.sparkSession)
    shared = stored(retained.join(sizes, "value").select("rep", "n", "k", "members", "value"),
                    f"{folder}/shared", rows=most * size)
    drop_shuffles(classes.sparkSession)
    # A sketch has at most ``size`` values, which bounds the arrays.
    ordered = shared.groupBy("rep", "n", "k").agg(
        F.sort_array(F.collect_list(F.struct("members", "value"))).alias("values"),
        F.sum("members").alias("fame"))
    # Similar sets differ in size by at most 1 / t, so below t * size both are kept whole.
    apart = F.when(F.col("n") <= math.floor(threshold * size), F.lit(1 - threshold)).otherwise(
        F.lit(1 - least_shared(size, threshold)))
    # floor(apart * k) + 1 places, those of its unshared values taken.
    places = F.floor(apart * F.col("k") + 1e-9) + 1 - (F.col("k") - F.size("values"))
    return (ordered.withColumn("places", places.cast("int")).filter("places > 0")
            .select("rep", "n", "fame",
                    F.explode(F.slice("values", F.lit(1), F.col("places"))).alias("v"))
            .select("v.value", "rep", "n", "fame"))


def _open_lists(lists: DataFrame, edges: DataFrame | None, folder: str, most: int) -> DataFrame:
    """Members of the lists that are not all connected: value, rep, n, fame, part, top.

    ``part`` is the component so far and ``top`` the part with most members in the list;
    ``most`` is the number of members in all lists; ``size`` and ``others`` count the members
    of the list and those outside ``top``.
    """
    if edges is None:
        return lists.withColumn("part", F.col("rep")).withColumn("top", F.lit(None).cast("long"))
    labels = connected(edges, f"{folder}/parts").select(
        F.col("node").alias("rep"), F.col("component").alias("part"))
    placed = stored(lists.join(labels, "rep", "left").withColumn(
        "part", F.coalesce("part", "rep")), f"{folder}/placed", rows=most)
    tops = stored(placed.groupBy("value", "part").agg(F.count(F.lit(1)).alias("size"))
                  .groupBy("value").agg(F.max(F.struct("size", "part")).alias("top"),
                                        F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"))
                  .filter("parts > 1").select("value", F.col("top.part").alias("top"), "size",
                                              (F.col("size") - F.col("top.size")).alias("others")),
                  f"{folder}/tops", rows=most // 2)
    return stored(placed.join(tops, "value"), f"{folder}/open", rows=most, width=64)


def _pivot_pairs(members: DataFrame, folder: str, most: int) -> DataFrame:
    """Pairs of each member with two pivots of its list, where parts differ: a, b, sizes.

    The pivots are the member with most fame and one drawn by a hash, outside the list's
    largest part where that is known.
    """
    famous = F.max(F.struct("fame", "rep", "n", "part"))
    drawn = F.struct(F.xxhash64("rep", "value").alias("h"), "rep", "n", "part")
    drawn = F.min(F.when(F.col("top").isNull() | (F.col("part") != F.col("top")), drawn))
    pivots = stored(members.groupBy("value").agg(famous.alias("x"), drawn.alias("y")).select(
        "value", F.array(F.struct("x.rep", "x.n", "x.part"), F.struct("y.rep", "y.n", "y.part"))
        .alias("pivots")), f"{folder}/pivots", rows=most // 2, width=64)
    return (members.join(pivots, "value")
            .select("rep", F.col("n").alias("n_a"), "part", F.explode("pivots").alias("p"))
            .filter("part <> p.part")
            .select(F.col("rep").alias("a"), "n_a", F.col("p.rep").alias("b"),
                    F.col("p.n").alias("n_b")))


def _short_pairs(members: DataFrame) -> DataFrame:
    """Members outside a short list's largest part, with every member of another part."""
    members = members.filter(F.col("size") <= LONG_LIST)
    left, right = (members.select("value", F.col("rep").alias(x), F.col("n").alias(f"n_{x}"),
                                  F.col("part").alias(f"part_{x}"),
                                  (F.col("part") == F.col("top")).alias(f"top_{x}"))
                   for x in ("a", "b"))
    return (left.filter("not top_a").join(right, "value")
            .filter("part_a <> part_b and (top_b or a < b)").select("a", "n_a", "b", "n_b"))


def _compared(left: list[tuple], right: list[tuple], percent: int, size: int,
              least: float) -> Iterator[tuple]:
    """(a, b, sure) between two blocks of rows (rep, n, part, sketch).

    Sketches that hold their whole sets decide a pair, and of two parts one sure link is
    enough; other pairs that may be similar are left to be verified.
    """
    a, b = ({k: np.array([r[i] for r in rows]) for i, k in enumerate(("rep", "n", "part"))}
            for rows in (left, right))
    n_a, n_b = a["n"][:, None], b["n"][None, :]
    open_ = (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)
    open_ &= a["part"][:, None] != b["part"][None, :]
    if not open_.any():
        return
    shared = _overlaps([r[3] for r in left], [r[3] for r in right])
    k_a, k_b = (np.array([len(r[3]) for r in side]) for side in (left, right))
    whole = (n_a <= size) & (n_b <= size)
    sure = whole & (100 * shared >= percent * (n_a + n_b - shared))
    perhaps = ~whole & (shared >= least * np.minimum(k_a[:, None], k_b[None, :]))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    for i, j in zip(*np.nonzero(open_ & sure)):
        x, y = find(left[i][2]), find(right[j][2])
        if x != y:
            parent[x] = y
            yield left[i][0], right[j][0], True
    for i, j in zip(*np.nonzero(open_ & perhaps)):
        if (find(left[i][2]) != find(right[j][2])
                and _estimate(left[i][3], right[j][3], size) >= least):
            yield left[i][0], right[j][0], False


def _overlaps(left: list, right: list) -> np.ndarray:
    """Numbers of values that each pair of sets shares."""
    flat = np.concatenate([np.asarray(s, dtype=np.int64) for s in (*left, *right)])
    found, at = np.unique(flat, return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    # Values of one set only cannot be shared.
    kept = np.flatnonzero(np.bincount(at, minlength=len(found)) > 1)
    place = np.full(len(found), -1)
    place[kept] = np.arange(len(kept))
    at = place[at]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    # Some values at a time, so that the table of rows and values stays small.
    for start in range(0, len(kept), 4096):
        use = (at >= start) & (at < start + 4096)
        table = np.zeros((len(left) + len(right), 4096), dtype=np.float32)
        table[rows[use], at[use] - start] = 1
        out += table[:len(left)] @ table[len(left):].T
    return out


def _long_list_pairs(members: DataFrame, classes: DataFrame, size: int, percent: int, least: float,
                     folder: str, most: int) -> DataFrame:
    """Pairs (a, b, sure) of long lists between parts, found block by block.

    Lists that share their most famous member hold much the same classes, so they form one
    table in which each class is once.
    """
    long = members.filter(F.col("size") > LONG_LIST)
    pivots = long.groupBy("value").agg(F.max(F.struct("fame", "rep")).alias("x")).select(
        "value", F.col("x.rep").alias("pivot"))
    tables = stored(long.join(pivots, "value").select("pivot", "rep", "n", "part").distinct(),
                    f"{folder}/tables", rows=most)
    sizes = stored(tables.groupBy("pivot").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), f"{folder}/blocks", rows=most)
    full = (tables.join(sizes, "pivot").join(classes.select("rep", "sketch"), "rep")
            .withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
            # Block i meets block j for every i <= j.
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .withColumn("side", F.when(F.col("own") <= F.col("other"), 0).otherwise(1)))
    wanted = ["pivot", "i", "j", "side", "rep", "n", "part", "sketch"]
    meeting = (full.select(*wanted).repartition("pivot", "i", "j")
               .sortWithinPartitions("pivot", "i", "j", "side"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())]))
        place, sides = None, ([], [])

        def finish() -> Iterator[pa.RecordBatch]:
            if place is not None and sides[0]:
                same = place[1] == place[2]
                for a, b, sure in _compared(sides[0], sides[0] if same else sides[1], percent, size, least):
                    out.add((min(a, b), max(a, b), sure))
                    if out.full:
                        yield out.batch()

        for pivot, i, j, side, rep, n, part, sketch in rows_of(batches, *wanted):
            if (pivot, i, j) != place:
                yield from finish()
                place, sides = (pivot, i, j), ([], [])
            sides[side].append((rep, n, part, np.array(sketch, dtype=np.int64)))
        yield from finish()
        yield out.batch()

    return stored(meeting.mapInArrow(compare, "a long, b long, sure boolean").distinct(),
                  f"{folder}/long-pairs")


def _class_links(classes: DataFrame, corpus: Corpus, folder: str, most: int,
                 threshold: float) -> DataFrame:
    """Edges (a, b) between classes that leave similar ones connected."""
    percent = round(100 * threshold)
    fit = ((100 * F.col("n_a") >= percent * F.col("n_b"))
           & (100 * F.col("n_b") >= percent * F.col("n_a")))
    edges = None
    for level, size in enumerate(SKETCHES):
        least = least_shared(size, threshold)
        place = f"{folder}/level-{level}"
        lists = stored(_lists(classes, size, threshold, place, most), f"{place}/lists",
                       rows=most * size // 2)
        spark = lists.sparkSession
        for used in ("sizes", "shared"):
            remove(spark, f"{place}/{used}")
        drop_shuffles(spark)
        listed = lists.count()
        if not listed:
            break
        for name in ("pivots", "rest"):
            at = f"{place}/{name}"
            members = _open_lists(lists, edges, at, listed)
            pairs = _pivot_pairs(members, at, listed) if name == "pivots" else _short_pairs(members)
            pairs = pairs.filter(fit).select(
                F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            likely = stored(_estimated(pairs, classes, size, least), f"{at}/likely",
                            rows=listed * (2 if name == "pivots" else LONG_LIST))
            drop_shuffles(spark)
            links = stored(_verified(likely, corpus, percent, f"{at}/members"), f"{at}/links",
                           rows=likely.count())
            edges = links if edges is None else edges.unionByName(links)
            remove(spark, f"{at}/members")
            drop_shuffles(spark)
        left = stored(members.filter(F.col("size") > LONG_LIST).select("rep").distinct(),
                      f"{place}/left", rows=most)
        most = left.count()
        if not most:
            break
        if size != SKETCHES[-1]:
            classes = stored(corpus.sketches(left, SKETCHES[level + 1]), f"{place}/classes", rows=most,
                             width=8 * SKETCHES[level + 1])
            drop_shuffles(spark)
            continue
        pairs = _long_list_pairs(members, classes, size, percent, least, place, listed)
        drop_shuffles(spark)
        unsure = stored(pairs.filter("not sure").select("a", "b"), f"{place}/unsure")
        edges = (edges.unionByName(pairs.filter("sure").select("a", "b"))
                 .unionByName(_verified(unsure, corpus, percent, f"{place}/unsure-members")))
        edges = stored(edges, f"{place}/edges")
        remove(spark, f"{place}/unsure-members")
    return edges if edges is not None else classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, threshold: float = THRESHOLD,
                    folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    The tables of the passes are written to ``folder``, a new one by default.
    """
    folder = folder or run_folder(docs.sparkSession, "near")
    # The print tells apart the texts of one id.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(
        "print", F.xxhash64("text"))
    size = SKETCHES[0]
    light = stored(rows.mapInArrow(
        lambda b: _sketches(b, words, size),
        "id long, print long, n long, sig_a long, sig_b long, sketch array<bigint>"), f"{folder}/sketches")
    most = light.count()
    same = ["sig_a", "sig_b", "n"]
    sketched = light.filter("n > 0 and id is not null")
    light = stored(light.drop("sketch"), f"{folder}/light", rows=most, width=40)
    linkable = light.filter("n > 0 and id is not null")
    # Classes are numbered: one id may stand for several sets.
    reps = stored(linkable.groupBy(*same).agg(F.min(F.struct("id", "print")).alias("key"))
                  .select(*same, "key.*").withColumn("rep", F.monotonically_increasing_id()),
                  f"{folder}/reps", rows=most, width=64)
    keys = reps.select("rep", "id", "print")
    classes = stored(sketched.select("id", "print", "sketch").join(reps, ["id", "print"])
                     .dropDuplicates(["id", "print"]).select("rep", "n", "sketch"), f"{folder}/classes",
                     rows=most, width=8 * size)
    remove(docs.sparkSession, f"{folder}/sketches")
    drop_shuffles(docs.sparkSession)
    edges = _class_links(classes, Corpus(rows, keys, words), folder, most, threshold)
    # The sets of one id belong together: each is joined to the lowest.
    of_id = linkable.join(reps.select(*same, "rep"), same).groupBy("id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last")
    several = linkable.join(reps.select(*same, "rep"), same).join(of_id, "id").filter("rep > a").select(
        "a", F.col("rep").alias("b")).distinct()
    edges = stored(edges.unionByName(several), f"{folder}/edges")
    final = connected(edges, f"{folder}/final")
    placed = stored(reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        *same, "id", F.coalesce("component", "rep").alias("component")), f"{folder}/placed", rows=most, width=64)
    lowest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = stored(placed.join(lowest, "component").select(*same, "component_id"), f"{folder}/of-class",
                      rows=most, width=64)
    return light.select("id", *same).join(of_class, same, "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
