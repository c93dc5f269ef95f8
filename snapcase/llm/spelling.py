"""Spelling variants of words by k-d trees over letter-count vectors.

Words one edit apart have letter counts close together: a replaced letter moves one count down
by one and another up, and the lengths are equal; a deleted letter moves one count down.  For
each pair of lengths a word is a box around its vector, and a k-d tree over the vectors prunes
the boxes that miss a subtree.  Every pair is asked for from one side: by the longer word, or
of equal lengths by the word whose letter of the two comes first.

1. Words and their counts are gathered with partial sums in every task.
2. A tree over a bounded sample of the vectors cuts the space into leaves of about
   ``LEAF_WORDS`` words.  Every word goes to its own leaf and, as a query, to each leaf that
   its boxes touch.  A leaf with more words or queries than fit one task is cut into a grid.
   The sample bounds only the tree's balance: all words are indexed.
3. In a task a second tree over the leaf's vectors finds the vectors within the radius.  The
   order of letters is verified without comparing all words of two vectors: both sides are
   looked up by the place of the edit and the rest of the word, then compared letter by letter.
4. A word's form is its near word of largest count, if at least ``RATIO`` times its own.
   Counts at least double along forms, so a few rounds of pointer doubling reach the root.

Rows: a null or empty text has no words; a null id counts as the text ``null`` in the hash
that picks letters to drop; rows that repeat an id count each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, rows_of, run_folder, stored

MIN_LETTERS = 5
MIN_COUNT = 3
# A run drops a letter where this divides its hash.
DROP_EVERY = 97
RATIO = 2
# Words of a leaf, sampled vectors for each leaf, and the most leaves of the upper tree.
LEAF_WORDS = 65_536
SAMPLE_OF_LEAF = 64
MAX_LEAVES = 4096
# Vectors of a leaf of the tree inside a task, and queries that descend it at once.
BUCKET = 64
BATCH = 4096
# Queries that a task answers at once.
ASKED = 4 * BATCH
# Pairs of vectors that meet before their words are compared.
MET = 1 << 18
# Distinct words that a map task counts before it hands them on.
HELD_WORDS = 200_000
# Products of the letter counts of shorter words are exact in single precision.
_EXACT_LETTERS = 2048

# Runs of lower-cased text; shorter ones cannot be words, whether they lose a letter or not.
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LETTERS)
# Letters are a-z, then U+00C0-U+00FF; the column after them holds the length.
LETTERS = 26 + 64
_LENGTH = LETTERS
_BASE = 0x9E3779B97F4A7C15


def edited(doc_hash: int, run: str) -> str:
    """The run, or the run without one letter where the hash of document and run says so.

    ``doc_hash`` is the hash up to the run, so a document's id is hashed once.
    """
    h = zlib.crc32(run.encode(), doc_hash)
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for doc, text in rows_of(batches, "id", "text"):
        doc_hash = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
        # Lower-casing bytes changes A-Z only.  Equal runs of one document have the same hash, so
        # they are edited alike.
        for run, n in Counter(_RUN.findall((text or "").encode().lower().decode())).items():
            if len(word := edited(doc_hash, run)) >= MIN_LETTERS:
                held[word] += n
        if len(held) >= HELD_WORDS:
            yield flush()
    yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(_counted, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT))


class Words:
    """Words of one table in flat arrays: letters, vectors and hashes without one letter."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        self.letters = np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(words)), self.lengths)
        self.place = np.arange(len(codes)) - self.starts[self.owner]

    def vectors(self) -> np.ndarray:
        """Letter counts, and the length in the last column."""
        width = LETTERS + 1
        out = np.bincount(self.owner * width + self.letters, minlength=len(self.words) * width)
        out = out.reshape(-1, width).astype(np.int32)
        out[:, _LENGTH] = self.lengths
        return out

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct vectors and, for each word, the number of its own.

        Words are sorted by a hash of their letters in any order.  Vectors of equal hashes are
        compared, so different ones are told apart; one of them may then be listed twice.
        """
        terms = mix64(self.letters.astype(np.uint64) + np.uint64(1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
        sums = sums[self.starts + self.lengths] - sums[self.starts]
        order = np.argsort(sums)
        sums, vectors = sums[order], self.vectors()[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (sums[1:] != sums[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
        kind = np.empty(len(order), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        return vectors[new], kind

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the whole words and, for each letter, of its word without it."""
        longest = int(self.lengths.max(initial=0)) + 2
        power, back = (np.full(longest, b & (2**64 - 1), dtype=np.uint64)
                       for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        power[0] = 1
        power = np.cumprod(power)
        terms = mix64(self.letters.astype(np.uint64) + np.uint64(1)) * power[self.place]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
        first, last = sums[self.starts], sums[self.starts + self.lengths]
        whole = last - first
        own = np.arange(len(self.letters))
        before = sums[own] - first[self.owner]
        after = (last[self.owner] - sums[own + 1]) * back[0]
        return whole, before + after


class Tree:
    """A k-d tree over letter counts and lengths, as nested tuples.

    A node is (column, bound, left, right), rows at most the bound go left; a leaf is its
    number.
    """

    def __init__(self, vectors: np.ndarray, size: int):
        self.rows: list[np.ndarray] = []
        self.root = self._grow(vectors, np.arange(len(vectors)), size)

    def _grow(self, vectors: np.ndarray, rows: np.ndarray, size: int):
        if len(rows) > size:
            x = vectors[rows]
            best = None
            for column in np.flatnonzero(x.min(axis=0) < x.max(axis=0)):
                values = x[:, column]
                bound = int(np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2])
                for b in (bound - 1, bound):
                    uneven = abs(2 * int(np.count_nonzero(values <= b)) - len(values))
                    if uneven < len(values) and (best is None or uneven < best[0]):
                        best = (uneven, int(column), b)
            if best:
                left = vectors[rows, best[1]] <= best[2]
                return (best[1], best[2], self._grow(vectors, rows[left], size),
                        self._grow(vectors, rows[~left], size))
        self.rows.append(rows)
        return len(self.rows) - 1

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector lies in."""
        out = np.zeros(len(vectors), dtype=np.int64)
        work = [(self.root, np.arange(len(vectors)))]
        while work:
            node, rows = work.pop()
            if isinstance(node, int):
                out[rows] = node
            else:
                left = vectors[rows, node[0]] <= node[1]
                work += [(node[2], rows[left]), (node[3], rows[~left])]
        return out

    def touched(self, vectors: np.ndarray, shorter: int,
                once: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) whose boxes reach the leaf: words ``shorter`` letters shorter by a letter.

        The other word has one letter less of a kind and, unless it is shorter, one more of
        another, so the box reaches one letter down and at most one up; the length must be exact.
        With ``once`` the letter gained must come after the one lost, so that of two words of
        equal length only one reaches the other.
        """
        lost = np.full(len(vectors), -1, dtype=np.int8)
        gained = np.full(len(vectors), LETTERS, dtype=np.int8)
        yield from self._reach(self.root, vectors, np.arange(len(vectors)), lost, gained, shorter, once)

    def _reach(self, node, vectors, rows, lost, gained, shorter, once):
        """``lost`` and ``gained``: the letters in which the node lies outside the rows' vectors.

        They are -1 and ``LETTERS`` as long as there is none.
        """
        if not len(rows):
            return
        if isinstance(node, int):
            yield node, rows
            return
        column, bound, left, right = node
        x = vectors[rows, column]
        if column == _LENGTH:
            goes = x - shorter <= bound
            for child, good in ((left, goes), (right, ~goes)):
                yield from self._reach(child, vectors, rows[good], lost[good], gained[good], shorter, once)
            return
        less = x > bound
        good = ~less | ((x == bound + 1) & (lost < 0) & (gained > column if once else True))
        yield from self._reach(left, vectors, rows[good], np.where(less, np.int8(column), lost)[good],
                               gained[good], shorter, once)
        more = x <= bound
        good = ~more
        if not shorter:
            good |= (x == bound) & (gained == LETTERS) & (lost < column if once else True)
        yield from self._reach(right, vectors, rows[good], lost[good],
                               np.where(more, np.int8(column), gained)[good], shorter, once)


def _routes(batches: Iterable[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """(leaf, side, word, n): each word in its own leaf (side 0) and as a query (side 1)."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            vectors = Words(part.column(0).to_pylist()).vectors()
            leaves, sides, rows = [tree.own(vectors)], [np.zeros(len(vectors))], [np.arange(len(vectors))]
            for shorter in (0, 1):
                for leaf, found in tree.touched(vectors, shorter, once=True):
                    leaves.append(np.full(len(found), leaf))
                    sides.append(np.full(len(found), 1 + shorter))
                    rows.append(found)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(leaves).astype(np.int32)),
                 pa.array(np.concatenate(sides).astype(np.int32)),
                 part.column(0).take(at), part.column(1).take(at)], names=["leaf", "side", "word", "n"])


class Leaf:
    """The words of a task: a tree over their distinct vectors, and lookups by edit."""

    def __init__(self, words: list[str], counts: list[int]):
        self.table, self.counts = Words(words), counts
        self.points, self.point_of = self.table.kinds()
        self.used = np.flatnonzero(self.points[:, :LETTERS].any(axis=0))
        self.tree = Tree(self.points, BUCKET)
        inside = self.points[:, self.used].astype(np.float64)
        # A query's (2 * counts, 1, -rest) times this is 0 at the distance asked for.
        against = np.column_stack((inside, -(inside * inside).sum(axis=1), np.ones(len(inside))))
        self.long = int(self.table.lengths.max(initial=0)) >= _EXACT_LETTERS
        kind = np.float64 if self.long else np.float32
        self.against = [against[rows].astype(kind).T for rows in self.tree.rows]
        self.sums = _letter_sums(self.points)
        whole, without = self.table.hashes()
        # Replaced letters: (vector, place, rest of the word); deleted ones: (vector, word).
        owner = self.table.owner
        self.by_edit = _lists(_key(self.point_of[owner], self.table.place + 1, without), owner)
        self.by_word = _lists(_key(self.point_of, 0, whole), np.arange(len(words)))

    def near(self, words: list[str], shorter: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs, as positions, that are one edit apart.

        Of two words of equal length the one whose letter comes first finds the other.
        """
        table = Words(words)
        vectors, vector_of = table.kinds()
        _, without = table.hashes()
        # Places of each letter of the words of a vector; of a run of one letter the first will
        # do where it goes.
        first = np.ones(len(table.letters), dtype=bool)
        if shorter:
            first[1:] = (table.letters[1:] != table.letters[:-1]) | (table.place[1:] == 0)
        order = np.flatnonzero(first)
        column = vector_of[table.owner[order]] * LETTERS + table.letters[order]
        order = order[np.argsort(column)]
        ends = np.cumsum(np.bincount(column, minlength=len(vectors) * LETTERS))
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
        # Lengths decide how far counts are apart, so differences of one are alike in L1 and L2.
        counts = vectors[:, :LETTERS].astype(np.float64)
        rest = (2 - shorter) - (counts * counts).sum(axis=1)
        asked = np.column_stack((2 * counts[:, self.used], np.ones(len(counts)), rest))
        wide = self.long or int(table.lengths.max(initial=0)) >= _EXACT_LETTERS
        asked = asked.astype(np.float64 if wide else np.float32)
        sums = _letter_sums(vectors)
        met, size = [], 0
        for leaf, rows in self.tree.touched(vectors, shorter, once=True):
            held = self.tree.rows[leaf]
            at = np.flatnonzero(asked[rows] @ self.against[leaf] == 0)
            if len(at):
                met.append((rows[at // len(held)], held[at % len(held)]))
                size += len(at)
                if size >= MET:
                    yield from self._verified(met, table, vectors, sums, shorter, order, starts, ends, without)
                    met, size = [], 0
        if met:
            yield from self._verified(met, table, vectors, sums, shorter, order, starts, ends, without)

    def _verified(self, met, table, vectors, sums, shorter, order, starts, ends, without):
        """The pairs of words one edit apart among those of the vectors that ``met``.

        ``order`` lists the places in all words by vector and letter, from ``starts`` to ``ends``.
        """
        i, j = (np.concatenate(side) for side in zip(*met))
        # Equal lengths: letter l of the query against g gives sums of l - g and of l^2 - g^2.
        one, two = (sums[k][i] - self.sums[k][j] for k in (0, 1))
        good = self.points[j, _LENGTH] == vectors[i, _LENGTH] - shorter
        if not shorter:
            good &= one < 0
        i, j, one, two = i[good], j[good], one[good], two[good]
        if not len(i):
            return
        column = i * LETTERS + (one if shorter else (one + two // one) // 2)
        first, size = starts[column], ends[column] - starts[column]
        at = order[_ranges(first, size)]
        point = np.repeat(j, size)
        if shorter:
            keys, (known, first, last, targets) = _key(point, 0, without[at]), self.by_word
        else:
            keys, (known, first, last, targets) = _key(point, table.place[at] + 1, without[at]), self.by_edit
        found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = np.flatnonzero(known[found] == keys)
        at, found = at[hit], found[hit]
        size = last[found] - first[found]
        other = targets[_ranges(first[found], size)]
        at = np.repeat(at, size)
        query = table.owner[at]
        good = np.array([_one_edit(table.words[q], self.table.words[w], p, shorter) for q, w, p in
                         zip(query.tolist(), other.tolist(), table.place[at].tolist())], dtype=bool)
        yield query[good], other[good]


def _letter_sums(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the letters of a vector's words: of their numbers and of the squares of these."""
    letters = np.arange(LETTERS, dtype=np.float64)
    counts = vectors[:, :LETTERS].astype(np.float64)
    return (counts @ letters).astype(np.int64), (counts @ (letters * letters)).astype(np.int64)


def _one_edit(query: str, word: str, place: int, shorter: int) -> bool:
    rest = query[:place] + query[place + 1:]
    return rest == word if shorter else rest == word[:place] + word[place + 1:] and query != word


def _key(point, place, rest: np.ndarray) -> np.ndarray:
    mixed = mix64((np.asarray(point) * 1_000_003 + place).astype(np.uint64))
    return mix64(rest ^ mixed)


def _lists(keys: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, where the targets of each start and end, and the targets."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), keys[1:] != keys[:-1])))
    return keys[first], first, np.append(first[1:], len(keys)), targets[order]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions first .. first + size - 1 of every range, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


_PLACED = ("leaf", "d", "q", "side", "word", "n")


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a leaf, then its queries, to (word, n_near, best n, best word) of the pairs found."""
    place, words, counts, leaf = None, [], [], None
    asked: dict[int, tuple[list[str], list[int]]] = {1: ([], []), 2: ([], [])}

    def answer() -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def note(word: str, other: str, n: int) -> None:
            best = found.get(word)
            if best is None:
                found[word] = [1, n, other]
            else:
                best[0] += 1
                if (n, best[2]) > (best[1], other) if n == best[1] else n > best[1]:
                    best[1:] = n, other

        for shorter in (0, 1):
            queries, ns = asked[1 + shorter]
            if queries:
                # Every pair is found once, so both words take note of it.
                for q, w in leaf.near(queries, shorter):
                    for a, b in zip(q.tolist(), w.tolist()):
                        note(queries[a], words[b], counts[b])
                        note(words[b], queries[a], ns[a])
            asked[1 + shorter] = [], []
        if found:
            columns = [list(found), *map(list, zip(*found.values()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        # Rows of one cell and side lie together.
        cells = np.column_stack([batch.column(k).to_numpy() for k in range(len(_PLACED) - 2)])
        starts = np.append(0, np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1)
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]):
            *cell, side = cells[start].tolist()
            if cell != place:
                yield from answer()
                place, words, counts, leaf = cell, [], [], None
            if side and not words:
                continue
            to = asked[side] if side else (words, counts)
            for k, column in enumerate((batch.column(4), batch.column(5))):
                to[k].extend(column.slice(start, end - start).to_pylist())
            if side:
                leaf = leaf or Leaf(words, counts)
                if sum(len(asked[k][0]) for k in asked) >= ASKED:
                    yield from answer()
    yield from answer()


def near_words(words: DataFrame, folder: str, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of every word (word, n) with a word one edit away."""
    spark = words.sparkSession
    total = words.count()
    cores = spark.sparkContext.defaultParallelism
    leaves = min(MAX_LEAVES, max(1, math.ceil(total / leaf_words), min(cores, total // 2000)))
    sample = [r.word for r in words.orderBy(F.xxhash64("word"), "word").select("word")
              .limit(leaves * SAMPLE_OF_LEAF).collect()]
    vectors = Words(sample).vectors()
    tree = Tree(vectors, max(1, len(sample) // leaves))
    routed = stored(words.mapInArrow(lambda b: _routes(b, tree), "leaf int, side int, word string, n long"),
                    f"{folder}/routed")
    # A leaf's words are cut into d parts and its queries into q; at most MAX_LEAVES rows of sizes.
    sizes = stored(routed.groupBy("leaf").agg(
        F.ceil(F.count_if(F.col("side") == 0) / (2 * leaf_words)).cast("int").alias("ds"),
        F.ceil(F.count_if(F.col("side") > 0) / (16 * leaf_words)).cast("int").alias("qs")), f"{folder}/sizes")
    cells = sizes.agg(F.sum(F.greatest(F.lit(1), "ds") * F.greatest(F.lit(1), "qs"))).first()[0] or 1
    own_d, own_q = (F.pmod(F.xxhash64("word"), F.greatest(F.lit(1), c)).cast("int") for c in ("ds", "qs"))
    every_d, every_q = (F.sequence(F.lit(0), F.greatest(F.lit(1), c) - 1) for c in ("ds", "qs"))
    placed = (routed.join(F.broadcast(sizes), "leaf")
              .withColumn("d", F.explode(F.when(F.col("side") == 0, F.array(own_d)).otherwise(every_d)))
              .withColumn("q", F.explode(F.when(F.col("side") == 0, every_q).otherwise(F.array(own_q)))))
    met = (placed.select(*_PLACED).repartition(int(2 * cells), "leaf", "d", "q")
           .sortWithinPartitions("leaf", "d", "q", "side"))
    found = met.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("f")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("f.m")).alias("best_n"), F.col("f.best").alias("best"))


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   leaf_words: int = LEAF_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    folder = run_folder(docs.sparkSession, "spelling")
    words = stored(word_counts(docs, id_col, text_col), f"{folder}/words")
    near = near_words(words, folder, leaf_words)
    has = F.col("best_n") >= RATIO * F.col("n")
    forms = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")),
        f"{folder}/forms")
    # Counts double along a chain of forms, which bounds its length by the largest count.
    most = forms.agg(F.max("n").alias("n")).first().n or 1
    steps = math.ceil(math.log(max(RATIO, most / MIN_COUNT), RATIO))
    pointer = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for turn in range(math.ceil(math.log2(steps + 1))):
        pointer = stored(pointer, f"{folder}/roots-{turn}")
        further = pointer.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        pointer = pointer.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"))
    return forms.join(pointer, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
