"""Collocations from a weighted de Bruijn graph of the longest phrases.

Nodes of the graph are phrases of three words, its edges phrases of four that overlap in
them.  Every word of a piece is the start of one row: the edge of four words or, within the
last three words, the shorter phrase up to the piece's end.

1. Map tasks fold the rows of a few megabytes of text, number their words locally and hand
   on one packed block for each language and group of edges (a hash of the first two words).
2. A task merges the blocks of a group, word for word, so counts are exact.  All edges out of
   a node lie in its group, so shorter counts follow from the flow out of it without another
   shuffle: a phrase occurs as often as the longer ones it starts, plus its piece ends.  A
   group too large for a task is cut by the whole edge; its sums are then added up.
3. Edges that are each other's only neighbour at a node (all three counts are equal) are
   compacted to paths by pointer doubling.  A path stands for a passage of any length; the
   phrases inside it are listed once, not once for each edge.
4. Candidates are phrases of two to four words that are frequent.  Each gets its lowest
   scoring cut and is dropped where a longer one that holds it is nearly as frequent.

Rows: a null text is empty; a null language is ``und``; rows that repeat an id count each;
texts without words give nothing; an empty table gives an empty result; other columns are
ignored.  Words hold any character but those that end words or pieces.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Emitter, mix64, rows_of, run_folder, stored

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
# A phrase goes where a longer one that holds it has this share of its count, in percent.
HELD_PERCENT = 80
SCALE = 2_000_000
# Bytes of text that a map task folds at once, and that a group of edges stands for.
FLUSH_BYTES = 4 << 20
GROUP_BYTES = 6 << 20
# Edges of a group beyond which it is cut, and the edges of a part.
MOST_EDGES = 4 << 20
PART_EDGES = 1 << 20

# A-Z in lower case, all piece ends to a full stop, which no word can hold.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t",
                         bytes(range(97, 123)) + b"." * 9 + b" ")
_BLOCK = "grp int, part int, whole boolean, lang string, edges long, block binary"
_BLOCK_ARROW = pa.schema([("grp", pa.int32()), ("part", pa.int32()), ("whole", pa.bool_()),
                          ("lang", pa.string()), ("edges", pa.int64()), ("block", pa.binary())])
_COUNT = "lang string, k int, phrase string, f long"


class _Numbers(dict):
    """Numbers of words in order of appearance; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _folded(columns: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of four columns, in order, and their summed counts."""
    order = np.lexsort(columns[::-1])
    columns = columns[:, order]
    first = np.ones(columns.shape[1], dtype=bool)
    first[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    starts = np.flatnonzero(first)
    if n is None:
        sums = np.diff(np.append(starts, columns.shape[1]))
    else:
        sums = np.add.reduceat(n[order], starts) if len(starts) else n[:0]
    return columns[:, starts], sums.astype(np.int64)


def text_edges(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, and the distinct rows (four columns of word numbers, 0 past the end) with counts."""
    tokens = b" . ".join(t.translate(_PLAIN).replace(b".", b" . ") for t in texts).split()
    numbers = _Numbers({b".": 0})
    ids = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens))
    ids = np.append(ids, np.zeros(LONGEST, dtype=np.int32))
    at = np.flatnonzero(ids)
    columns = np.empty((LONGEST, len(at)), dtype=np.int32)
    columns[0] = ids[at]
    for i in range(1, LONGEST):
        columns[i] = np.where(columns[i - 1] > 0, ids[at + i], 0)
    columns, n = _folded(columns)
    return list(numbers), columns, n


def _small(values: np.ndarray) -> np.ndarray:
    most = int(values.max(initial=0))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)
    return values.astype(kind)


def _packed(words: list[bytes], columns: np.ndarray, n: np.ndarray) -> bytes:
    """The rows with only their own words, renumbered, as compressed columns."""
    used = np.unique(columns)
    used = used[used > 0]
    local = np.where(columns > 0, np.searchsorted(used, columns) + 1, 0)
    # Rows are in order, so the first column goes as differences.
    parts = [_small(x) for x in (np.diff(local[0], prepend=0), *local[1:], n)]
    names = b"\n".join(words[i] for i in used.tolist())
    head = struct.pack("<qq5b", len(names), len(n), *(p.dtype.itemsize for p in parts))
    return zstandard.compress(head + names + b"".join(p.tobytes() for p in parts), 1)


def _unpacked(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = zstandard.decompress(block)
    size, rows, *widths = struct.unpack_from("<qq5b", raw)
    at = struct.calcsize("<qq5b")
    words = [b".", *raw[at:at + size].split(b"\n")]
    at += size
    parts = []
    for width in widths:
        part = np.frombuffer(raw, dtype=f"<u{width}", count=rows, offset=at)
        parts.append(part.astype(np.int32 if len(parts) < LONGEST else np.int64))
        at += rows * width
    parts[0] = np.cumsum(parts[0], dtype=np.int32)
    return words, np.array(parts[:LONGEST]), parts[LONGEST]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    out = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    out[0] = 0
    return out


def _blocks(lang: str, words: list[bytes], columns: np.ndarray, n: np.ndarray, place: np.ndarray,
            ) -> Iterator[tuple[int, int, bytes]]:
    """(place, rows, block) of the rows of each place."""
    order = np.argsort(place, kind="stable")
    place, columns, n = place[order], columns[:, order], n[order]
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    for start, end in zip(cuts, np.append(cuts[1:], len(place))):
        yield int(place[start]), int(end - start), _packed(words, columns[:, start:end], n[start:end])


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _map(batches: Iterable[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    out = Emitter(_BLOCK_ARROW)
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> None:
        words, columns, n = text_edges(held.pop(lang))
        del size[lang]
        if not len(n):
            return
        h = _word_hashes(words)
        start = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        place = mix64(mix64(h[columns[0]] ^ start) + h[columns[1]]) % np.uint64(groups)
        for grp, rows, block in _blocks(lang, words, columns, n, place.astype(np.int64)):
            out.add((grp, 0, True, lang, rows, block), len(block))

    for lang, text in rows_of(_slices(batches), "lang", "text"):
        raw = (text or "").encode()
        held.setdefault(lang, []).append(raw)
        size[lang] = size.get(lang, 0) + len(raw) + 1
        if size[lang] >= FLUSH_BYTES:
            flush(lang)
        elif sum(size.values()) >= 2 * FLUSH_BYTES:
            flush(max(size, key=size.get))
        if out.full:
            yield out.batch()
    for lang in list(held):
        flush(lang)
        if out.full:
            yield out.batch()
    yield out.batch()


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of groups that are too large, cut by a hash of the whole edge."""
    out = Emitter(_BLOCK_ARROW)
    for grp, lang, block, parts in rows_of(batches, "grp", "lang", "block", "parts"):
        words, columns, n = _unpacked(block)
        h = _word_hashes(words)
        mixed = np.zeros(len(n), dtype=np.uint64)
        for column in columns:
            mixed = mix64(mixed + h[column] + np.uint64(1))
        for part, rows, piece in _blocks(lang, words, columns, n, (mixed % np.uint64(parts)).astype(np.int64)):
            out.add((grp, part, False, lang, rows, piece), len(piece))
        if out.full:
            yield out.batch()
    yield out.batch()


def _merge(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (grp, part, lang) to counts of their phrases of one to four words."""
    place, numbers = None, _Numbers({b".": 0})
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def finish() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        columns, n = np.concatenate([c for c, _ in held], axis=1), np.concatenate([x for _, x in held])
        held.clear()
        columns, n = _folded(columns, n)
        words = list(numbers)
        lang, whole = place[2], place[3]
        changed = np.ones(columns.shape[1], dtype=bool)
        differs = np.zeros(columns.shape[1] - 1, dtype=bool)
        for k in range(1, LONGEST + 1):
            # A phrase of k words occurs as often as the rows that start with it.
            differs = differs | (columns[k - 1, 1:] != columns[k - 1, :-1])
            changed[1:] = differs
            starts = np.flatnonzero(changed)
            f = np.add.reduceat(n, starts)
            good = columns[k - 1, starts] > 0
            # Sums are whole here, but for single words and for the shorter phrases of cut groups.
            if k == LONGEST or (whole and k > 1):
                good &= f >= least
            starts, f = starts[good], f[good]
            for at in range(0, len(starts), 1 << 14):
                rows = columns[:k, starts[at:at + (1 << 14)]].T.tolist()
                phrases = [b" ".join([words[i] for i in row]) for row in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows), pa.string()), pa.array([k] * len(rows), pa.int32()),
                     pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(f[at:at + (1 << 14)])],
                    names=["lang", "k", "phrase", "f"])

    for grp, part, whole, lang, block in rows_of(batches, "grp", "part", "whole", "lang", "block"):
        if (grp, part, lang, whole) != place:
            yield from finish()
            place, numbers, held = (grp, part, lang, whole), _Numbers({b".": 0}), []
        words, columns, n = _unpacked(block)
        known = np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))
        held.append((known[columns], n))
    yield from finish()


@dataclass
class PhraseGraph:
    """Frequent phrases (lang, k, phrase, f), words of each language (lang, n) and the folder."""
    frequent: DataFrame
    totals: DataFrame
    folder: str

    def paths(self) -> DataFrame:
        """Maximal unary paths of the frequent edges: lang, words (array), f."""
        return unary_paths(self.frequent, f"{self.folder}/paths")


def phrase_graph(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
                 least: int = MIN_COUNT) -> PhraseGraph:
    """Exact counts of all phrases of one to four words with at least ``least`` occurrences."""
    spark = docs.sparkSession
    folder = run_folder(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(spark.sparkContext.defaultParallelism, math.ceil(size / GROUP_BYTES))
    blocks = stored(rows.mapInArrow(lambda b: _map(b, groups), _BLOCK), f"{folder}/blocks")
    large = stored(blocks.groupBy("grp").agg(F.sum("edges").alias("all")).filter(F.col("all") > MOST_EDGES)
                   .select("grp", F.ceil(F.col("all") / PART_EDGES).alias("parts")), f"{folder}/large")
    if not large.isEmpty():
        cut = blocks.join(large, "grp").mapInArrow(_cut, _BLOCK)
        blocks = blocks.join(large, "grp", "left_anti").unionByName(cut)
    met = (blocks.repartition(groups, "grp", "part")
           .sortWithinPartitions("grp", "part", "lang"))
    counts = stored(met.mapInArrow(lambda b: _merge(b, least), _COUNT)
                    .groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")), f"{folder}/counts")
    totals = stored(counts.filter("k = 1").groupBy("lang").agg(F.sum("f").alias("n")), f"{folder}/totals")
    frequent = stored(counts.filter(F.col("f") >= least), f"{folder}/frequent")
    return PhraseGraph(frequent, totals, folder)


def unary_paths(frequent: DataFrame, folder: str) -> DataFrame:
    """Maximal paths of edges that are each other's only neighbour: lang, words, f.

    An edge that is as frequent as the node at its end is the only way into it, and likewise
    for the way out.  Pieces end, so no such path is a circle.
    """
    edges = stored(frequent.filter(F.col("k") == LONGEST).select(
        "lang", "phrase", "f", F.substring_index("phrase", " ", LONGEST - 1).alias("head"),
        F.substring_index("phrase", " ", 1 - LONGEST).alias("tail")), f"{folder}/edges")
    nodes = frequent.filter(F.col("k") == LONGEST - 1).select("lang", F.col("phrase").alias("node"), "f")
    into = edges.select("lang", F.col("tail").alias("node"), "f", F.col("phrase").alias("before"))
    out = edges.select("lang", F.col("head").alias("node"), "f", "phrase")
    follows = nodes.join(into, ["lang", "node", "f"]).join(out, ["lang", "node", "f"])
    state = stored(edges.join(follows.select("lang", "phrase", "before"), ["lang", "phrase"], "left").select(
        "lang", "phrase", F.coalesce("before", "phrase").alias("start"),
        F.col("before").isNotNull().cast("long").alias("steps"),
        F.col("before").isNull().alias("ended")), f"{folder}/start-0")
    turn = 0
    while not state.filter("not ended").isEmpty():
        turn += 1
        # Twice as far back: to the start of the start.  An edge that starts a path stays.
        ahead = state.select("lang", F.col("phrase").alias("start"), F.col("start").alias("first"),
                             F.col("steps").alias("more"), F.col("steps").alias("left"))
        moved = state.filter("not ended").drop("ended").join(ahead, ["lang", "start"]).select(
            "lang", "phrase", F.col("first").alias("start"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("more") == 0).alias("ended"))
        state = stored(state.filter("ended").unionByName(moved), f"{folder}/start-{turn}")
    last = F.struct("steps", F.substring_index("phrase", " ", -1).alias("word"))
    # A path is no longer than the longest piece of a text.
    ends = state.groupBy("lang", "start").agg(F.array_sort(F.collect_list(last)).alias("ends"))
    joined = ends.join(edges.select("lang", F.col("phrase").alias("start"), "head", "f"), ["lang", "start"])
    return stored(joined.select(
        "lang", F.concat(F.split("head", " "), F.transform("ends", lambda e: e.word)).alias("words"), "f"),
        f"{folder}/all")


def _inside(words: str, size: int) -> F.Column:
    """All runs of ``size`` words of an array, joined by spaces."""
    return F.expr(f"transform(sequence(1, size({words}) - {size - 1}), "
                  f"i -> array_join(slice({words}, i, {size}), ' '))")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
                 least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language: lang, rank, phrase, a, l, r, n, score."""
    graph = phrase_graph(docs, lang_col, text_col, least)
    frequent = graph.frequent
    candidates = frequent.filter("k > 1").select(
        "lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "words", "k",
                             F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut",
                       F.expr("array_join(slice(words, 1, cut), ' ')").alias("first"),
                       F.expr("array_join(slice(words, cut + 1, k - cut), ' ')").alias("rest"))
    first = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = (cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
              .withColumn("score", F.expr(f"(cast(a AS decimal(20, 0)) * {SCALE}) div (l + r)"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")))
    paths = graph.paths()
    triples = candidates.filter("k = 3").select("lang", "words", F.col("a").alias("f"))
    inside = (paths.select("lang", "f", F.explode(F.concat(_inside("words", 2), _inside("words", 3))).alias("phrase"))
              .unionByName(triples.select("lang", "f", F.explode(_inside("words", 2)).alias("phrase"))))
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = "decimal(20, 0)"
    held = (F.col("longer").cast(wide) * 100) >= (F.col("a").cast(wide) * HELD_PERCENT)
    left = scored.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(held, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(graph.totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"),
        F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
