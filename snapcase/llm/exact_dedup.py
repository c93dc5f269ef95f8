"""Exact duplicates of texts by an extendible-hash index kept on shared files.

The key of a text is a 64-bit hash of its normalised bytes (ASCII white space
deleted).  A directory of 2^g slots, addressed by the top g bits of the key, points
to buckets; a bucket that holds more keys than its capacity is split by one more
bit, and the directory doubles when a bucket grows deeper than it.  One task owns a
bucket, that is a range of keys: it reads the bucket's records in key order, chains
the records of one key and compares their bytes, so texts with colliding keys stay
apart.  The buckets are written to shared files and can be extended by later batches.

Each map task first folds equal texts into one record (compared by their bytes), so
a text that a third of all rows share reaches its owner as one record per task.

Rows: a null text counts as empty; empty tables give empty results; columns beyond
the id and the text are ignored, whatever their names; a null id never wins over
another id; rows that repeat both id and text all count in ``group_size`` and are
kept or dropped together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Emitter, rows_of, run_folder, signed, stored

# Keys per bucket before it is split, and the most bits the directory may use.  A
# bucket that is overfull at the last depth still works: its owner streams it.
BUCKET_CAPACITY = 1024
MAX_DEPTH = 18
# Bytes of distinct texts that a map task holds while it folds equal ones.
FOLD_BYTES = 8 << 20
# Keys that a map task remembers while it counts them.
HELD_KEYS = 1 << 17

_RECORD = "bucket int, key long, sha string, text binary, n long, chars long, id long"
_ENTRY = _RECORD + ", chain int"
_RECORD_ARROW = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("sha", pa.string()),
                           ("text", pa.binary()), ("n", pa.int64()), ("chars", pa.int64()),
                           ("id", pa.int64())])


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 without ASCII white space."""
    return (text or "").encode().translate(None, BLANKS)


def text_key(raw: bytes) -> int:
    return signed(xxhash.xxh3_64_intdigest(raw))


def better(a: tuple, b: tuple) -> bool:
    """Whether record a (chars, id) wins over b: more code points, then the smaller id."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


def grow_directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[int]:
    """Directory slots (bucket numbers) for keys counted by their top ``max_depth`` bits.

    Starts with one bucket of depth 0.  An overfull bucket is split in two by its next
    bit; when its depth reaches that of the directory, the directory doubles first.
    """
    totals = np.zeros((1 << max_depth) + 1, dtype=np.int64)
    for prefix, n in counts.items():
        totals[prefix + 1] += n
    totals = np.cumsum(totals)
    directory, depth, work, ready = [(0, 0)], 0, [(0, 0)], {}
    while work:
        path, local = work.pop()
        width = max_depth - local
        size = totals[(path + 1) << width] - totals[path << width]
        if size <= capacity or local == max_depth:
            ready[(path, local)] = None
            continue
        if local == depth:
            directory = [slot for slot in directory for _ in (0, 1)]
            depth += 1
        halves = [(path << 1, local + 1), (path << 1 | 1, local + 1)]
        span = depth - local - 1
        for half in halves:
            directory[half[0] << span:(half[0] + 1) << span] = [half] * (1 << span)
        work += halves
    numbers = {bucket: i for i, bucket in enumerate(
        sorted(ready, key=lambda b: b[0] << (max_depth - b[1])))}
    return [numbers[slot] for slot in directory]


def _prefixes(docs: DataFrame, bits: int) -> DataFrame:
    """Keys by prefix, each key once per map task."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = [text_key(normalised(t)) for (t,) in rows_of([batch], "text")]
            new = [k for k in dict.fromkeys(keys) if k not in seen]
            if len(seen) < HELD_KEYS:
                seen.update(new)
            found, n = np.unique(np.array(new, dtype=np.int64).view(np.uint64)
                                 >> np.uint64(64 - bits), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array(n)], names=["prefix", "n"])

    return docs.select("text").mapInArrow(count, "prefix int, n long")


def _fold(batches: Iterable[pa.RecordBatch], directory: np.ndarray) -> Iterator[pa.RecordBatch]:
    shift = np.uint64(64 - (len(directory).bit_length() - 1))
    out = Emitter(_RECORD_ARROW)
    held: dict[bytes, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for raw, (n, chars, doc) in held.items():
            key = text_key(raw)
            slot = 0 if len(directory) == 1 else int(np.uint64(key & (2**64 - 1)) >> shift)
            out.add((int(directory[slot]), key, hashlib.sha256(raw).hexdigest(), raw, n, chars,
                     doc), len(raw))
            if out.full:
                yield out.batch()
        held.clear()

    for doc, text in rows_of(batches, "id", "text"):
        raw = normalised(text)
        mine = (len(text or ""), doc)
        if (old := held.get(raw)) is None:
            held[raw] = [1, *mine]
            size += len(raw)
        else:
            old[0] += 1
            if better(mine, (old[1], old[2])):
                old[1:] = mine
        if size > FOLD_BYTES:
            yield from flush()
            size = 0
    yield from flush()
    yield out.batch()


def _chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner of a key range: records in key order, chained per key, compared by bytes."""
    out = Emitter(_RECORD_ARROW.append(pa.field("chain", pa.int32())))
    place, chain = None, []

    def flush() -> None:
        for i, (text, (sha, n, chars, doc)) in enumerate(chain):
            out.add((*place, sha, text, n, chars, doc, i), len(text))

    for bucket, key, sha, text, n, chars, doc in rows_of(batches, *_RECORD_ARROW.names):
        if (bucket, key) != place:
            flush()
            place, chain = (bucket, key), []
            if out.full:
                yield out.batch()
        for other, best in chain:
            if other == text:
                best[1] += n
                if better((chars, doc), (best[2], best[3])):
                    best[2:] = chars, doc
                break
        else:
            chain.append((text, [sha, n, chars, doc]))
    flush()
    yield out.batch()


def build_index(docs: DataFrame, folder: str, previous: DataFrame | None = None,
                capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Index of the distinct texts of ``docs`` (columns id, text), written to ``folder``.

    One row per distinct text: bucket, key, chain (position among texts of one key),
    sha (of the normalised text), text, n (rows), chars and id of the row that stays.
    ``previous`` is an earlier index that the new rows extend.
    """
    prefixes = _prefixes(docs, max_depth)
    if previous is not None:
        prefixes = prefixes.unionByName(previous.select(
            F.shiftrightunsigned("key", 64 - max_depth).cast("int").alias("prefix"),
            F.lit(1).cast("long").alias("n")))
    # At most 2^max_depth counts reach the driver, whatever the number of rows.
    counts = {r.prefix: r.n for r in
              prefixes.groupBy("prefix").agg(F.sum("n").alias("n")).collect()}
    directory = np.array(grow_directory(counts, capacity, max_depth), dtype=np.int32)
    records = docs.mapInArrow(lambda batches: _fold(batches, directory), _RECORD)
    if previous is not None:
        depth = len(directory).bit_length() - 1
        slot = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
        places = F.lit([int(x) for x in directory])
        records = records.unionByName(
            previous.withColumn("bucket", F.get(places, slot)).drop("chain"))
    owned = (records.repartition("bucket").sortWithinPartitions("bucket", "key")
             .mapInArrow(_chains, _ENTRY))
    return stored(owned, folder)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = BUCKET_CAPACITY, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The index is written to ``folder``, a new one by default.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = build_index(rows, folder or run_folder(docs.sparkSession, "exact-index"), capacity=capacity)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [normalised(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                names=["doc_id", "text_sha256"])

    groups = index.select(F.col("sha").alias("text_sha256"), F.col("id").alias("keep_id"),
                          F.col("n").alias("group_size"))
    members = rows.mapInArrow(digests, "doc_id long, text_sha256 string")
    return members.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")
