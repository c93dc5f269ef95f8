"""Lines that many documents share, found with levelled sorted runs of line hashes.

``LineRuns`` holds runs on shared files, each sorted by the 128-bit hash of a line's
key.  Cold runs hold (hash, documents so far); hot runs hold hashes that have reached
the threshold.  A new batch of lines is merge-anti-joined against the hot runs (lines
already known as shared need no more counting) and adds its own run: what reached the
threshold within the batch is hot at once, the rest a cold run at level 0.  When a level holds ``fanout`` runs they are compacted into one run of the
next level; hashes whose sum reached the threshold leave for the hot run.  The driver
keeps only the list of run folders (logarithmic in the number of batches).

A line's key is the line stripped of ASCII white space at both ends, with A-Z in lower
case; keys of 0 code points never count.  A null or empty text is one empty line; a
row is a document, also when its id repeats; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Emitter, rows_of, run_folder, stored

MIN_DOCUMENTS = 10
FANOUT = 4
BATCHES = 6


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip().lower()


def line_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """Levelled sorted runs of line hashes with document counts."""

    def __init__(self, spark: SparkSession, folder: str, min_documents: int = MIN_DOCUMENTS,
                 fanout: int = FANOUT):
        self.spark, self.folder = spark, folder
        self.min_documents, self.fanout = min_documents, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.hot: list[DataFrame] = []
        self.made = 0

    def _run(self, rows: DataFrame) -> DataFrame:
        self.made += 1
        return stored(rows.sortWithinPartitions("hash"), f"{self.folder}/run-{self.made:05d}")

    def shared(self) -> DataFrame:
        """Hashes known to have reached the threshold."""
        if not self.hot:
            return self.spark.createDataFrame([], "hash binary")
        out = self.hot[0]
        for run in self.hot[1:]:
            out = out.unionByName(run)
        return out

    def add(self, lines: DataFrame) -> None:
        """Add a batch: one row (hash) for each distinct line key of each document."""
        fresh = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        if self.hot:
            fresh = fresh.join(self.shared(), "hash", "left_anti")
        run = self._run(fresh)
        reached = F.col("n") >= self.min_documents
        self.hot.append(run.filter(reached).select("hash"))
        self.levels[0].append(run.filter(~reached))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level, level + 1)
            level += 1

    def _compact(self, low: int, to: int) -> None:
        """Merge the runs of levels low..to-1 into one run of level ``to``."""
        runs = [run for level in self.levels[low:to] for run in level]
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        merged = self._run(merged.groupBy("hash").agg(F.sum("n").alias("n")))
        self.levels += [[] for _ in range(to + 1 - len(self.levels))]
        for level in range(low, to):
            self.levels[level] = []
        reached = F.col("n") >= self.min_documents
        self.hot.append(merged.filter(reached).select("hash"))
        self.levels[to].append(merged.filter(~reached))

    def finish(self) -> DataFrame:
        """Compact every level into one run; the hashes of all shared lines, each once."""
        if any(self.levels):
            self._compact(0, len(self.levels))
        return self.shared()


def _line_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Emitter(pa.schema([("p", pa.int64()), ("q", pa.int64()), ("batch", pa.int32()),
                             ("hash", pa.binary())]), max_rows=1 << 16)
    for p, q, batch, text in rows_of(batches, "p", "q", "batch", "text"):
        keys = set(map(line_key, (text or "").encode().split(b"\n")))
        keys.discard(b"")
        for key in keys:
            out.add((p, q, batch, line_hash(key)))
        if out.full:
            yield out.batch()
    yield out.batch()


def _keep_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()),
                        ("n_dropped", pa.int64()), ("kept_text", pa.string())])
    out = Emitter(schema)
    for doc, text, shared in rows_of(batches, "id", "text", "shared"):
        lines = (text or "").encode().split(b"\n")
        kept = lines
        if shared:
            drop = set(shared)
            kept = [x for x in lines if not ((key := line_key(x)) and line_hash(key) in drop)]
        whole = b"\n".join(kept)
        out.add((doc, len(lines), len(lines) - len(kept), whole.decode()), len(whole))
        if out.full:
            yield out.batch()
    yield out.batch()


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text.

    Lines whose key occurs in at least ``min_documents`` documents go from every
    document; the others stay, joined by a line feed.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "line-runs")
    # What goes from a row depends on its text alone, so rows meet their lines by a 128-bit
    # hash of the text: null and repeated ids make no large group.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumns(
        {"p": F.xxhash64("text"), "q": F.xxhash64(F.lit("q"), "text")})
    # One pass over the texts gives the lines of all batches; a batch is a share of the
    # documents by the hash of their id, as if it had arrived on its own.
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    lines = stored(dealt.mapInArrow(_line_hashes, "p long, q long, batch int, hash binary"),
                   f"{folder}/lines", "batch")
    runs = LineRuns(spark, f"{folder}/runs", min_documents)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch))
    found = lines.join(runs.finish(), "hash", "left_semi")
    drops = found.groupBy("p", "q").agg(F.collect_set("hash").alias("shared"))
    joined = rows.join(drops, ["p", "q"], "left").select("id", "text", "shared")
    return joined.mapInArrow(
        _keep_lines, "doc_id long, n_lines long, n_dropped long, kept_text string")


def line_digests(kept: DataFrame) -> DataFrame:
    """The result of ``drop_shared_lines`` with a digest in place of the text."""
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
