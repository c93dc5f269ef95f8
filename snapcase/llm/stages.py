"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

A stage's result is written before the next stage starts.  So a stage that starts deletes the
scratch tables of the one before it, and what an operator wrote goes as soon as the stage has
taken its result: the shared folder never holds more than a few copies of the corpus.

Rows are told apart by numbers, not by ids: null and repeated ids are rows like any others.
A null text is an empty one; an empty table passes through every stage; columns beyond those
of documents are kept whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_corpus, token_digests
from .common import drop_shuffles, remove, run_folder, ship, small_batches, stored
from .exact_dedup import exact_duplicates
from .mixing import BLOCK_DOCS, mixed
from .near_dedup import near_duplicates
from .quality import good_documents


_SCRATCH: dict[str, list[str]] = {}


def _begin(spark: SparkSession, kind: str) -> str:
    """Start a stage: a scratch folder of its own, and none of the stages before it."""
    ship(spark)
    small_batches(spark)
    left = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    for folder in left:
        remove(spark, folder)
    drop_shuffles(spark)
    left[:] = [run_folder(spark, kind)]
    return left[0]


def _numbered(docs: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, and the name of that column.

    Ids may be null or repeat, so rows are told apart by these numbers.
    """
    row = "row"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/rows"), row


def _one_of_each(numbered: DataFrame, row: str, groups: DataFrame, order: list[Column],
                 folder: str) -> DataFrame:
    """The rows of ``numbered`` that come first, by ``order``, in their group, without numbers.

    ``groups`` has a row (number, group) for each row.  Ties go to the lower number.
    """
    members = numbered.select(F.col(row).alias("number"), F.struct(*order, row).alias("place"))
    first = (members.join(groups, "number").groupBy("group")
             .agg(F.min("place").alias("place")).select(F.col(f"place.{row}").alias("number")))
    dropped = stored(groups.select("number").join(first, "number", "left_anti")
                     .withColumnRenamed("number", "dropped"),
                     f"{folder}/dropped")
    return numbered.join(dropped, F.col(row) == F.col("dropped"), "left_anti").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: all of them where no labels were learnt."""
    _begin(spark, "quality-stage")
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: of the longest, that of the smallest id."""
    folder = _begin(spark, "exact-stage")
    numbered, row = _numbered(docs, folder)
    found = exact_duplicates(numbered, id_col=row, folder=f"{folder}/index")
    # The operator's winner, a row number, names the group.
    groups = stored(found.select(F.col("doc_id").alias("number"), F.col("keep_id").alias("group")),
                    f"{folder}/groups")
    remove(spark, f"{folder}/index")
    order = [-F.length(F.coalesce("text", F.lit(""))).cast("long"), *_by_id()]
    return _one_of_each(numbered, row, groups, order, folder)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near-duplicates (five words, 0.8): the smallest id."""
    folder = _begin(spark, "near-stage")
    numbered, row = _numbered(docs, folder)
    found = near_duplicates(numbered, id_col=row, folder=f"{folder}/passes")
    groups = stored(found.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group")),
                    f"{folder}/groups")
    remove(spark, f"{folder}/passes")
    return _one_of_each(numbered, row, groups, _by_id(), folder)


def _by_id() -> list[Column]:
    """Ids in order, null ids last, texts of one id by their hash."""
    return [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix of sources at their true sizes.

    A null source is a source of its own; rows that repeat an id and a text come in any order.
    """
    _begin(spark, "mixing-stage")
    return mixed(docs, block_docs=BLOCK_DOCS)


def _in_order(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, text, place): ``place`` numbers the rows from 0 as they were written.

    Files are written in the order of their part numbers; a file's rows keep their order.
    """
    try:
        source = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "text", source["file_path"].alias("file"),
                           source["row_index"].alias("row"))
    except AnalysisException:  # not read from files
        return stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")),
                      f"{folder}/rows")
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    sizes = stored(rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")), f"{folder}/files")
    before = Window.orderBy(part, "file")
    starts = stored(sizes.select("file", (F.sum("n").over(before) - F.col("n")).alias("start")),
                    f"{folder}/starts")
    return rows.join(starts, "file").select("doc_id", "text", (F.col("start") + F.col("row")).alias("place"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document, in the order of the mix.

    Columns doc_id, n_tokens, ids_sha256, decoded_sha256; rows in the order in which the
    stage before wrote their documents, so the encoded corpus is mixed as well.
    """
    folder = _begin(spark, "bpe-stage")
    rows = _in_order(docs, folder)
    found = token_digests(encode_corpus(rows, id_col="place")).withColumnRenamed("doc_id", "at")
    ids = rows.select("place", F.col("doc_id").cast("long").alias("doc_id"))
    return (found.join(ids, F.col("at") == F.col("place")).orderBy("place")
            .select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
