"""Registered corpus queries (opN_<name>) and their DuckDB oracles."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_corpus, token_digests
from .cap_filters import near_vectors
from .collocations import collocations
from .common import ship
from .exact_dedup import exact_duplicates
from .html import main_text
from .line_dedup import drop_shared_lines, line_digests
from .mixing import BLOCK_DOCS, mix_schedule
from .near_dedup import near_duplicates
from .oracles import ORACLES
from .quality import quality_scores
from .spelling import spelling_forms
from .topk import top_scores
from .toxicity import toxicity_scores
from .warc import archived

# Words in a shingle of the registered near-duplicate query.
QUERY_SHINGLE_WORDS = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages")).selectExpr(
        "record_id AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule(_table(spark, sf_dir, "documents"), block_docs=BLOCK_DOCS)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=QUERY_SHINGLE_WORDS)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores(_table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_corpus(_table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(drop_shared_lines(_table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(_table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict:
    named = [op1_html, op2_warc, op3_exact_dedup, op4_mixing, op5_minhash_near_dedup, op6_topk, op7_bpe,
             op8_toxicity, op9_line_dedup, op10_quality, op11_spelling,
             op12_embedding_near_dedup, op13_collocations]
    return {f.__name__: _shipped(f) for f in named}


# The other operators fit models, tokenise or number rows by hashes that DuckDB has no
# functions for, and are tested against brute force.
def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
