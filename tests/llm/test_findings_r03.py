"""Findings of round 3: one schedule at any size, near pairs checked on texts, the mix's order."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from snapcase.llm import mixing, near_dedup, queries, stages


def _earliest_deadline_first(sizes, block):
    """Slots of (place of the source, block from 1) by one fold over all of them."""
    whole, blocks = sum(sizes), [-(-n // block) for n in sizes]
    waiting, ready, order = [(0, i, 0) for i in range(len(sizes))], [], []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, i, done = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done + 1) * whole // sizes[i]), i, done))
        _, i, done = heapq.heappop(ready)
        order.append((i, done + 1))
        if done + 1 < blocks[i]:
            heapq.heappush(waiting, ((done + 1) * whole // sizes[i], i, done + 1))
    return order


def test_f1_query_has_the_same_blocks_at_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SLOTS", 10)
    spark.range(500).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = queries.op4_mixing(spark, str(tmp_path))
    blocks = {r.source: r.n for r in found.groupBy("source").agg(F.max("block").alias("n")).collect()}
    assert blocks == {"a": -(-167 // mixing.BLOCK_DOCS), "b": -(-333 // mixing.BLOCK_DOCS)}
    assert found.agg(F.max("rank")).first()[0] == mixing.BLOCK_DOCS - 1


@pytest.mark.parametrize("sizes", [[900, 700, 40, 3, 1], [50] * 12, [1, 1, 600], [64]])
def test_f1_periods_fit_one_fold(spark, sizes):
    names = [f"s{i:02d}" for i in range(len(sizes))]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(
        s for s, n in zip(names, sizes) for _ in range(n))], "doc_id long, source string")
    # Short periods, so that guesses miss and periods are run again.
    found = mixing.mix_schedule(table, block_docs=2, period=4)
    got = {r.slot: (names.index(r.source), r.block)
           for r in found.select("slot", "source", "block").distinct().collect()}
    assert [got[t] for t in range(len(got))] == _earliest_deadline_first(sizes, 2)


def test_near_pairs_are_checked_on_texts_of_repeated_rows(spark, tmp_path):
    rng = random.Random(8)
    words = [f"{rng.getrandbits(40):x}" for _ in range(400)]
    # 400 words share 396 of 397 shingles less five for each changed word.
    one, six, many = list(words), list(words), list(words)
    one[7] = "x"
    for i in range(20, 400, 60):
        six[i] = "y"
    for i in range(5, 400, 20):
        many[i] = "z"
    texts = [" ".join(w) for w in (words, one, six, many)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (1, texts[1])]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"),
                                     folder=str(tmp_path / "near"))
    found = {(r.doc_id, r.component_id) for r in out.collect()}
    assert out.count() == 6 and found == {(0, 0), (1, 0), (2, 0), (3, 3)}
    # The texts and sketches of the passes are gone when the result is returned.
    assert not (tmp_path / "near/sketches").exists()
    assert not list((tmp_path / "near").glob("**/texts"))


def test_f2_tokens_come_in_the_order_of_the_mix(spark, tmp_path):
    rows = [(None if i % 9 == 0 else i % 50, f"text number {i}", "ab"[i % 3 == 0]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    stages.mixing(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    stages.bpe(spark, spark.read.parquet(str(tmp_path / "mixed")), "").write.parquet(str(tmp_path / "bpe"))

    def written(name):
        files = sorted((tmp_path / name).glob("part-*"))
        return [r for f in files for r in spark.read.parquet(str(f)).collect()]

    want = [r.doc_id for r in written("mixed")]
    assert [r.doc_id for r in written("bpe")] == want and len(want) == 300
    assert want != [r[0] for r in rows]
    # Without files the rows keep the order of the table.
    few = docs.limit(20)
    assert stages.bpe(spark, few, "").count() == 20
