"""The corpus pipeline over the smallest tables, against brute force where it decides."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id for r in docs.collect()})
    into, out = kept["exact_dedup"]
    assert out == {r[0] for r in brute.exact(list(into.items())) if r[3]}
    into, out = kept["near_dedup"]
    assert out == {r[0] for r in brute.near(list(into.items()), 5, 80) if r[3]}
    into, out = kept["bpe"]
    want = brute.tokens(list(into.items()))
    assert sorted(tuple(r) for r in docs.collect()) == want and out == set(into)
