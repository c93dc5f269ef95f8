"""Dedup stages decide per row, where ids are null or repeat."""

import random

from snapcase.llm import stages


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(4)

    def text():
        return " ".join(f"{rng.getrandbits(30):x}" for _ in range(120))

    a, b, c, d, e, f = (text() for _ in range(6))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(None, a), (3, a), (None, b), (None, c), (None, c), (5, d), (5, e), (6, e), (5, d),
            (2, f), (2, f), (9, near), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, row long")
    out = stages.exact_dedup(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted([(3, a), (None, b), (None, c), (5, d), (5, e), (2, f), (9, near), (None, "")],
                          key=str)
    # The near-duplicate stage on the same rows: the empty texts link with nothing.
    out = stages.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted([(3, a), (None, b), (None, c), (5, d), (5, e), (2, f), (None, ""), (None, "")],
                          key=str)
