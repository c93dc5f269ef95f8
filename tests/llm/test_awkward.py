"""Null and repeated ids, clashing column names, long values and empty tables."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from snapcase.llm import bpe, html, mixing, quality, topk, toxicity, warc  # noqa: E402
from snapcase.llm.common import ship  # noqa: E402

EXTRA = "v string, at int, id string, payload string, digest string, row int, score string, slot string, n int"
FILL = ("v", 1, "i", "p", "d", 2, "s", "t", 3)


def frame(spark, rows, columns):
    ship(spark)
    return spark.createDataFrame([(*r, *FILL) for r in rows], f"{columns}, {EXTRA}")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(1)

    def page_of(paragraphs):
        body = "".join(f"<p>{' '.join(f'{rng.getrandbits(20):x}' for _ in range(40))}.</p>" for _ in range(paragraphs))
        return f"<html><body><nav><a href=x>menu</a></nav><article>{body}</article><footer>foot</footer></body></html>"

    page = page_of(6)
    return [(1, "http://a/1", page), (1, "http://a/1", page), (None, None, page), (2, "http://a/2", None),
            (3, "http://a/3", ""), (4, "http://a/4", page_of(2500)),
            (None, "http://b/é ü", "<p>x</p>"), (5, "u", "\u0000<p>퟿ &amp; &#x41;</p>")]


def test_pages(spark, pages):
    df = frame(spark, pages, "page_id long, url string, html string")
    out = html.main_text(df)
    assert rows_of(out, "page_id", "url") == sorted(((i, u) for i, u, _ in pages), key=str)
    found = [(r.page_id, r.text, r.n_chars) for r in out.collect()]
    assert all(len(t) == n for _, t, n in found)
    assert [n for i, _, n in found if i in (2, 3)] == [0, 0]
    assert next(n for i, _, n in found if i == 4) > 500_000
    same = {t for i, t, n in found if i == 1}
    assert len(same) == 1 and "menu" not in same.pop()
    assert html.main_text(df.limit(0)).count() == 0


def test_archives(spark, pages):
    df = frame(spark, pages, "page_id long, url string, html string")
    out = warc.archived(df)
    payloads = [(i, (h or "").encode()) for i, _, h in pages]
    want = [(i, len(p), hashlib.sha1(p).hexdigest()) for i, p in payloads]
    assert rows_of(out, "record_id", "payload_bytes", "payload_digest") == sorted(want, key=str)
    kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in out.filter("payload_bytes >= 1000").collect())
    # The page of ids 1, 1 and null: one response of id 1, to which the others refer.
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 1, (None, "revisit", 1): 1, (4, "response", None): 1}
    assert warc.archived(df.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(2)
    docs = [(rng.choice([None, 7, 7, i]), rng.choice(["a", "a", "a", None, "b"])) for i in range(400)]
    df = frame(spark, docs, "doc_id long, source string")
    out = mixing.mix_schedule(df)
    assert rows_of(out, "doc_id", "source") == sorted(docs, key=str)
    rows = out.collect()
    sizes = Counter(s for _, s in docs)
    # Each source's documents are numbered once each, and its blocks lie between release and deadline.
    for source, n in sizes.items():
        places = sorted((r.block - 1) * mixing.BLOCK_DOCS + r["rank"] for r in rows if r.source == source)
        assert places == list(range(n))
    assert all(r.in_mix for r in rows)
    assert mixing.mix_schedule(df.limit(0)).count() == 0


def test_mix_equals_a_replay(spark):
    """Earliest deadline first over whole blocks, one slot at a time."""
    sizes = {"a": 131 * 8, "b": 17 * 8, "c": 40 * 8, "d": 8}
    docs = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    out = mixing.mix_schedule(frame(spark, docs, "doc_id long, source string"), period=16)
    got = {(r.source, r.block): (r.release, r.deadline, r.slot) for r in out.collect()}
    total, done, want = sum(sizes.values()), dict.fromkeys(sizes, 0), {}
    for slot in range(total // 8):
        ready = []
        for s, n in sizes.items():
            j = done[s] + 1
            release, deadline = (j - 1) * total // n, -(-j * total // n)
            if j <= n // 8 and release <= slot:
                ready.append((deadline, s, release))
        deadline, s, release = min(ready)
        done[s] += 1
        want[s, done[s]] = (release, deadline, slot)
        assert release <= slot < deadline
    assert got == want


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(5)]) for i in range(150)]
    rows += [(100, rows[3][1]), (None, rows[4][1]), (200, None), (201, [None] * 5), (202, [float("nan")] * 5),
             (203, []), (204, [1.0]), (3, rows[3][1])]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    out = topk.top_scores(df, k=7)

    def whole(v):
        return [int((1024 * x) // 1) for x in v]

    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None
            and all(x is not None and x == x for x in v)]
    want = []
    for q, x in {(i, tuple(v)) for i, v in good if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in good if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:7], 1)]
    got = rows_of(out, "query_id", "rank", "vec_id", "score")
    # Id 100 is there twice: both its rows ask, and their results are merged by rank.
    assert [r for r in got if r[0] != 100] == sorted((r for r in want if r[0] != 100), key=str)
    assert [r[1] for r in got if r[0] == 100] == list(range(1, 8))
    assert topk.top_scores(df.limit(0)).count() == 0


def texts():
    rng = random.Random(4)
    rows = [(None, None), (1, ""), (1, "one two <|endoftext|> three"), (2, "word " * 40_000), (None, "é あ x" * 50)]
    return rows + [(rng.choice([None, 5, i]), " ".join(f"t{rng.randrange(300)}" for _ in range(80))) for i in range(40)]


def test_tokens(spark):
    df = frame(spark, texts(), "doc_id long, text string")
    out = bpe.token_digests(bpe.encode_corpus(df))
    rows = texts()
    want = [(rows[i][0], *rest) for i, *rest in brute.tokens(list(enumerate(t for _, t in rows)))]
    assert rows_of(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.token_digests(bpe.encode_corpus(df.limit(0))).count() == 0


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality.quality_scores])
def test_learnt_scores(spark, scores):
    rows = [(i, t, "s", "en") for i, t in texts()]
    df = frame(spark, rows, "doc_id long, text string, source string, lang string")
    marks = [(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, None), (5, 0, 1)]
    labels = spark.createDataFrame([(*m, "t") for m in marks], "doc_id long, quality int, toxic int, text string")
    out = scores(df, labels).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((r[0] for r in rows), key=str)
    assert all(0 <= r.score <= 1 for r in out)
    # Without labels nothing is learnt; every document still has a score.
    assert scores(df, labels.limit(0)).count() == len(rows)
    assert scores(df.limit(0), labels).count() == 0
