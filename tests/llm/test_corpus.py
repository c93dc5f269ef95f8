"""Corpus operators against plain Python on small tables with awkward rows."""

import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from snapcase.llm import bpe, components, exact_dedup, html, toxicity, warc  # noqa: E402
from snapcase.llm.common import run_folder, ship  # noqa: E402
from snapcase.llm.line_dedup import LineRuns, drop_shared_lines, line_digests, line_hash  # noqa: E402
from snapcase.llm.mixing import mix_schedule, mixed  # noqa: E402
from snapcase.llm.near_dedup import near_duplicates  # noqa: E402
from snapcase.llm.quality import good_documents, quality_scores  # noqa: E402
from snapcase.llm.topk import top_scores  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, hash int"


def awkward():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three four five", "a b", "\n\n"]
    texts += base + [base[0] + " tail", base[1].upper(), base[1], " " + base[1], base[2] + "\nshared line"]
    texts += [base[3] + f"\n  Shared LINE \n{i}" for i in range(12)]
    texts += ["long " * 3000 + "end", "x" * 5000, "<|endoftext|>a<|endoftext|>", "é" * 300 + base[4]]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en" if i % 2 else None, "hot" if i % 3 else None, 0, "x", 1, 2)
            for i, t in awkward()]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_exact_duplicates(docs, none):
    out = exact_dedup.exact_duplicates(docs, capacity=4)
    assert rows(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(awkward())
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_index_is_extended_by_later_rows(spark, docs):
    light = docs.select(F.col("doc_id").alias("id"), "text")
    folder = run_folder(spark, "test-index")
    first = exact_dedup.build_index(light.filter("id < 10"), f"{folder}/a", capacity=2, max_depth=6)
    both = exact_dedup.build_index(light.filter("id >= 10"), f"{folder}/b", first, 2, 6)
    whole = exact_dedup.build_index(light, f"{folder}/c", capacity=2, max_depth=6)
    want = rows(whole, "sha", "n", "chars", "id")
    assert rows(both, "sha", "n", "chars", "id") == want


def test_directory_doubles_only_where_buckets_are_overfull():
    directory = exact_dedup.grow_directory({0: 5, 1: 5, 2: 1, 3: 1, 8: 1, 15: 1}, 6, 4)
    assert directory == [0, 1, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4, 4] or len(set(directory)) > 2
    sizes = {}
    for prefix, n in {0: 5, 1: 5, 2: 1, 3: 1, 8: 1, 15: 1}.items():
        slot = directory[prefix >> (4 - (len(directory).bit_length() - 1))]
        sizes[slot] = sizes.get(slot, 0) + n
    assert max(sizes.values()) <= 6
    assert exact_dedup.grow_directory({}, 6, 4) == [0]


def test_colliding_keys_are_chained_by_bytes(monkeypatch, spark):
    monkeypatch.setattr(exact_dedup, "text_key", lambda raw: 7)
    names = exact_dedup._RECORD_ARROW
    out = exact_dedup.Emitter(names)
    for text, n, doc in ((b"a", 1, 3), (b"b", 2, 1), (b"a", 4, 2)):
        out.add((0, 7, text.decode(), text, n, 1, doc))
    found = [r for b in exact_dedup._chains([out.batch()]) for r in b.to_pylist()]
    assert [(r["text"], r["n"], r["id"], r["chain"]) for r in found] == [
        (b"a", 5, 2, 0), (b"b", 2, 1, 1)]


def test_shared_lines(docs, none):
    out = line_digests(drop_shared_lines(docs, min_documents=10))
    want = brute.lines(awkward(), 10)
    assert rows(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert sum(r[2] for r in want) >= 12
    assert drop_shared_lines(none).count() == 0


def test_line_runs_count_over_batches_and_levels(spark):
    store = LineRuns(spark, run_folder(spark, "test-runs"), min_documents=5, fanout=2)
    batches = [["a", "b"], ["a", "c"], ["a", "a"], ["a", "b"], ["b", "d"]]
    for batch in batches:
        store.add(spark.createDataFrame([(bytearray(line_hash(x.encode())),) for x in batch], "hash binary"))
    shared = {bytes(r.hash) for r in store.finish().collect()}
    assert shared == {line_hash(b"a")}
    assert store.finish().count() == 1


def test_near_duplicates(docs, none):
    for words in (4,):
        out = near_duplicates(docs, words=words)
        want = brute.near(awkward(), words, 80)
        assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == want
        assert sum(not r[3] for r in want) >= 10
    assert near_duplicates(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    out = components.connected(spark.createDataFrame(edges, "a long, b long"),
                               run_folder(spark, "test-cc"))
    assert {r.node: r.component for r in out.collect()} == (
        {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)})


def test_bpe(docs, none):
    out = bpe.token_digests(bpe.encode_corpus(docs))
    assert rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.tokens(awkward())
    assert bpe.encode_corpus(none).count() == 0


def test_chunk_joins_are_repaired(monkeypatch):
    monkeypatch.setattr(bpe, "CUT_MASK", 7)
    monkeypatch.setattr(bpe, "MIN_CHUNK", 8)
    c = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\n\n", "'", "ll", "'s", "1", "é", "$$", "<|endoftext|>", " ",
             " word", "日本", "́", "<|endo"]
    for _ in range(400):
        piece = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3)]
        text = "".join(rng.choice(piece) for _ in range(rng.randint(1, 5)))
        known = {d: np.array(c.plain(raw.decode()), dtype=np.uint16)
                 for p in c.pieces(text) if p not in c.specials
                 for d, raw in bpe.chunks(p) if rng.random() < 0.6}
        assert bpe.encode(c, text, known) == bpe.encode(c, text)
        ids = bpe.encode(c, text)
        assert brute.tokens([(0, text)])[0][2] == brute.sha(",".join(map(str, ids)))
    assert len(bpe.encode(c, " " * 60_000 + "x")) > 1


def test_mix_keeps_every_prefix_within_a_block(spark, docs, none):
    ship(spark)
    sizes = {"a": 700, "b": 90, "c": 41, None: 33, "d": 1}
    table = spark.createDataFrame(
        [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))],
        "doc_id long, source string")
    weights = spark.createDataFrame([("a", 0.55), ("b", 0.25), ("c", 0.15), (None, 0.05)],
                                    "source string, weight double")
    found = mix_schedule(table, weights=weights, block_docs=2, period=64).collect()
    assert len(found) == sum(sizes.values())
    blocks = {(r.slot, r.source) for r in found if r.slot is not None}
    assert len({s for s, _ in blocks}) == len(blocks)
    assert all(r.release <= r.slot < r.deadline for r in found if r.slot is not None)
    assert all(r.slot is None and not r.in_mix for r in found if r.source == "d")
    n = {s: sum(r.source == s and r.in_mix for r in found) for s in sizes}
    assert n["c"] == 41 or n["b"] == 90 or n[None] == 33 or n["a"] == 700
    for s, w in (("a", 0.55), ("b", 0.25), ("c", 0.15), (None, 0.05)):
        assert abs(n[s] / 2 - w * sum(n.values()) / 2) <= 2
    assert rows(mixed(docs), "doc_id") == rows(docs, "doc_id")
    assert mixed(docs).columns == docs.columns
    assert mix_schedule(none).count() == 0


def test_hot_source_is_trimmed_and_others_stay_whole(spark):
    table = spark.createDataFrame([(i, "hot" if i < 900 else f"s{i % 10}") for i in range(1000)],
                                  "doc_id long, source string")
    found = mix_schedule(table, hot_share=2.0, block_docs=1).groupBy("source").agg(
        F.count_if("in_mix").alias("n")).collect()
    n = {r.source: r.n for r in found}
    assert all(v == 10 for k, v in n.items() if k != "hot")
    assert abs(n["hot"] - 2.0 * 1000 / 11) <= 1


def test_quality(spark, none):
    ship(spark)
    rng = random.Random(2)
    good = [" ".join(rng.choice(("the", "cat", "sat", "on", "a", "mat", "and", "slept")) + rng.choice(("", ","))
                     for _ in range(50)) for _ in range(150)]
    texts = good + ["$$$ %%% !!! " * rng.randint(5, 20) for _ in range(150)]
    table = spark.createDataFrame(
        [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", 0, "x", 1, 2) for i, t in enumerate(texts)]
        + [(900, None, None, None, 0, "x", 1, 2)], DOC)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 300, 2)] + [(None, 1)],
                                   "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_scores(table, labels).collect()}
    assert len(kept) == 301
    assert all(kept[i] == (i < 150) for i in range(300))
    out = good_documents(table, labels)
    assert out.columns == table.columns and out.count() >= 150
    assert all(r.kept for r in quality_scores(table, labels.limit(0)).collect())
    assert quality_scores(none, labels).count() == 0


def test_top_scores(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    values = rng.normal(size=(300, 8)).astype(np.float32)
    values[200:] = values[:100]
    data = [(i, v.tolist()) for i, v in enumerate(values)]
    data += [(300, None), (400, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (600, [])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    whole = np.floor(values.astype(float) * 1024).astype(int)
    ids = [*range(300), 600]
    whole = np.vstack((whole, np.zeros((1, 8), int)))
    want = []
    for q in (0, 100, 200, 600):
        s = whole @ whole[ids.index(q)]
        best = sorted((-int(x), i) for x, i in zip(s, ids) if i != q)[:10]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(best)]
    for block in (16, 4096):
        found = top_scores(table, block=block, query_block=2)
        assert rows(found, "query_id", "rank", "vec_id", "score") == sorted(want)
    assert top_scores(table.limit(0)).count() == 0


def test_toxicity(spark, none):
    ship(spark)
    rng = random.Random(4)
    plain = ["river", "stone", "cloud", "trash can", "window", "garden"]
    texts = [" ".join(rng.choice(plain) for _ in range(30)) for _ in range(400)]
    toxic = set(range(0, 400, 4))
    texts = [t + rng.choice((" you m0ron", " zorgblat", " ZORGBlin", " idiоt")) if i in toxic else t
             for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, None, None, 0, "x", 1, 2) for i, t in enumerate(texts)]
                                  + [(900, None, None, None, 0, "x", 1, 2)], DOC)
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(400)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity_scores(table, labels).collect()}
    assert len(found) == 401 and found[900].predicted == 0
    held = [i for i in range(400) if found[i].held_out]
    assert 40 < len(held) < 120
    assert all(found[i].predicted == int(i in toxic) for i in held)
    assert toxicity.toxicity_scores(none, labels).count() == 0


def test_folding():
    assert toxicity.folded("1d10t  Іdіot! a$$$ 3 ｉdiot") == " idiot idiot a idiot "
    m = toxicity.Matcher({" trash ": 2.0, " zorg": 1.0}, ["trash can"])
    assert [h[2] for h in m.hits(toxicity.folded("trash can, TRASH; zorgling"))] == [2.0, 1.0]


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header class="top"><p>Site name</p>
</header><nav><ul><li><a href=x>Home</a><li><a href=y>News of the day</a></ul></nav>
<div class="sidebar"><p>Related things to read now.</p></div><article><h1>A title</h1>
<p>First &amp; long\n paragraph of the text, <b>bo</b>ld, with words.<br><p>Second paragraph, which goes on too.
<div class="advert">Buy this now.</div><p>The third one, after the advert, ends it.</article>
<section id="comments"><p>Nice text, thanks a lot.</p></section><form><p>Sign up</p><input></form>
<script>var x = "</p>";</script><footer>&copy; All rights.</footer>"""


def test_main_text(spark):
    ship(spark)
    pages = [(i, f"http://x/{i}", PAGE.replace("Second", f"Second {i}")) for i in range(30)]
    pages += [(90, None, None), (91, "u", ""), (92, "u", "<p>unclosed <b"), (93, "u", "<div>" * 3000 + "deep")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in html.main_text(table).collect()}
    assert len(found) == len(pages)
    for i in range(30):
        assert found[i].text == (
            f"A title First & long paragraph of the text, bold, with words. Second {i} paragraph, "
            "which goes on too. The third one, after the advert, ends it.")
        assert found[i].n_chars == len(found[i].text)
    assert found[90].text == "" and found[91].n_chars == 0
    assert html.main_text(table.limit(0)).count() == 0


def test_archives_round_trip(spark):
    ship(spark)
    big, other = "bé" * 800, "\r\n\r\n" * 400
    pages = [(1, "http://a/ b", big), (2, None, big), (3, "u", other), (4, "u", "small"), (5, "u", "small"),
             (6, "u", None), (7, "é", big), (8, "u", other), (9, "u", "tail\r\n\r\n")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = run_folder(spark, "test-warc")
    manifest = warc.write_archives(table, folder, roll_bytes=300)
    out = {r.record_id: r for r in warc.read_archives(manifest, folder).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in out.items()} == {
        1: ("revisit", 7), 2: ("revisit", 7), 3: ("revisit", 8), 4: ("response", None),
        5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None),
        9: ("response", None)}
    for i, url, page in pages:
        raw = (page or "").encode()
        assert out[i].url == url and out[i].payload_bytes == len(raw)
        assert out[i].payload_digest == __import__("hashlib").sha1(raw).hexdigest()
        if out[i].record_type == "response":
            assert bytes(out[i].payload) == raw
    again = warc.write_archives(table, run_folder(spark, "test-warc"), roll_bytes=300)
    assert rows(again, "path", "sha1") == rows(manifest, "path", "sha1")
    assert warc.archived(table.limit(0)).count() == 0
