"""Spelling forms, near vectors and collocations against plain Python, and mended operators."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from snapcase.llm import cap_filters, collocations, html, line_dedup, spelling, topk  # noqa: E402
from snapcase.llm.common import ship  # noqa: E402

# Columns whose names clash with those that the operators use inside.
DOC = ("doc_id long, text string, lang string, word string, n int, leaf int, side int, form string, "
       "phrase string, k int, grp int, block int, id string")


def table(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, lang, "w", 1, 2, 3, "f", "p", 4, 5, 6, "x") for i, t, lang in rows], DOC)


def misspelt(seed=2):
    rng = random.Random(seed)
    base = ["letters", "settler", "stretch", "Wörter", "évident", "aaaaaa", "mississippi", "listen", "silent"]
    rows = [(None, None, None), (1, "", "en"), (2, "x" * 30 + " a b", "en"), (None, "letters lettters", None)]
    for i in range(3, 160):
        words = []
        for _ in range(40):
            w = rng.choice(base)
            if rng.random() < 0.4:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1:], w[:p] + rng.choice("aeté") + w[p:], w[:p] + "s" + w[p + 1:]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
        rows.append((i % 150, rng.choice([" ", "-", "1"]).join(words), "en"))
    return rows + [(7, "long" * 4000 + "end " * 5, "en"), (7, "long" * 4000 + "end", "en")] * 2


@pytest.mark.parametrize("leaf_words", [spelling.LEAF_WORDS, 40])
def test_spelling_forms(spark, leaf_words):
    rows = misspelt()
    out = spelling.spelling_forms(table(spark, rows), leaf_words=leaf_words)
    want = brute.spelling([r[:2] for r in rows])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert any(r[1] and r[2] != r[1] for r in want) and any("é" in r[0] for r in want)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_forms(table(spark, [])).count() == 0
    assert spelling.spelling_forms(table(spark, [(1, None, None), (2, "a bc", "en")])).count() == 0


def test_tree_reaches_every_box():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(5, 8))) for _ in range(600)})
    vectors = spelling.Words(words).vectors()
    tree = spelling.Tree(vectors, 10)
    own = tree.own(vectors)
    for shorter in (0, 1):
        reached = {(leaf, r) for leaf, rows in tree.touched(vectors, shorter) for r in rows.tolist()}
        for i in range(0, len(words), 7):
            apart = np.abs(vectors[i, :-1] - vectors[:, :-1]).sum(axis=1)
            near = (apart <= 2 - shorter) & (vectors[:, -1] == vectors[i, -1] - shorter)
            assert all((int(own[j]), i) in reached for j in np.flatnonzero(near))


def groups_of_vectors(seed=5, dims=24):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.standard_normal((12, dims))
    for i in range(260):
        c = centres[i % 12]
        rows.append(c + rng.standard_normal(dims) * rng.choice([0.05, 0.2, 0.4]))
    rows += [rows[3]] * 30 + [rows[5] * 2.5] + list(rng.standard_normal((60, dims)))
    return [[float(x) for x in v] for v in rows]


def linked(rows, threshold):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
          and i is not None for i, v in rows]
    width = max([len(v) for (_, v), g in zip(rows, ok) if g], default=1)
    x = np.array([list(v) + [0.0] * (width - len(v)) if g else [0.0] * width for (_, v), g in zip(rows, ok)])
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(largest == 0, 1, largest)
    norm = np.linalg.norm(x, axis=1)
    norm[norm == 0] = 1
    near = (x @ x.T) / np.outer(norm, norm) >= threshold
    near &= np.outer(ok, ok)
    np.fill_diagonal(near, False)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(near[i]):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if y in (a, b) else y for y in label]
    low = {}
    for (i, _), part in zip(rows, label):
        low[part] = i if low.get(part) is None else min(low[part], i) if i is not None else low[part]
    return sorted(((i, int(near[k].sum()), low[label[k]] if ok[k] else i, (low[label[k]] if ok[k] else i) == i)
                   for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [cap_filters.BLOCK, 16])
def test_near_vectors(spark, block):
    ship(spark)
    rows = [(i + 10, v) for i, v in enumerate(groups_of_vectors())]
    rows += [(1, None), (2, []), (3, [0.0] * 24), (4, [float("nan")] * 24), (5, [None] * 24), (None, rows[0][1]),
             (12, rows[40][1]), (6, [1.0]), (7, [2.0, 0.0]), (8, [1e300] * 24), (9, [1e-300] * 24)]
    df = spark.createDataFrame([(i, v, 1, "n", 2, "f") for i, v in rows],
                               "vec_id long, embedding array<double>, label int, rep string, i int, filter string")
    out = cap_filters.near_vectors(df, block=block)
    assert sorted(map(tuple, out.collect()), key=str) == linked(rows, 0.9)
    assert cap_filters.near_vectors(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_share_filters():
    """Recall of the filters alone, for pairs at cosine 0.9 exactly, at several sizes of the code."""
    rng = np.random.default_rng(9)
    x, y = rng.standard_normal((2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.9 * x + np.sqrt(1 - 0.81) * y
    for rows in (500, 10**6):
        words, turns = cap_filters.code_size(rows)
        common = np.zeros(len(x))
        for turn in range(turns):
            code = cap_filters.product_code(64, words, turn)
            common += (code.decode(x)[:, :, None] == code.decode(z)[:, None, :]).sum(axis=(1, 2))
        assert (common == 0).mean() <= 0.001


def texts_with_phrases(seed=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["ä", "Q q", "\x1cz"]
    passage = "one Two\tthree  four five six, seven eight nine ten eleven twelve"
    rows = [(None, None, None), (1, "", "en"), (2, " .;! ", None)]
    for i in range(3, 120):
        parts = [rng.choice([passage, "strong tea", "new york city", " ".join(rng.choices(words, k=6))])
                 for _ in range(8)]
        rows.append((i, rng.choice([". ", "\n", "; ", " "]).join(parts), rng.choice(["en", "en", "de", None])))
    return rows + [(5, "strong tea " * 3000, "en")]


@pytest.mark.parametrize("cut", [False, True])
def test_collocations(spark, cut, monkeypatch):
    if cut:
        monkeypatch.setattr(collocations, "MOST_EDGES", 200)
        monkeypatch.setattr(collocations, "PART_EDGES", 50)
    rows = texts_with_phrases()
    for least, top in ((30, 2000), (5, 7)):
        out = collocations.collocations(table(spark, rows), least=least, top=top)
        assert sorted(map(tuple, out.collect())) == brute.phrases([(r[2], r[1]) for r in rows], least, top)


def test_paths_are_whole_passages(spark):
    text = "a b c d e f g h"
    rows = [(i, f"{text}. x b c d y", "en") for i in range(6)]
    graph = collocations.phrase_graph(table(spark, rows), least=2)
    paths = {" ".join(r.words): r.f for r in graph.paths().collect()}
    # x b c d and b c d y branch off at the node b c d, which ends no path of equal counts.
    assert paths == {"a b c d": 6, "x b c d": 6, "b c d y": 6, "b c d e f g h": 6}
    empty = collocations.collocations(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("tag", sorted(html.SKIPPED))
def test_unclosed_elements_hide_nothing_after_them(tag):
    page = f"<article><p>first part</p><{tag} class='x'><p>second part</p></article><{tag}>gone</{tag}><p>third</p>"
    found = []
    work = [html.parse(page)]
    while work:
        node = work.pop()
        found += [html.block_text(node)] if node.tag == "#text" else []
        work += reversed(node.children)
    text = " ".join(found)
    assert "second part" in text and "third" in text and "gone" not in text


def test_nested_skipped_elements_end_together():
    page = "<div>a<svg><text>x</text><svg>y</svg>z</svg>b<button>c</button>d</div>"
    root = html.parse(page)
    assert "".join(html.block_text(n) for n in root.children[0].children) == "abd"


def test_walk_stops_at_the_bound():
    rng = np.random.default_rng(3)
    # One dimension carries nearly all the weight: its list decides after a few rows.
    values = np.concatenate((rng.integers(-5000, 5000, (4000, 1)), rng.integers(-3, 4, (4000, 7))), axis=1)
    lists = topk.SortedLists(np.arange(4000), values)
    for query in values[:20]:
        best, unseen = lists.top(-1, query, 10)
        scores = values @ query
        want = sorted(zip(scores.tolist(), range(4000)), key=lambda x: (-x[0], x[1]))[:10]
        assert best == want
        if abs(query[0]) > 500:
            assert unseen > 2000


def test_later_batches_meet_hot_runs(spark, monkeypatch):
    ship(spark)
    met = []
    add = line_dedup.LineRuns.add

    def spy(self, lines):
        met.append(sum(run.count() for run in self.hot))
        add(self, lines)

    monkeypatch.setattr(line_dedup.LineRuns, "add", spy)
    rows = [(i % 7 or None, f"same line\nown {i}") for i in range(200)] + [(3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.line_digests(line_dedup.drop_shared_lines(df))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(_lines_per_row(rows), key=str)
    assert met[0] == 0 and met[-1] == 1


def _lines_per_row(rows):
    numbered = brute.lines(list(enumerate(t for _, t in rows)), 10)
    return [(rows[i][0], *rest) for i, *rest in numbered]


def test_archives_are_the_same_in_every_run(spark):
    from snapcase.llm import warc
    from snapcase.llm.common import run_folder
    ship(spark)
    rng = random.Random(7)
    rows = [(rng.choice([None, 5, 5, i, i * 10**9]), f"http://x/{i}", "p" * rng.choice([0, 3, 1200]) + str(i % 50), "r", 1)
            for i in range(3000)] + [(None, None, None, None, None)] * 3
    schema = "page_id long, url string, html string, shard string, id int"
    runs = []
    for parts in (3, 11):
        folder = run_folder(spark, "warc-test")
        pages = spark.createDataFrame(rows, schema).repartition(parts)
        manifest = warc.write_archives(pages, folder, shard_bytes=40_000, roll_bytes=8_000)
        runs.append(sorted(map(tuple, manifest.select("path", "records", "bytes", "sha1").collect())))
        back = warc.read_archives(manifest, folder)
        assert back.count() == len(rows) and back.rdd.getNumPartitions() > 20
    assert runs[0] == runs[1] and len({p.split("-")[1] for p, *_ in runs[0]}) > 20


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    from snapcase.llm import mixing
    assert mixing.block_size(10**6) == 8 and mixing.block_size(10**9) * mixing.MOST_SLOTS >= 10**9
    monkeypatch.setattr(mixing, "MOST_SLOTS", 10)
    df = spark.range(500).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source")
    plan = mixing.mix_schedule(df)
    assert plan.select("slot").distinct().count() <= 12 and plan.filter("not in_mix").count() == 0
