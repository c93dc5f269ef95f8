"""Near duplicates of which one text is the other with its end cut off."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from snapcase.llm import near_dedup
from snapcase.llm.common import ship
from snapcase.llm.near_dedup import SKETCHES, Shingler, least_shared, near_duplicates

SKETCH = SKETCHES[0]


def cut_pairs(wanted):
    """Texts and their cut copies, similar at 0.8, with 52 to 63 of 96 sketch values in common."""
    rng, shingler, found = random.Random(11), Shingler(5), []
    for _ in range(50 * wanted):
        words = [f"{rng.getrandbits(30):x}" for _ in range(244)]
        kept = " ".join(words)
        for _ in range(60):
            # Of a few words, the one whose shingle comes first: the end holds many low ones.
            drawn = [f"{rng.getrandbits(30):x}" for _ in range(3)]
            words.append(min(drawn, key=lambda w: shingler.shingles(" ".join([*words[-4:], w]))[0]))
        whole, part = shingler.shingles(" ".join(words)), shingler.shingles(kept)
        if 52 <= len(set(whole[:SKETCH]) & set(part[:SKETCH])) <= 63:
            assert len(part) / len(whole) == 0.8
            found.append((" ".join(words), kept))
        if len(found) == wanted:
            return found
    raise AssertionError("too few pairs")


def test_cut_copies_are_linked(spark):
    ship(spark)
    pairs = cut_pairs(6)
    table = spark.createDataFrame(
        [(10 * i + j, pair[j]) for i, pair in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in near_duplicates(table).collect()}
    assert out == {10 * i + j: 10 * i for i in range(len(pairs)) for j in (0, 1)}


def test_cut_copies_are_linked_in_blocks():
    shingler = Shingler(5)
    for pair in cut_pairs(3):
        sets = [shingler.shingles(t) for t in pair]
        for size, sure in ((SKETCH, False), (512, True)):
            left, right = ([(i, len(x), i, (x[:size] ^ np.uint64(1 << 63)).view(np.int64))]
                           for i, x in enumerate(sets))
            assert list(near_dedup._compared(left, right, 80, size, least_shared(size, 0.8))) == [(0, 1, sure)]


def test_share_of_sketches_leaves_out_few_pairs():
    from math import ceil, comb

    for size in SKETCHES:
        need = ceil(least_shared(size, 0.8) * size)
        miss = sum(comb(size, i) * 0.8 ** i * 0.2 ** (size - i) for i in range(need))
        assert miss < 1e-8


def test_repeated_ids_keep_the_links_of_all_their_texts(spark):
    ship(spark)
    rng = random.Random(8)
    a, b = (" ".join(f"{rng.getrandbits(30):x}" for _ in range(80)) for _ in range(2))
    rows = [(1, a), (1, b), (9, b), (7, b + " more"), (3, a + " end"), (4, "one two"), (None, a), (None, b),
            (1, a), (4, "one two")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(table).collect()}
    assert out == {(1, 1, True), (9, 1, False), (7, 1, False), (3, 1, False), (4, 4, True), (None, None, True)}


def test_groups_of_short_texts_around_a_common_passage(spark, monkeypatch):
    """Long lists at both sketch sizes, against all pairs."""
    ship(spark)
    monkeypatch.setattr(near_dedup, "LONG_LIST", 4)
    monkeypatch.setattr(near_dedup, "SKETCHES", (16, 24))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(3)

    def words(n):
        return [f"{rng.getrandbits(24):x}" for _ in range(n)]

    passage, rows = words(40), []
    for i in range(60):
        own = words(rng.choice([3, 8, 12, 40]))
        rows.append((i, " ".join(passage[:rng.choice([30, 40])] + own)))
    for i in range(60, 75):
        text = rows[i - 60][1].split()
        text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(table).collect())
    assert out == brute.near(rows, 5, 80)
