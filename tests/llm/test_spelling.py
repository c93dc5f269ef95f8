"""Spelling variants: boxes of one letter lost and one gained, every pair found from one side."""

import random

import numpy as np
import pyarrow as pa
import pytest

from snapcase.llm import spelling


def vectors(words):
    return spelling.Words(words).vectors()


def reached(tree, words, shorter):
    return {leaf for leaf, rows in tree.touched(vectors(words), shorter) if len(rows)}


def one_edit(a, b):
    """Whether b is a with one letter replaced or deleted."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def test_boxes_lose_one_letter_and_gain_at_most_one():
    words = ["aaaaa", "aaaaz", "aaazz"]
    tree = spelling.Tree(vectors(words), 1)
    none, single, double = tree.own(vectors(words)).tolist()
    assert reached(tree, ["aaaaa"], 0) == {none, single}
    assert reached(tree, ["aaazz"], 0) == {single, double}
    # A shorter word has no letter more than the word that asks for it.
    assert reached(tree, ["aaaaaa"], 1) == {none}


@pytest.mark.parametrize("longer", [0, 2048])
def test_leaf_finds_every_pair_once(longer):
    rng = random.Random(longer)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))) for _ in range(400)}
    ends = sorted(words)
    words = ["ab" * (longer // 2) + w for w in ends]
    leaf = spelling.Leaf(words, [3] * len(words))
    for shorter in (0, 1):
        found = [(q, w) for qs, ws in leaf.near(words, shorter) for q, w in zip(qs.tolist(), ws.tolist())]
        pairs = {(min(p), max(p)) for p in found} if not shorter else set(found)
        want = {(i, j) for i, a in enumerate(ends) for j, b in enumerate(ends)
                if len(a) == len(b) + shorter and (shorter or i < j) and one_edit(a, b)}
        assert len(found) == len(pairs) and pairs == want and want


def test_vectors_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(spelling, "mix64", lambda x: np.ones_like(x))
    words = ["abcde", "edcba", "abcdf", "abcde"]
    distinct, kind = spelling.Words(words).kinds()
    assert (distinct[kind] == vectors(words)).all()


def test_counts_lower_case_only_a_to_z():
    rows = [(1, "ÉCOLE école ÀÀÀÀÀ x×y÷zA abcd ABCDE abcde-abcde"), (None, None), (2, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                        pa.array([r[1] for r in rows], pa.string())], names=["id", "text"])
    (out,) = spelling._counted([batch])
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == {
        "École": 1, "école": 1, "ÀÀÀÀÀ": 1, "x×y÷za": 1, "abcde": 3}
