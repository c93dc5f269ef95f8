"""Sparse pairs, heavy baskets and the bound-driven top k against the full grid."""

import random

import pytest
from conftest import row, snap

from snapcase.operators import association as asc
from snapcase.operators import pairs

KEYS = list(asc.BOOKING)


def _cases(spark, seed=3, baskets=400, heavy=60):
    """Skewed items, one heavy basket, and two frequent items that never meet."""
    rng = random.Random(seed)
    rows = []
    for b in range(baskets):
        items = {f"d{min(int(rng.expovariate(0.25)), 30)}" for _ in range(rng.randint(0, 3))}
        items |= {f"t{min(int(rng.expovariate(0.25)), 30)}" for _ in range(rng.randint(0, 3))}
        if "d1" in items:
            items.discard("t1")
            items.add("t2")
        rows += [(b, i) for i in items]
    rows += [(baskets, f"{g}{i}") for g in "dt" for i in range(2, heavy)]
    rows += [(baskets + 1 + i, "d1" if i % 2 else "t1") for i in range(80)]
    rng.shuffle(rows)
    return snap(spark, [row(b, "2020-01-02", "2020-01-03", grp={"d": "DRUGS", "t": "TRAFFIC"}[i[0]], charge=i)
                        for b, i in rows])


@pytest.fixture(scope="module")
def cases(spark):
    return _cases(spark).cache()


@pytest.fixture(scope="module")
def grid(cases):
    return asc.cramers_v(asc.item_pair_contingency(cases, "DRUGS", "TRAFFIC")).cache()


def _items(df):
    return asc.basket_items(df, ["DRUGS", "TRAFFIC"])


def test_significant_pairs_equal_the_grid(cases, grid):
    got = pairs.significant_pairs(_items(cases), KEYS, "DRUGS", "TRAFFIC")
    want = grid.filter("cramers_v IS NOT NULL")
    assert sorted(map(tuple, got.select(*grid.columns).collect())) == sorted(map(tuple, want.collect()))
    # Two frequent items that never meet are among them.
    assert got.filter("x_item = 'd1' AND y_item = 't1' AND n11 = 0").count() == 1
    assert got.count() < grid.count()


@pytest.mark.parametrize("k", [1, 7, 20, 500])
def test_top_k_equals_the_grid(cases, grid, k):
    want = [tuple(r) for r in asc.assoc_topk(grid, k).orderBy("id").collect()]
    for first in (0.9, 0.2):
        got = pairs.top_pairs(_items(cases), KEYS, k=k, first=first)
        assert [tuple(r) for r in got.orderBy("id").collect()] == want


def test_heavy_basket_is_cut_into_cells(cases):
    items = _items(cases)
    whole = pairs.co_occurrences(items, KEYS, "DRUGS", "TRAFFIC")
    cut = pairs.co_occurrences(items, KEYS, "DRUGS", "TRAFFIC", cell=8)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    keys = [*KEYS, "i", "j"]
    joins = [line for line in cut._jdf.queryExecution().toString().splitlines() if "SortMergeJoin" in line]
    assert any("i#" in line and "j#" in line for line in joins), keys


def test_no_grid_in_the_plans(cases):
    got = pairs.significant_pairs(_items(cases), KEYS, "DRUGS", "TRAFFIC")
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "_part_l" not in plan


def test_bound_holds_for_every_pair(grid):
    rows = grid.filter("chi2 IS NOT NULL").collect()
    for r in rows:
        mx, my = r.n11 + r.n10, r.n11 + r.n01
        assert (r.chi2 / r.n) ** 0.5 <= pairs.range_bound((mx, mx), (my, my), r.n)
        assert (r.chi2 / r.n) ** 0.5 <= pairs.range_bound((mx // 2 or 1, mx), (my, 2 * my), r.n)


def test_empty_and_one_sided_tables(spark):
    for rows in ([], [row(1, "2020-01-02", "2020-01-03", grp="DRUGS", charge="d")]):
        items = _items(snap(spark, rows))
        assert pairs.significant_pairs(items, KEYS, "DRUGS", "TRAFFIC").count() == 0
        assert pairs.top_pairs(items, KEYS).count() == 0
