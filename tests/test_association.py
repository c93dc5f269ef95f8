import math

from conftest import row, snap

from snapcase.operators import association as asc


def _baskets(spark):
    # baskets 1-4: d1 with t1 in 1,2; d2 alone in 3; t2 alone in 4; basket 5 only other items
    rows = []
    spec = {1: ["d1", "t1", "d1"], 2: ["d1", "t1"], 3: ["d2"], 4: ["t2"], 5: ["o"]}
    for b, items in spec.items():
        for it in items:
            grp = {"d": "DRUGS", "t": "TRAFFIC"}.get(it[0], "OTHER")
            rows.append(row(b, "2020-01-02", "2020-01-03", grp=grp, charge=it))
    return snap(spark, rows)


def test_pair_contingency_basket_grain(spark):
    pairs = {(r.x_item, r.y_item): r for r in
             asc.item_pair_contingency(_baskets(spark), "DRUGS", "TRAFFIC").collect()}
    assert set(pairs) == {("d1", "t1"), ("d1", "t2"), ("d2", "t1"), ("d2", "t2")}
    p = pairs[("d1", "t1")]
    assert (p.n11, p.n10, p.n01, p.n00, p.n) == (2, 0, 0, 2, 4)
    for r in pairs.values():
        assert r.n11 + r.n10 + r.n01 + r.n00 == r.n == 4
    q = pairs[("d2", "t2")]
    assert (q.n11, q.n10, q.n01, q.n00) == (0, 1, 1, 2)


def test_item_grain_never_cooccurs(spark):
    pairs = asc.item_pair_contingency(_baskets(spark), "DRUGS", "TRAFFIC", grain="item").collect()
    assert all(r.n11 == 0 for r in pairs)
    assert {r.n for r in pairs} == {6}     # distinct (basket, charge) rows of both groups


def test_sparse_mode_lists_only_cooccurring(spark):
    pairs = asc.item_pair_contingency(_baskets(spark), "DRUGS", "TRAFFIC", zero_fill=False)
    assert [(r.x_item, r.y_item) for r in pairs.collect()] == [("d1", "t1")]


def test_cramers_v_range_and_mask(spark):
    v = asc.cramers_v(asc.item_pair_contingency(_baskets(spark), "DRUGS", "TRAFFIC")).collect()
    for r in v:
        if r.chi2 is not None:
            assert r.chi2 >= 0 and 0 <= r.p_value <= 1
        if r.cramers_v is not None:
            assert 0 <= r.cramers_v <= 1 and r.chi2 > 3.841458820694124
    # tiny table: nothing is significant
    assert all(r.cramers_v is None for r in v)


def test_constant_item_gives_null(spark):
    rows = [row(b, "2020-01-02", "2020-01-03", grp="DRUGS", charge="d") for b in range(1, 5)]
    rows += [row(b, "2020-01-02", "2020-01-03", grp="TRAFFIC", charge="t") for b in (1, 2)]
    r = asc.cramers_v(asc.item_pair_contingency(snap(spark, rows), "DRUGS", "TRAFFIC")).collect()
    assert r[0].chi2 is None and r[0].cramers_v is None


def test_topk_order_and_cross_variant(spark):
    v = spark.createDataFrame(
        [("x1", "y1", 0.5), ("x2", "y1", 0.5), ("x1", "y2", 0.2), ("x3", "y3", 0.9),
         ("x3", "y1", None), ("x2", "y2", 0.1)],
        "x_item string, y_item string, cramers_v double")
    top = [(r.id, r.drug_charge, r.traffic_charge) for r in asc.assoc_topk(v, 3).collect()]
    assert top == [(1, "x3", "y3"), (2, "x1", "y1"), (3, "x2", "y1")]
    cross = asc.assoc_topk_cross(v, 3).collect()
    # rows {y3, y1} x cols {x3, x1, x2}: non-null cells x3y3, x1y1, x2y1
    assert sorted((r.drug_charge, r.traffic_charge) for r in cross) == \
        [("x1", "y1"), ("x2", "y1"), ("x3", "y3")]


def test_pair_breakdown_either_and_both(spark):
    rows = [row(1, "2020-01-02", "2020-01-03", race="A", charge="d1"),
            row(1, "2020-01-02", "2020-01-03", race="A", charge="t1"),
            row(2, "2020-01-02", "2020-01-03", race="B", charge="d1"),
            row(3, "2020-01-02", "2020-01-03", race=None, charge="t1")]
    top = spark.createDataFrame([(1, "t1", "d1", 0.4)],
                                "id int, traffic_charge string, drug_charge string, cramers_v double")
    either = {r.race: (r.n, r.proportion) for r in asc.pair_breakdown(snap(spark, rows), top).collect()}
    assert either == {"A": (1, 1 / 3), "B": (1, 1 / 3), None: (1, 1 / 3)}
    both = asc.pair_breakdown(snap(spark, rows), top, mode="both").collect()
    assert [(r.race, r.n, r.proportion) for r in both] == [("A", 1, 1.0)]
    excl = asc.pair_breakdown(snap(spark, rows), top, exclude=["B"]).collect()
    assert sorted(r.race or "" for r in excl) == ["", "A"]
    assert all(math.isclose(r.proportion, 1 / 3) for r in excl)


def test_indicator_matrix(spark):
    m = {r.BookingNumber: (r.d1, r.t1, r.t2) for r in
         asc.indicator_matrix(_baskets(spark), ["d1", "t1", "t2"], ["DRUGS", "TRAFFIC"]).collect()}
    assert m == {1: (1, 1, 0), 2: (1, 1, 0), 3: (0, 0, 0), 4: (0, 0, 1)}


def test_zero_pair_can_be_significant(spark):
    rows = [row(b, "2020-01-02", "2020-01-03", grp="DRUGS" if b <= 20 else "TRAFFIC",
                charge="d1" if b <= 20 else "t1") for b in range(1, 41)]
    v = asc.cramers_v(asc.item_pair_contingency(snap(spark, rows), "DRUGS", "TRAFFIC")).collect()
    assert [(r.x_item, r.y_item, r.n11) for r in v] == [("d1", "t1", 0)]
    assert v[0].cramers_v > 0.9


def test_pairs_without_items_on_one_side_are_none(spark):
    rows = [row(1, "2020-01-02", "2020-01-03", grp="DRUGS", charge="d1")]
    assert asc.item_pair_contingency(snap(spark, rows), "DRUGS", "TRAFFIC").collect() == []
