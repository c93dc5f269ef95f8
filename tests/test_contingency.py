import math

from conftest import row, snap

from snapcase.operators import contingency as ct
from snapcase.operators.loglinear import loglinear_fit
from snapcase.plans import params as P
from snapcase.sources.snapshots import cases

RACES = ("B", "W")


def test_flags_rescue_and_null_groups(spark):
    rows = [row(1, "2020-01-02", "2020-01-03", race="B", grp=None, charge="POSS CONT SUB X"),
            row(1, "2020-01-02", "2020-01-03", race="B", grp="TRAFFIC"),
            row(2, "2020-01-02", "2020-01-03", race="W", grp=None, charge="OTHER TEXT"),
            row(3, "2020-01-02", "2020-01-03", race="W", grp="THEFT"),
            row(4, "2020-01-02", "2020-01-03", race="Z", grp="DRUGS")]
    f = {r.BookingNumber: (r.drugs, r.traffic, r.other) for r in
         ct.episode_flags(snap(spark, rows), races=RACES).collect()}
    assert f == {1: ("Yes", "Yes", "No"), 3: ("No", "No", "Yes")}


def _flags(spark):
    return ct.episode_flags(cases(spark, "/root/testdata/sf0.001"), drug=P.DRUG_GROUP,
                            traffic=P.TRAFFIC_GROUP, races=(P.RACE_A, P.RACE_B),
                            rescue_pattern=P.RESCUE_PATTERN)


def test_xtab_is_zero_filled_and_sums(spark):
    flags = _flags(spark)
    xt = ct.xtab3(flags, (P.RACE_A, P.RACE_B)).collect()
    assert len(xt) == 8 and sum(r.freq for r in xt) == flags.count()
    assert [r.cell_order for r in sorted(xt, key=lambda r: r.cell_order)] == list(range(8))


def test_odds_ratio_inverts_when_races_swap(spark):
    flags = _flags(spark)
    a = {(r.orientation, r.given_level): r for r in
         ct.conditional_odds_ratio(flags, (P.RACE_A, P.RACE_B)).collect()}
    b = {(r.orientation, r.given_level): r for r in
         ct.conditional_odds_ratio(flags, (P.RACE_B, P.RACE_A)).collect()}
    for k in a:
        assert math.isclose(a[k].odds_ratio * b[k].odds_ratio, 1.0, rel_tol=1e-12)
        assert a[k].lwr < a[k].odds_ratio < a[k].upr
        assert a[k].contains_one == (a[k].lwr <= 1 <= a[k].upr)


def test_zero_cell_correction(spark):
    flags = spark.createDataFrame([("B", "Yes", "No", "No"), ("W", "No", "No", "No"),
                                   ("B", "No", "No", "No"), ("W", "Yes", "No", "No")] * 3,
                                  "race string, drugs string, traffic string, other string")
    r = {(x.orientation, x.given_level): x for x in
         ct.conditional_odds_ratio(flags, RACES).collect()}
    # every traffic=Yes cell is zero -> 0.5 added everywhere: OR = 1 in that stratum
    assert math.isclose(r[("drugs|traffic", "Yes")].odds_ratio, 1.0)
    assert math.isclose(r[("drugs|traffic", "No")].odds_ratio, (3.5 * 3.5) / (3.5 * 3.5))


def test_loglinear_nesting_and_saturated(spark):
    fit = {r.model: r for r in loglinear_fit(_flags(spark), (P.RACE_A, P.RACE_B)).collect()}
    g = {k: v.g2 for k, v in fit.items()}
    assert abs(g["saturated"]) < 1e-9 and fit["saturated"].p_g2 == 1.0
    assert g["independence"] >= g["joint_dt_r"] - 1e-9
    assert g["joint_dt_r"] >= g["conditional_dt_dr"] - 1e-9
    assert g["joint_dt_r"] >= g["conditional_dt_tr"] - 1e-9
    assert min(g["conditional_dt_dr"], g["conditional_dt_tr"]) >= g["homogeneous"] - 1e-9
    assert all(0 <= v.p_g2 <= 1 and v.x2 >= 0 for v in fit.values())
    assert [fit[m].df for m in ("independence", "joint_dt_r", "conditional_dt_dr",
                                "conditional_dt_tr", "homogeneous", "saturated")] == [4, 3, 2, 2, 1, 0]


def test_loglinear_strata(spark):
    flags = _flags(spark).withColumn("s", (ct.F.col("BookingNumber") % 2).cast("int"))
    out = loglinear_fit(flags, (P.RACE_A, P.RACE_B), strata=["s"]).collect()
    assert sorted({r.s for r in out}) == [0, 1] and len(out) == 12


def _cells(spark, counts):
    """Flags with the given counts in (race, drugs, traffic) order."""
    names = [(r, d, t) for r in RACES for d in ("No", "Yes") for t in ("No", "Yes")]
    rows = [(*k, "No", n) for k, n in zip(names, counts)]
    return spark.createDataFrame(rows, "race string, drugs string, traffic string, other string, n int") \
        .select("race", "drugs", "traffic", "other", ct.F.explode(ct.F.expr("array_repeat(1, n)"))).drop("col")


def test_homogeneous_fit_converges(spark):
    # Proportional fitting in plain Python, run until nothing moves.
    counts = [5000, 20, 15, 900, 1, 400, 2, 9000]
    names = [(r, d, t) for r in (0, 1) for d in (0, 1) for t in (0, 1)]
    n, m = dict(zip(names, counts)), dict.fromkeys(names, 1.0)
    for _ in range(5000):
        for axes in ((1, 2), (0, 1), (0, 2)):
            def margin(x, k):
                return sum(v for c, v in x.items() if all(c[a] == k[a] for a in axes))
            m = {k: v * margin(n, k) / margin(m, k) for k, v in m.items()}
    g2 = 2 * sum(n[k] * math.log(n[k] / m[k]) for k in names)
    fit = {r.model: r for r in loglinear_fit(_cells(spark, counts), RACES).collect()}
    assert math.isclose(fit["homogeneous"].g2, g2, rel_tol=1e-9)


def test_empty_margins_have_defined_results(spark):
    # no episode has a drug charge: the drugs=Yes margin is empty
    flags = _cells(spark, [3, 3, 0, 0, 3, 3, 0, 0])
    fit = {r.model: r for r in loglinear_fit(flags, RACES).collect()}
    assert all(r.g2 == 0.0 and r.x2 == 0.0 and r.p_g2 == 1.0 for r in fit.values())
    # one two-way margin is empty: the homogeneous model fits the rest exactly
    fit = {r.model: r for r in loglinear_fit(_cells(spark, [5, 2, 7, 0, 1, 4, 3, 0]), RACES).collect()}
    assert math.isclose(fit["homogeneous"].g2, 0.0, abs_tol=1e-12)
    assert fit["independence"].g2 > 0
