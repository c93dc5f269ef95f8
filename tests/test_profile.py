from conftest import row, snap

from snapcase.operators import profile as pr
from snapcase.plans import params as P
from snapcase.sources.snapshots import cases


def test_profile_counts_title_and_missing(spark):
    df = snap(spark, [row(1, "2020-01-02", "2020-01-03", ms="SINGLE"),
                      row(2, "2020-01-02", "2020-01-03", ms="single"),
                      row(3, "2020-01-02", "2020-01-03", ms=None)])
    df = pr.with_age_group(df)
    got = {(r.groupname, r.rowname): r.n for r in pr.profile_counts(df).collect()}
    assert got[("Marital Status", "Single")] == 2
    assert got[("Marital Status", "Missing")] == 1
    assert got[("Age", "[ 30, 40)")] == 3


def test_monthly_total_row_identical_across_groups(spark):
    wide = pr.profile_monthly_counts(cases(spark, "/root/testdata/sf0.001"), P.YEAR, "MISDEMEANOR")
    totals = [tuple(r[m] for m in pr.MONTHS) for r in wide.filter("is_total").collect()]
    assert len(totals) == 4 and len(set(totals)) == 1 and sum(totals[0]) > 0


def test_period_shares_sum_to_one(spark):
    wide = pr.profile_period_shares(cases(spark, "/root/testdata/sf0.001"), P.PERIODS,
                                    P.CATEGORIES)
    cols = [c for c in wide.columns if c.startswith("n_")]
    rows = wide.collect()
    for c in cols:
        for g in {r.groupname for r in rows}:
            s = sum(r[c] for r in rows if r.groupname == g)
            assert s == 0 or abs(s - 1) < 1e-9


def test_share_display_format(spark):
    wide = spark.createDataFrame([("Gender", "F", 0.03125, None)],
                                 "groupname string, rowname string, a double, b double")
    r = pr.share_display(wide, [("p", "a", "b")]).collect()[0]
    assert r.p == "3.13%<br>(0.00%)"
