"""Itemsets, running sums, product-limit stays, interval joins, general tables and models,
bootstrap intervals and episode state against plain Python."""

import datetime as dt
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import row, snap
from pyspark.sql import functions as F

from snapcase.functions.stats import chisq_upper_p_any
from snapcase.operators import episodes as ep
from snapcase.operators import intervals, itemsets, resampling, survival, tables
from snapcase.operators.incremental import EpisodeState
from snapcase.operators.loglinear import loglinear_fit
from snapcase.operators.running import running_sums

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- itemsets ---------------------------------------------------------------

@pytest.mark.parametrize("anchor", [None, "A"])
@pytest.mark.parametrize("shard", [itemsets.SHARD, 16])
def test_itemsets_equal_enumeration(spark, anchor, shard, monkeypatch):
    monkeypatch.setattr(itemsets, "SHARD", shard)
    rng = random.Random(1)
    rows, held = [], defaultdict(set)
    for b in range(150):
        race = rng.choice(["R1", "R1", "R1", "R2", None])
        for g in rng.sample("ABCDE", rng.randint(0, 5)) + [None]:
            rows.append(row(b, "2020-01-02", "2020-01-03", race=race, grp=g))
            if g:
                held[b, race].add(g)
    rows += [row(1, "2020-01-02", "2020-01-03", race=rows[0][6], grp="A")] * 3
    found = Counter()
    for (b, race), groups in held.items():
        if anchor is None or anchor in groups:
            for k in range(1, len(groups) + 1):
                for s in itertools.combinations(sorted(groups), k):
                    if anchor is None or anchor in s:
                        found[race, s] += 1
    held[1, rows[0][6]].add("A")
    out = itemsets.frequent_itemsets(snap(spark, rows[:-3]), anchor=anchor, min_count=4)
    got = {(r.RaceDescription, tuple(r["items"])): r.episodes for r in out.collect()}
    assert got == {k: n for k, n in found.items() if n >= 4}
    assert itemsets.frequent_itemsets(snap(spark, []), anchor=anchor).count() == 0


# ---- running sums and survival ----------------------------------------------

@pytest.mark.parametrize("span", [1, 7, 1024])
def test_running_sums(spark, span):
    rng = random.Random(2)
    rows = [(g, n, rng.randint(-5, 5)) for g in ("a", None, "b") for n in rng.sample(range(-40, 60), 30)]
    out = running_sums(spark.createDataFrame(rows, "g string, n long, v long"), ["g"], "n", ["v"], span)
    assert rows_of(out) == sorted(((g, n, v, sum(w for h, m, w in rows if h == g and m <= n))
                                   for g, n, v in rows), key=str)


def test_product_limit(spark):
    rng = random.Random(3)
    stays = [(rng.choice(["x", "x", None]), DAY, day(rng.randint(0, 30)), rng.random() < 0.6) for _ in range(80)]
    stays += [("y", DAY, day(4), True), ("y", DAY, day(4), True), ("z", DAY, day(3), False)]
    df = spark.createDataFrame(stays, "RaceDescription string, start date, end date, ended boolean")
    curve = survival.product_limit(df)
    want, summary = [], []
    for race in ("x", None, "y", "z"):
        mine = [((e - s).days, d) for r, s, e, d in stays if r == race]
        alive, last, area, median = 1.0, 0, 0.0, None
        for t in sorted({n for n, _ in mine}):
            area += alive * (min(t, 20) - min(last, 20))
            risk, ended = sum(n >= t for n, _ in mine), sum(n == t and d for n, d in mine)
            alive *= 1 - ended / risk
            want.append((race, t, risk, ended, sum(n == t and not d for n, d in mine), round(alive, 9)))
            last, median = t, t if median is None and alive <= 0.5 + 1e-9 else median
        area += alive * (20 - min(last, 20))
        summary.append((race, len(mine), sum(d for _, d in mine), median, round(area, 9)))
    got = rows_of(curve.withColumn("survival", F.round("survival", 9)))
    assert got == sorted(want, key=str)
    got = rows_of(survival.survival_summary(curve, horizon=20).withColumn(
        "restricted_mean", F.round("restricted_mean", 9)))
    assert got == sorted(summary, key=str)


# ---- intervals --------------------------------------------------------------

def _stays(spark, seed=4, n=300):
    rng = random.Random(seed)
    rows = [(i, day(a := rng.randint(0, 400)), day(a + rng.choice([0, 1, 3, 90, 300]))) for i in range(n)]
    rows += [(n, day(5), None), (n + 1, None, day(9)), (n + 2, day(9), day(2))]
    return rows, spark.createDataFrame(rows, "id int, start date, end date")


@pytest.mark.parametrize("bucket", [1, 32, 1000])
def test_interval_join_with_many_overlapping_periods(spark, bucket):
    stays, df = _stays(spark)
    rng = random.Random(5)
    periods = [(f"p{i}", day(a := rng.randint(-20, 500)), day(a + rng.randint(0, 120))) for i in range(300)]
    out = intervals.days_by_period(df, spark.createDataFrame(periods, "period string, first_day date, last_day date"),
                                   rate=3, bucket=bucket)
    want = []
    for name, a, b in periods:
        days = [(min(e, b + dt.timedelta(1)) - max(s, a)).days for _, s, e in stays if s and e and s < e]
        days = [d for d in days if d > 0]
        if days:
            want.append((name, len(days), sum(days), 3 * sum(days)))
    assert rows_of(out) == sorted(want)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_many_periods_at_once(spark):
    _, df = _stays(spark)
    many = spark.range(10_000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("period"),
                                      F.expr("date_add(date'2020-01-01', cast(id % 400 as int))").alias("first_day"),
                                      F.expr("date_add(date'2020-01-01', cast(id % 400 + 30 as int))").alias("last_day"))
    fast = intervals.days_by_period(df, many).agg(F.sum("booking_days"), F.count("*")).first()
    slow = (df.filter("start < end").join(many, F.expr("start <= last_day AND first_day < end"))
            .selectExpr("period", "datediff(least(end, date_add(last_day, 1)), greatest(start, first_day)) AS d")
            .groupBy("period").agg(F.sum("d").alias("d")).agg(F.sum("d"), F.count("*")).first())
    assert tuple(fast) == tuple(slow)


def test_daily_headcount(spark):
    stays, df = _stays(spark)
    good = [(s, e) for _, s, e in stays if s and e and s < e]
    last = max(e for _, e in good)
    want, d = [], min(s for s, _ in good)
    while d <= last:
        want.append((d, sum(s <= d < e for s, e in good)))
        d += dt.timedelta(1)
    assert rows_of(intervals.daily_headcount(df)) == sorted(want, key=str)
    assert intervals.daily_headcount(df.limit(0)).count() == 0


# ---- tables and models ------------------------------------------------------

def test_chisq_tail_for_any_df(spark):
    def upper(x, df):
        """Simpson's rule over the density."""
        def density(t):
            return math.exp((df / 2 - 1) * math.log(t) - t / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
        n, a, b = 20_000, x, x + 60 + 12 * math.sqrt(2 * df) + df
        h = (b - a) / n
        return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * density(a + i * h) for i in range(n + 1))

    cases = [(x, k) for k in (1, 2, 3, 4, 5, 9, 16, 37, 200) for x in (0.5, 3.0, 20.0, 180.0)]
    out = spark.createDataFrame(cases, "x double, k long").select(
        "x", "k", chisq_upper_p_any(F.col("x"), F.col("k")).alias("p")).collect()
    for r in out:
        assert r.p == pytest.approx(upper(r.x, r.k), rel=1e-6, abs=1e-12)
    edge = spark.createDataFrame([(0.0, 3), (5.0, 0), (4000.0, 3000)], "x double, k long").select(
        chisq_upper_p_any(F.col("x"), F.col("k")).alias("p")).collect()
    assert edge[0].p == edge[1].p == 1.0 and 0 < edge[2].p < 1e-20


def test_association_table_equals_dense_form(spark):
    rng = random.Random(6)
    rows = [(s, f"a{rng.choice([0, 0, 1, 2, 3, 4])}", f"b{rng.randint(0, 6)}") for s in ("s", None) for _ in range(60)]
    rows += [("two", f"a{i % 2}", f"b{i % 3 % 2}") for i in range(30)] + [("one", "a", f"b{i}") for i in range(4)]
    rows += [("s", None, "b1"), ("s", "a1", None)]
    out = {r.s: r for r in tables.association_table(
        spark.createDataFrame(rows, "s string, a string, b string"), "a", "b", ["s"]).collect()}
    for s in ("s", None, "two", "one"):
        cells = Counter((a, b) for t, a, b in rows if t == s and a and b)
        a_s, b_s = sorted({a for a, _ in cells}), sorted({b for _, b in cells})
        n = np.array([[cells[a, b] for b in b_s] for a in a_s], dtype=float)
        e = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / n.sum()
        off = np.abs(n - e)
        chi2 = (((off - np.minimum(off, 0.5)) if n.shape == (2, 2) else off) ** 2 / e).sum()
        assert out[s].chi2 == pytest.approx(chi2, abs=1e-9) and out[s].df == (len(a_s) - 1) * (len(b_s) - 1)
        small = min(n.shape) - 1
        assert out[s].cramers_v == (pytest.approx(math.sqrt(chi2 / n.sum() / small)) if small else None)
    assert out["s"].df > 4 and out["one"].p_value is None


def test_models_equal_the_two_by_two_by_two_fit(spark):
    rng = random.Random(7)
    flags = [(rng.choice(["A", "B"]), rng.choice(["Yes", "No", "No"]), rng.choice(["Yes", "No"])) for _ in range(400)]
    df = spark.createDataFrame([(i, *f, "No") for i, f in enumerate(flags)],
                               "BookingNumber int, race string, drugs string, traffic string, other string")
    old = {r.model: r for r in loglinear_fit(df, ("A", "B")).collect()}
    new = {r.model: r for r in tables.loglinear_models(df, ["race", "drugs", "traffic"],
                                                       tables.standard_models()).collect()}
    assert set(old) == set(new)
    for name, r in new.items():
        assert r.df == old[name].df
        for c in ("g2", "x2", "p_g2", "p_x2"):
            assert r[c] == pytest.approx(old[name][c], abs=1e-7)


def test_models_keep_their_margins_in_four_ways(spark):
    rng = random.Random(8)
    rows = [tuple(f"{f}{rng.randrange(k)}" for f, k in (("a", 3), ("b", 2), ("c", 4), ("d", 2))) for _ in range(300)]
    rows = [r for r in rows if not (r[0] == "a1" and r[2] == "c2")]
    margins = [["a", "c"], ["b", "c", "d"], ["a", "b"]]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    cells = tables.fitted_cells(df, list("abcd"), {"m": margins}).toPandas()
    assert len(cells) == 48
    for keep in margins:
        sums = cells.groupby(keep)[["n", "m"]].sum()
        np.testing.assert_allclose(sums["m"], sums["n"], atol=1e-8)
    # No interaction beyond the margins: the log odds ratios of a and d are equal given b and c.
    m = {tuple(r): x for *r, x in cells[["a", "b", "c", "d", "m"]].itertuples(index=False)}
    for b, c in (("b0", "c0"), ("b1", "c3")):
        ratio = m["a0", b, c, "d0"] * m["a2", b, c, "d1"] / (m["a0", b, c, "d1"] * m["a2", b, c, "d0"])
        assert ratio == pytest.approx(1.0, abs=1e-8)
    out = tables.loglinear_models(df, list("abcd"), {"m": margins}).first()
    assert out.df == 48 - (12 + 16 - 4 + 2 * 1)


def test_strata_and_empty_tables(spark):
    rows = [("s", "A", "x"), ("s", "B", "y"), ("s", "A", "y"), (None, "A", "x"), (None, "B", None)]
    df = spark.createDataFrame(rows, "t string, f string, g string")
    out = {r.t: r for r in tables.loglinear_models(df, ["f", "g"], {"apart": [["f"], ["g"]]}, ["t"]).collect()}
    assert out["s"].df == 1 and out[None].df == 0 and out[None].g2 == 0
    assert tables.loglinear_models(df.limit(0), ["f", "g"], {"m": [["f"]]}, ["t"]).count() == 0
    assert tables.association_table(df.limit(0), "f", "g").count() == 0


# ---- resampling -------------------------------------------------------------

def test_intervals_are_reproducible_and_cover(spark):
    rng = random.Random(9)
    rows = []
    for c in range(300):
        level = rng.choice(["x", "x", "y", None])
        rows += [(f"c{c}", level)] * rng.randint(1, 6)
    df = spark.createDataFrame(rows, "c string, level string")
    out = rows_of(resampling.share_intervals(df, "level", ["c"], replicates=200))
    assert out == rows_of(resampling.share_intervals(df.repartition(7), "level", ["c"], replicates=200))
    # Plain resampling of whole clusters.
    by = defaultdict(list)
    for c, level in rows:
        by[c].append(level)
    names, draws = sorted(by), defaultdict(list)
    for _ in range(400):
        sample = [x for c in rng.choices(names, k=len(names)) for x in by[c]]
        for level in ("x", "y", None):
            draws[level].append(sample.count(level) / len(sample))
    for level, n, share, lower, upper in out:
        mine = sorted(draws[level])
        assert lower < share < upper and n == sum(x == level for _, x in rows)
        assert lower == pytest.approx(mine[10], abs=0.02) and upper == pytest.approx(mine[389], abs=0.02)


def test_poisson_weights(spark):
    w = spark.range(4000).select(resampling.poisson_weights(F.col("id"), 16).alias("w")).select(F.explode("w").alias("w"))
    n = {r.w: r["count"] / 64000 for r in w.groupBy("w").count().collect()}
    for k in range(4):
        assert n[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.008)


# ---- episode state ----------------------------------------------------------

def test_episode_state_day_by_day(spark):
    rng = random.Random(10)
    rows = []
    for b in range(40):
        start = rng.randint(1, 9)
        for d in range(start, start + rng.randint(1, 8)):
            for _ in range(rng.randint(1, 2)):
                rows.append(row(b % 30, f"2020-01-{start:02d}", f"2020-01-{d:02d} 0{rng.randint(1, 9)}:00:00",
                                age=rng.randint(18, 60), charge=rng.choice(["c", "d"]),
                                disp=rng.choice([None, None, None, "X"])))
    df = snap(spark, rows).cache()
    carry = ["CurrentAge", "Charge"]
    state = EpisodeState(spark, carry)
    days = [f"2020-01-{d:02d}" for d in range(1, 18)]
    for d in [*days[:9], days[4], *days[9:], days[-1]]:
        state.add(df.filter(F.to_date("SnapshotDateTime") == F.lit(d).cast("date")))
    assert rows_of(state.ends()) == rows_of(ep.episode_end(df))
    first = ep.first_obs_per_episode(ep.pretrial_exposure(df), carry)
    assert rows_of(state.first_exposed()) == rows_of(first)
    assert rows_of(ep.first_exposed_per_episode(df, carry)) == rows_of(first)
    assert rows_of(state.first_rows()) == rows_of(ep.first_obs_per_episode(df, carry))


