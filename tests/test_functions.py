import math

from pyspark.sql import functions as F

from snapcase.functions.bins import cut_bins, interval_to_range_label
from snapcase.functions.stats import chisq_upper_p, gamma_q_half, yates_chisq
from snapcase.functions.text import percent_text, sentence_case, title_case


def _one(spark, expr, values, typ="int"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_cut_bins_edges(spark):
    got = _one(spark, lambda x: cut_bins(x, 0, 100, 10), [0, 9, 10, 20, 99, 100, 101, -1, None])
    assert got == ["[  0, 10)", "[  0, 10)", "[ 10, 20)", "[ 20, 30)", "[ 90,100]", "[ 90,100]",
                   None, None, None]


def test_cut_bins_width5(spark):
    got = _one(spark, lambda x: cut_bins(x, 0, 100, 5), [18, 95, 100])
    assert got == ["[ 15, 20)", "[ 95,100]", "[ 95,100]"]


def test_interval_to_range_label(spark):
    got = _one(spark, interval_to_range_label, ["[ 20, 25)", "[ 95,100]", "[  5, 10)"], "string")
    assert got == ["20 to 24", "95 to 99", " 5 to 9"]


def test_title_case_word_boundaries(spark):
    got = _one(spark, title_case, ["BLACK-ORIGINS OF AFRICA", "White/Eurp/ N.Afr/Mid Eas",
                                   "1-URGENT", "[ 20, 30)", "o'neil", None, ""], "string")
    assert got == ["Black-Origins Of Africa", "White/Eurp/ N.afr/Mid Eas", "1-Urgent",
                   "[ 20, 30)", "O'neil", None, ""]


def test_sentence_case(spark):
    assert _one(spark, sentence_case, ["SPEEDING 1MPH OVER"], "string") == ["Speeding 1mph over"]


def test_percent_text_half_up(spark):
    got = _one(spark, lambda x: percent_text(x, 2), [0.03125, 0.5, 0.0, 1.0, 2 / 3], "double")
    assert got == ["3.13%", "50.00%", "0.00%", "100.00%", "66.67%"]
    assert _one(spark, lambda x: percent_text(x, 1), [0.0125], "double") == ["1.3%"]


def test_gamma_q_half_is_erfc(spark):
    zs = [0.0, 1e-9, 0.01, 0.5, 1.0, 1.4999, 1.5, 2.0, 9.0, 40.0, 300.0]
    got = _one(spark, gamma_q_half, zs, "double")
    for z, g in zip(zs, got):
        ref = math.erfc(math.sqrt(z))
        assert abs(g - ref) <= 1e-12 * ref + 1e-300, (z, g, ref)


def test_chisq_upper_tail_closed_forms(spark):
    xs = [0.5, 3.841458820694124, 10.0]
    p1 = _one(spark, lambda x: chisq_upper_p(x, 1), xs, "double")
    assert abs(p1[1] - 0.05) < 1e-13
    for df, ref in ((2, lambda x: math.exp(-x / 2)), (4, lambda x: math.exp(-x / 2) * (1 + x / 2))):
        got = _one(spark, lambda x: chisq_upper_p(x, df), xs, "double")
        for x, g in zip(xs, got):
            assert abs(g - ref(x)) < 1e-12
    p3 = _one(spark, lambda x: chisq_upper_p(x, 3), [7.814727903251178], "double")
    assert abs(p3[0] - 0.05) < 1e-13


def test_yates_matches_cell_by_cell(spark):
    cases = [(3, 10, 7, 50), (0, 12, 20, 100), (5, 5, 5, 5), (1, 2, 3, 40)]
    df = spark.createDataFrame(cases, "n11 long, mx long, my long, n long")
    got = [r[0] for r in df.select(yates_chisq(F.col("n11"), F.col("mx"), F.col("my"),
                                               F.col("n"))).collect()]
    for (n11, mx, my, n), g in zip(cases, got):
        obs = [n11, mx - n11, my - n11, n - mx - my + n11]
        exp = [mx * my / n, mx * (n - my) / n, (n - mx) * my / n, (n - mx) * (n - my) / n]
        if min(mx, n - mx, my, n - my) == 0:
            assert g is None
            continue
        yates = min(0.5, abs(obs[0] - exp[0]))
        ref = sum((abs(o - e) - yates) ** 2 / e for o, e in zip(obs, exp))
        assert abs(g - ref) < 1e-9 * max(1.0, ref)
