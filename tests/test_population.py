from pyspark.sql import functions as F

from snapcase.operators import population as pop


def test_not_in_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert sorted((r.x or "") for r in df.filter(pop.not_in(F.col("x"), ["a"])).collect()) == ["", "b"]


def test_merge_categories_sums_members_only(spark):
    df = spark.createDataFrame([("A", "1", 2), ("P", "1", 3), ("W", "1", 5), ("A", "2", 1)],
                               "Race string, Age string, ref_count long")
    got = sorted(tuple(r) for r in pop.merge_categories(df, "Race", ["A", "P"], "AP", "ref_count")
                 .select("Race", "Age", "ref_count").collect())
    assert got == [("AP", "1", 5), ("AP", "2", 1), ("W", "1", 5)]


def test_count_complete_zero_fill_with_null_level(spark):
    df = spark.createDataFrame([("r1", "M", "a"), ("r1", "M", "a"), ("r2", "F", None)],
                               "Race string, Gender string, Age string")
    got = {(r.Race, r.Gender, r.Age): r.n for r in pop.count_complete(df, ["Race", "Gender", "Age"]).collect()}
    assert len(got) == 8 and got[("r1", "M", "a")] == 2 and got[("r2", "F", None)] == 1
    assert got[("r2", "M", "a")] == 0


def test_population_compare_signs_and_shares(spark):
    ref = spark.createDataFrame([("R", "20 to 24", "Male", 10), ("R", "20 to 24", "Female", 30)],
                                "Race string, Age string, Gender string, ref_count long")
    cs = spark.createDataFrame([("R", "Male", "20 to 24", 1), ("R", "Female", "20 to 24", 3)],
                               "Race string, Gender string, Age string, case_count long")
    rows = pop.population_compare(ref, cs).collect()
    for grp in ("reference", "cases"):
        sel = [r for r in rows if r.Group == grp]
        assert abs(sum(abs(r.Proportion) for r in sel) - 100) < 1e-9
        assert all((r.Value < 0) == (r.Gender == "Male") for r in sel)
    comp = pop.group_composition(pop.population_compare(ref, cs)).collect()
    assert {r.Group for r in comp} == {"Reference population", "Case population"}


def test_count_complete_has_every_combination_once(spark):
    df = spark.range(60).selectExpr("cast(id as string) AS a", "nullif(id % 7, 0) AS b",
                                    "id % 2 = 0 AS c")
    got = [(r.a, r.b, r.c, r.n) for r in pop.count_complete(df, ["a", "b", "c"]).collect()]
    assert len(got) == len({g[:3] for g in got}) == 60 * 7 * 2
    assert sum(g[3] for g in got) == 60 and ("7", None, False, 1) in got
