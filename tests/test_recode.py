from conftest import row, snap

from snapcase.operators.recode import recode_group, short_names
from snapcase.sources.dimensions import CATEGORY_SHORT_NAMES, category_dimension

RULES = [("A", "X"), ("B", "Y"), ("A", "Z")]


def test_last_rule_wins_and_null_key_wipes(spark):
    df = snap(spark, [row(1, "2020-01-02", "2020-01-03", charge="A", grp="G"),
                      row(2, "2020-01-02", "2020-01-03", charge="C", grp="G"),
                      row(3, "2020-01-02", "2020-01-03", charge=None, grp="G")])
    got = {r.BookingNumber: r.ChargeGroup for r in recode_group(df, RULES).collect()}
    assert got == {1: "Z", 2: "G", 3: None}
    keep = {r.BookingNumber: r.ChargeGroup
            for r in recode_group(df, RULES, null_key_wipes=False).collect()}
    assert keep[3] == "G"


def test_dataframe_rules_match_list_rules(spark):
    df = snap(spark, [row(i, "2020-01-02", "2020-01-03", charge=c)
                      for i, c in enumerate(["A", "B", "C", None])])
    rules = spark.createDataFrame([(v, c, i) for i, (v, c) in enumerate(RULES)],
                                  "value string, category string, ordinal int")
    a = sorted((r.BookingNumber, r.ChargeGroup) for r in recode_group(df, RULES).collect())
    b = sorted((r.BookingNumber, r.ChargeGroup) for r in recode_group(df, rules).collect())
    assert a == b


def test_short_names_fall_back_to_long(spark):
    assert len(CATEGORY_SHORT_NAMES) == 65
    df = snap(spark, [row(1, "2020-01-02", "2020-01-03", grp="DV PROTECTIVE ORDER"),
                      row(2, "2020-01-02", "2020-01-03", grp="UNLISTED")])
    got = {r.BookingNumber: r.ChargeGroupShort
           for r in short_names(df, category_dimension(spark)).collect()}
    assert got == {1: "DV PRO. ORD.", 2: "UNLISTED"}
    as_map = {r.BookingNumber: r.ChargeGroupShort
              for r in short_names(df, CATEGORY_SHORT_NAMES).collect()}
    assert as_map == got


def test_dimension_is_sized_and_broadcast(spark):
    df = snap(spark, [row(1, "2020-01-02", "2020-01-03", grp="DRUGS")])
    plan = short_names(df, category_dimension(spark))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
