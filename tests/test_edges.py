"""The awkward values of the edge table occur, and the operators meet them."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from snapcase.plans.oracles import CASES_CTE
from snapcase.sources.snapshots import edge_cases, edge_view

SF = "/root/testdata/sf0.01"


def test_every_edge_occurs(spark):
    raw, df = edge_view(spark, SF), edge_cases(spark, SF)
    found = raw.agg(F.count_if(F.col("CurrentAge") == 238).alias("sentinel"),
                    F.count_if(F.col("CurrentAge").between(68, 100)).alias("old"),
                    F.count_if(F.col("CurrentAge") == 100).alias("hundred"),
                    F.count_if(F.col("Charge").isNull()).alias("no_charge"),
                    F.count_if(F.col("RaceDescription").isNull()).alias("no_race"),
                    F.count_if(F.col("RaceDescription") == "UNKNOWN").alias("excluded"),
                    F.count_if(F.col("MaritalStatus").isNull()).alias("no_status")).first().asDict()
    assert all(n > 0 for n in found.values()), found
    assert 0 < df.count() < raw.count()


@pytest.mark.parametrize("name, condition", [
    ("edge_recode_group", "Charge IS NULL AND ChargeGroup IS NULL"),
    ("edge_count_complete", "n = 0"),
    ("edge_count_complete", "Race IS NULL"),
    ("edge_relabel_age", "Age = '85 and older' AND case_count > 0"),
    ("edge_relabel_age_published", "Age = '90 to 94' AND case_count > 0"),
    ("edge_significant_pairs", "n11 = 0 AND x_item = 'PROMO common' AND y_item = 'ECONOMY common'"),
    ("edge_pretrial_days", "dimension = 'Race' AND level IS NULL"),
    ("edge_group_itemsets", "race IS NULL"),
])
def test_results_show_the_edges(spark, name, condition):
    assert queries()[name](spark, SF).filter(condition).count() > 0


def test_excluded_races_are_left_out(spark):
    assert queries()["edge_count_complete"](spark, SF).filter("Race = 'UNKNOWN'").count() == 0


def test_edge_oracles_read_the_edge_view():
    for name, sql in oracle_sql().items():
        if name.startswith("edge_"):
            assert CASES_CTE.strip() not in sql and "PROMO common" in sql
