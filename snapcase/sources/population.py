"""Population estimates input (RACE, AGEGROUP, SEX, HISP, value).

On a cluster this is a table read like any other.  For the driver's test
tables it is derived from ``customer`` (FIXTURES F2): age
``18 + c_custkey % 50`` in five-year groups, sex from key parity (the same
rule as the case view's gender), race labels from the market segment and
origin from the nation.  Total rows ("All ages", "All races", "Both sexes",
"Both Hispanic Origins") come from grouping sets, as published estimates
carry them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcase.sources.snapshots import read_table

# Race label of each market segment in the derived table.
SEGMENT_RACE = (
    ("AUTOMOBILE", "Black alone"),
    ("BUILDING", "White alone"),
    ("FURNITURE", "American Indian and Alaska Native alone"),
    ("MACHINERY", "Two or more races"),
)
ASIAN = "Asian alone"
PACIFIC = "Native Hawaiian and Other Pacific Islander alone"


def population_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    age = F.lit(18) + F.col("c_custkey") % 50
    lo = (F.floor(age / 5) * 5).cast("int")
    race = F.when(F.col("c_mktsegment") == "HOUSEHOLD",
                  F.when(F.col("c_custkey") % 3 == 0, F.lit(PACIFIC)).otherwise(F.lit(ASIAN)))
    for seg, label in SEGMENT_RACE:
        race = race.when(F.col("c_mktsegment") == seg, F.lit(label))
    base = c.select(
        race.alias("RACE"),
        F.concat(F.lit("Age "), lo.cast("string"), F.lit(" to "), (lo + 4).cast("string"),
                 F.lit(" years")).alias("AGEGROUP"),
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("SEX"),
        F.when(F.col("c_nationkey") % 4 == 0, "Hispanic").otherwise("Non-Hispanic").alias("HISP"))
    dims = ["RACE", "AGEGROUP", "SEX", "HISP"]
    totals = {"RACE": "All races", "AGEGROUP": "All ages", "SEX": "Both sexes",
              "HISP": "Both Hispanic Origins"}
    sets = [dims] + [[d for d in dims if d != drop] for drop in dims]
    agg = base.groupingSets(sets, *dims).agg(F.count(F.lit(1)).alias("value"),
                                             *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    return agg.select(*[F.when(F.col(f"_g_{d}") == 1, F.lit(totals[d])).otherwise(F.col(d)).alias(d)
                        for d in dims], F.col("value").cast("long").alias("value"))
