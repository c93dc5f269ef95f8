"""Facts recorded in FIXTURES.md for the driver tables, checked with the operators."""

import pytest
from pyspark.sql import functions as F

from snapcase.operators import association as asc
from snapcase.operators import contingency as ct
from snapcase.operators import episodes as ep
from snapcase.plans import params as P
from snapcase.sources.snapshots import cases

FACTS = {
    "/root/testdata/sf0.001": dict(exposure=(316, 265), first_period=(39, 33), min_cell=45, ties=0),
    "/root/testdata/sf0.01": dict(exposure=(2726, 2785), first_period=(386, 342), min_cell=666,
                                  ties=13),
}


@pytest.mark.parametrize("sf", sorted(FACTS))
def test_fixture_facts(spark, sf):
    facts = FACTS[sf]
    df = cases(spark, sf)
    ex = ep.pretrial_exposure(df)
    by_cat = {r.ChargeCategory: r["count"] for r in ex.groupBy("ChargeCategory").count().collect()}
    assert (by_cat["FELONY"], by_cat["MISDEMEANOR"]) == facts["exposure"]
    start, end = P.PERIODS[0][1], P.PERIODS[0][2]
    day = F.to_date("SnapshotDateTime")
    first = {r.ChargeCategory: r["count"] for r in
             ex.filter((day >= F.lit(start)) & (day <= F.lit(end))).groupBy("ChargeCategory").count().collect()}
    assert (first["FELONY"], first["MISDEMEANOR"]) == facts["first_period"]
    # recorded with the original rescue pattern, which matches no test charge
    flags = ct.episode_flags(df, drug=P.DRUG_GROUP, traffic=P.TRAFFIC_GROUP,
                             races=(P.RACE_A, P.RACE_B), rescue_pattern="POSS CONT SUB")
    assert min(r.freq for r in ct.xtab3(flags, (P.RACE_A, P.RACE_B)).collect()) == facts["min_cell"]
    firsts = df.groupBy("BookingNumber", "BookingDate").agg(F.min("SnapshotDateTime").alias("t"))
    tied = (df.join(firsts, ["BookingNumber", "BookingDate"])
              .filter(F.col("SnapshotDateTime") == F.col("t"))
              .groupBy("BookingNumber", "BookingDate").count().filter("count > 1").count())
    assert tied == facts["ties"]


def test_pair_facts_sf001(spark):
    v = asc.cramers_v(asc.item_pair_contingency(cases(spark, "/root/testdata/sf0.01"),
                                                P.DRUG_GROUP, P.TRAFFIC_GROUP)).collect()
    assert len(v) == 625
    assert sum(r.cramers_v is not None for r in v) == 66
