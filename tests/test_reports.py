"""The one-call reports compose on the test data (test roles as overrides)."""

from snapcase.plans import params as P
from snapcase.plans import reports as rp
from snapcase.sources.population import population_estimates
from snapcase.sources.sinks import read_report, save_report
from snapcase.sources.snapshots import cases

SF = "/root/testdata/sf0.001"


def test_reports_compose_and_run(spark):
    df = cases(spark, SF)
    fiscal = rp.fiscal_profile(df, P.PERIODS)
    assert fiscal["display"].count() == fiscal["shares"].count() > 0
    monthly = rp.monthly_profile(df, P.YEAR)
    assert len(monthly["display"].columns) == 14
    assoc = rp.association(df, drug=P.DRUG_GROUP, traffic=P.TRAFFIC_GROUP,
                           races=(P.RACE_A, P.RACE_B), corrections=P.RECODE_RULES,
                           rescue_pattern=P.RESCUE_PATTERN)
    assert assoc["loglinear"].count() == 6 and assoc["odds_ratios"].count() == 4
    assert assoc["pairs"].count() > 0
    cells = assoc["matrix"].unpivot("y_item", None, "x_item", "v").filter("v IS NOT NULL")
    assert cells.count() == assoc["pairs"].count()
    assert assoc["by_race_display"].count() == assoc["by_race"].count() > 0
    # All tables of the report are saved, each in the run's own folder.
    paths = save_report(assoc, "association")
    assert set(paths) == set(assoc)
    back = read_report(spark, "association", ["top", "matrix"])
    assert back["top"].count() == assoc["top"].count() and back["matrix"].columns == assoc["matrix"].columns
    qs = rp.pretrial_questions(df, P.PERIODS, warrant=P.WARRANT_GROUP, anchor=P.DRUG_GROUP)
    assert all(d.count() > 0 for d in qs.values())


def test_population_report(spark):
    est = population_estimates(spark, SF)
    out = rp.population_pyramid(cases(spark, SF), est, P.YEAR)
    # default labels do not match the test segments: the join is empty but valid
    assert out["pyramid"].columns == ["Age", "Gender", "Race", "Group", "Value", "Total",
                                      "Proportion"]
    mapped = rp.population_pyramid(cases(spark, SF), est, P.YEAR, recode=P.POP_RACE_RECODE,
                                   merge=P.POP_MERGE, origin_label=P.POP_ORIGIN_LABEL,
                                   exclude=P.CASE_EXCLUDED)
    comp = mapped["composition"].collect()
    for grp in {r.Group for r in comp}:
        assert abs(sum(r.Proportion for r in comp if r.Group == grp) - 100) < 1e-9
    ave = mapped["actual_vs_expected"].collect()
    assert sum(r.observed for r in ave) == round(sum(r.expected for r in ave))


def test_correction_rules_last_wins():
    last = dict(rp.CHARGE_CORRECTIONS)
    assert last["POSSESSION OF STOLEN MAIL"] == "GENERAL FELONY"
    assert len(rp.CHARGE_CORRECTIONS) == 11
