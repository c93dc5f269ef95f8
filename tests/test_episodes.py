import datetime as dt

from conftest import row, snap
from pyspark.sql import functions as F

from snapcase.operators import episodes as ep
from snapcase.sources.snapshots import drop_bad_values


def _rows():
    return [
        # episode 1: disposition from 01-05; booked after the first snapshot day
        row(1, "2020-01-02", "2020-01-03"), row(1, "2020-01-02", "2020-01-04"),
        row(1, "2020-01-02", "2020-01-05", disp="GUILTY"), row(1, "2020-01-02", "2020-01-06"),
        # episode 2: never disposed -> no end
        row(2, "2020-01-02", "2020-01-03"),
        # episode 3: booked before the first snapshot day of disposed bookings -> excluded
        row(3, "2019-12-31", "2020-01-01"), row(3, "2019-12-31", "2020-01-02", disp="X"),
        # episode 4: same booking number as 1, other booking date (its own episode)
        row(1, "2020-01-10", "2020-01-10"), row(1, "2020-01-10", "2020-01-12", disp="X"),
    ]


def test_episode_end_semantics(spark):
    df = snap(spark, _rows())
    got = {(r[0], r[1].date()): r[2] for r in ep.episode_end(df).collect()}
    # first snapshot day among disposed bookings is 2020-01-01 (booking 3),
    # so booking 3 (booked 2019-12-31) is dropped
    assert got == {(1, dt.date(2020, 1, 2)): dt.date(2020, 1, 5),
                   (1, dt.date(2020, 1, 10)): dt.date(2020, 1, 12)}


def test_exposure_is_strictly_before_end(spark):
    df = snap(spark, _rows())
    got = sorted((r.BookingNumber, r.SnapshotDateTime.date().isoformat())
                 for r in ep.pretrial_exposure(df).collect())
    assert got == [(1, "2020-01-03"), (1, "2020-01-04"), (1, "2020-01-10")]


def test_first_per_group_breaks_ties_with_nulls_first(spark):
    df = snap(spark, [row(1, "2020-01-02", "2020-01-03", ms="Single"),
                      row(1, "2020-01-02", "2020-01-03", ms=None),
                      row(1, "2020-01-02", "2020-01-02", ms="Married", g="F")])
    r = ep.first_obs_per_episode(df, ["Gender", "MaritalStatus"]).collect()
    assert len(r) == 1 and r[0].Gender == "F" and r[0].MaritalStatus == "Married"
    df2 = df.filter(F.col("SnapshotDateTime") > F.lit("2020-01-02").cast("timestamp_ntz"))
    r2 = ep.first_obs_per_episode(df2, ["Gender", "MaritalStatus"]).collect()
    assert r2[0].MaritalStatus is None


def test_sentinel_filter_drops_null_ages(spark):
    df = snap(spark, [row(1, "2020-01-02", "2020-01-03", age=238),
                      row(2, "2020-01-02", "2020-01-03", age=None),
                      row(3, "2020-01-02", "2020-01-03", age=40)])
    assert [r.BookingNumber for r in drop_bad_values(df).collect()] == [3]


def test_pretrial_rowlevel_year_range_pushes_down(spark, tmp_path):
    df = snap(spark, [row(1, "2015-01-02", "2015-01-03"), row(2, "2015-01-02", "2016-01-01"),
                      row(3, "2014-12-31", "2014-12-31 23:59:59"), row(4, "2015-06-01", "2015-06-02", disp="X")])
    df.write.parquet(str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    out = ep.pretrial_rowlevel(back, 2015)
    assert [r.BookingNumber for r in out.collect()] == [1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(SnapshotDateTime" in plan
