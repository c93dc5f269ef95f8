import datetime as dt

from conftest import row, snap

from snapcase.operators import charges as ch
from snapcase.operators import stays as st


def _stays(spark):
    return snap(spark, [
        row(1, "2020-01-02", "2020-01-02"), row(1, "2020-01-02", "2020-01-05", disp="GUILTY"),
        # never disposed: held until the day after the last snapshot
        row(2, "2020-01-03", "2020-01-03"), row(2, "2020-01-03", "2020-03-02"),
        # disposed before its booking day: no valid stay
        row(3, "2020-02-10", "2020-02-01", disp="X"),
        # booked before the first snapshot day of disposed bookings
        row(4, "2019-12-01", "2020-01-04"),
    ])


def test_stays_without_disposition_count_and_negative_ones_do_not(spark):
    out = {r.BookingNumber: (r.start, r.end) for r in st.episode_stays(_stays(spark)).collect()}
    assert out == {1: (dt.date(2020, 1, 2), dt.date(2020, 1, 5)),
                   2: (dt.date(2020, 1, 3), dt.date(2020, 3, 3))}
    days = {r.dimension: r for r in st.pretrial_days(_stays(spark)).collect() if r.level == "All"}
    assert (days["All"].bookings, days["All"].total_days) == (2, 63)
    cost = st.booking_days_cost(_stays(spark), [("p", dt.date(2020, 1, 4), dt.date(2020, 1, 31))], rate=10)
    assert [(r.bookings, r.booking_days, r.cost) for r in cost.collect()] == [(2, 29, 290)]


def test_combinations_keep_a_missing_race(spark):
    rows = spark.createDataFrame(
        [(1, "d", None, "DRUGS"), (1, "d", None, "THEFT"), (2, "d", "W", "DRUGS"), (2, "d", "W", "THEFT")],
        "BookingNumber int, BookingDate string, RaceDescription string, ChargeGroup string")
    out = {r.race: (r.episodes, r.anchor_episodes) for r in ch.group_combinations_by_race(rows).collect()}
    assert out == {None: (1, 1), "W": (1, 1)}


def test_first_and_last_charges(spark):
    rows = spark.createDataFrame(
        [(1, "d", 1, "A"), (1, "d", 1, None), (1, "d", 3, "B"), (1, "d", 2, "C"), (2, "d", 5, "A")],
        "BookingNumber int, BookingDate string, SnapshotDateTime int, ChargeGroup string")
    out = {r.charge_group: (r.at_booking, r.at_release)
           for r in st.initial_and_final_charges(rows).collect()}
    assert out == {"A": (2, 1), "Missing": (1, 0), "B": (0, 1)}
