"""Physical-plan properties that the scale design relies on."""

import re

import pytest

from __spark_entry__ import queries
from snapcase.operators import episodes as ep
from snapcase.sources.snapshots import cases

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas")


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# Parameter-sized tables (top pairs, pair grid, levels, rules) stay far below
# this at sf0.001; the snapshot rows (~6k) and episode tables (~1.4k) do not.
MAX_BROADCAST_ROWS = 1000


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_products_or_python(spark, name):
    df = queries()[name](spark, SF)
    plan = _plan(df)
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    rows = [float(r) for r in re.findall(
        r"BroadcastQueryStage \(\d+\), Statistics\(sizeInBytes=[^,]+, rowCount=([0-9.E+]+)\)", text)]
    assert all(r <= MAX_BROADCAST_ROWS for r in rows), f"{name} broadcasts {max(rows)} rows"


def test_year_filter_reaches_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = _plan(ep.pretrial_rowlevel(cases(spark, SF), 1997))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "GreaterThanOrEqual(SnapshotDateTime" in scan and "LessThan(SnapshotDateTime" in scan
    assert "IsNull(ChargeDisposition)" in scan


def test_episode_aggregates_combine_map_side(spark):
    plan = _plan(ep.episode_end(cases(spark, SF)))
    assert re.search(r"partial_min\(", plan)
    first = _plan(ep.first_obs_per_episode(cases(spark, SF), ["Gender"]))
    # min(struct) is planned as a partial and a final aggregate around the shuffle
    assert first.count("SortAggregate") + first.count("HashAggregate") >= 2


def test_scan_reads_only_needed_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = _plan(ep.episode_end(cases(spark, SF)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("Charge:" not in s and "Gender" not in s for s in schemas)


@pytest.mark.parametrize("name", ["pretrial_exposure", "profile_period_shares",
                                  "item_pair_contingency"])
def test_growing_sides_are_never_broadcast(spark, name):
    plan = _plan(queries()[name](spark, "/root/testdata/sf0.01"))
    # every broadcast in these plans must be of a parameter-sized table
    for block in plan.split("BroadcastExchange")[1:]:
        head = block.split("\n")[1:6]
        assert not any("FileScan parquet" in line and "case_table" in line for line in head), name
    # both sides are shuffled and may spill
    assert "SortMergeJoin" in plan


def test_episode_end_scans_once(spark):
    # the scalar subquery and the result share the episode aggregate's shuffle
    assert "ReusedExchange" in _plan(ep.episode_end(cases(spark, SF)))


@pytest.mark.parametrize("name", ["initial_and_final_charges", "pretrial_days", "booking_days_cost"])
def test_episode_questions_join_nothing(spark, name):
    plan = _plan(queries()[name](spark, "/root/testdata/sf0.01"))
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_case_table_is_joined_and_laid_out_by_booking(spark, monkeypatch):
    # Customers meet the orders, not the line items, and nothing is shuffled for the layout.
    from snapcase.sources import snapshots
    monkeypatch.setattr(snapshots, "_WRITTEN", {})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = snapshots.case_view(spark, "/root/testdata/sf0.01")
        lines = view._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines()
        table = snapshots.case_table(spark, "/root/testdata/sf0.01")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    deep = [re.match(r"[\s:+|-]*", line).end() for line in lines]
    at = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(o_custkey" in line)
    below = [line for i, line in enumerate(lines) if i > at
             and all(d > deep[at] for d in deep[at + 1:i + 1])]
    assert any("orders.parquet" in line for line in below)
    assert not any("lineitem.parquet" in line for line in below)
    numbers = [r[0] for r in table.select("BookingNumber").collect()]
    assert sum(x != y for x, y in zip(numbers, numbers[1:])) < len(set(numbers))


def test_itemsets_shuffle_episodes_once_by_key(spark, monkeypatch):
    # distinct items of an episode are combined before the one shuffle of the rows.
    from snapcase.operators import itemsets
    from conftest import row, snap
    plans = {}
    kept = itemsets._stored

    def stored(df, folder, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().toString()
        return kept(df, folder, name)

    monkeypatch.setattr(itemsets, "_stored", stored)
    rows = [row(b, "2020-01-02", "2020-01-03", grp=g) for b in range(40) for g in "ABC"[:1 + b % 3]]
    out = itemsets.frequent_itemsets(snap(spark, rows), anchor="A", min_count=2)
    assert {(tuple(r["items"]), r.episodes) for r in out.collect()} == {
        (("A",), 40), (("A", "B"), 26), (("A", "C"), 13), (("A", "B", "C"), 13)}
    assert "placed" not in plans and plans["held"][1].count("Exchange hashpartitioning") == 1
    assert "Join" not in plans["held"][0]
