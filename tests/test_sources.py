from conftest import row, snap

from snapcase.sources.sinks import read_report, read_result, save_report, write_result
from snapcase.sources.snapshots import SNAPSHOT_SCHEMA, scan_snapshots, scan_with_rejects


def test_csv_scan_with_schema_and_sentinel(spark, tmp_path):
    df = snap(spark, [row(1, "2020-01-02", "2020-01-03"),
                      row(2, "2020-01-02", "2020-01-03", age=238)])
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    back = scan_snapshots(spark, str(tmp_path / "csv"), fmt="csv")
    assert back.schema == SNAPSHOT_SCHEMA
    assert [r.BookingNumber for r in back.collect()] == [1]


def test_csv_scan_by_header_name_with_extra_columns(spark, tmp_path):
    df = snap(spark, [row(7, "2020-01-02", "2020-01-03 10:30:00", disp="X")])
    cols = list(reversed(df.columns))
    shuffled = df.selectExpr("'cell A' AS Housing", *cols)
    shuffled.write.option("header", True).csv(str(tmp_path / "csv2"))
    back = scan_snapshots(spark, str(tmp_path / "csv2"), fmt="csv").collect()[0]
    assert back.BookingNumber == 7 and back.Housing == "cell A"
    assert back.SnapshotDateTime.isoformat() == "2020-01-03T10:30:00"


def test_result_tables_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = write_result(df, "unit_roundtrip")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert sorted(tuple(r) for r in read_result(spark, "unit_roundtrip").collect()) == [(1, "a"), (2, "b")]


def test_csv_headers_missing_values_and_bad_cells(spark, tmp_path):
    folder = tmp_path / "extract"
    folder.mkdir()
    (folder / "a.csv").write_text("BookingNumber,Gender,RaceDescription,CurrentAge,ChargeDisposition\n"
                                  "1,F,W,30,NA\n2,M,B,x,\"\"\n")
    (folder / "b.csv").write_text("BookingNumber,RaceDescription,Gender,Extra,CurrentAge,ChargeDisposition\n"
                                  "3,W,F,e,NA,GUILTY\n4,\"B, other\",M,,41,\n")
    rows = {r.BookingNumber: r for r in
            scan_snapshots(spark, str(folder), fmt="csv", bad={}).collect()}
    assert {k: (r.Gender, r.RaceDescription, r.CurrentAge, r.ChargeDisposition, r.Extra)
            for k, r in rows.items()} == {
        1: ("F", "W", 30, None, None), 2: ("M", "B", None, None, None),
        3: ("F", "W", None, "GUILTY", "e"), 4: ("M", "B, other", 41, None, None)}


def test_rejected_cells_are_listed(spark, tmp_path):
    folder = tmp_path / "faults"
    folder.mkdir()
    (folder / "a.csv").write_text("BookingNumber,Gender,CurrentAge,Extra\n1,F,30,x\n2,M,old,y\nthree,M,NA,\n")
    (folder / "b.csv").write_text("CurrentAge,BookingNumber,SnapshotDateTime\n238,4,never\n41,5,2020-01-03 00:00:00\n")
    typed, rejects = scan_with_rejects(spark, str(folder))
    assert sorted((r.file.rsplit("/", 1)[1], r.record, r.column, r.text) for r in rejects.collect()) == [
        ("a.csv", 2, "CurrentAge", "old"), ("a.csv", 3, "BookingNumber", "three"),
        ("b.csv", 1, "SnapshotDateTime", "never")]
    assert sorted(r.BookingNumber for r in typed.collect()) == [1, 5]


def test_record_numbers_run_through_the_blocks_of_a_file(spark, tmp_path):
    folder = tmp_path / "long"
    folder.mkdir()
    rows = [f"{i},{'x' if i % 50 == 7 else i % 90}" for i in range(1, 4001)]
    (folder / "a.csv").write_text("BookingNumber,CurrentAge\n" + "\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        typed, rejects = scan_with_rejects(spark, str(folder), bad={})
        assert sorted(r.record for r in rejects.collect()) == [i for i in range(1, 4001) if i % 50 == 7]
        assert typed.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_runs_do_not_share_result_tables(spark):
    df = spark.createDataFrame([(1,)], "k int")
    write_result(df, "same")
    write_result(df.selectExpr("k + 1 AS k"), "same", run="other-run")
    assert read_result(spark, "same").first().k == 1
    assert read_result(spark, "same", run="other-run").first().k == 2
    paths = save_report({"one": df, "two": df}, "report")
    assert set(paths) == {"one", "two"} and read_report(spark, "report", ["two"])["two"].count() == 1
