import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quantloom import streaming as R
from quantloom.operators.fills import DAY_MS, fee_summary, fills_last_days, pnl_by_coin
from quantloom.operators.signals import latest_predictions
from quantloom.session import child_names

SCHEMA = "ts timestamp, coin string, sz string, px string, fee string, closedPnl string"


def files(spark, folder, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def fill_parts():
    start = datetime(2024, 1, 1, 6)
    return [[(start + timedelta(hours=9 * (3 * p + i)), f"C{(p + i) % 3}", str(i + 1), "10", "0.1", str(p - 1)) for i in range(4)] for p in range(4)]


def test_running_pnl_over_batches(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), fill_parts(), SCHEMA)
    for _ in range(2):  # the second start finds nothing new and must not change the result
        R.write_changes(R.running_pnl(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["coin"]: r for r in R.read_latest(spark, str(tmp_path / "out"), ["coin"]).collect()}
    none = spark.createDataFrame([], "coin string, unrealized_pnl double")
    batch = pnl_by_coin(spark.read.parquet(str(tmp_path / "in")), none).collect()
    assert len(got) == len(batch) == 3
    for row in batch:
        for name in ("realized_pnl", "fees", "volume"):
            assert got[row["coin"]][name] == pytest.approx(row[name])


def test_trailing_totals(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), fill_parts(), SCHEMA)
    R.write_changes(R.daily_totals(stream, late_days=30), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["window_start"]: (r["window_end"], r["volume"], r["n_fills"]) for r in
           R.trailing_totals(R.read_latest(spark, str(tmp_path / "out"), ["day"]), 3).collect()}
    rows = [r for part in fill_parts() for r in part]
    for start, (end, volume, n) in got.items():
        inside = [r for r in rows if start <= r[0] < end]
        assert end - start == timedelta(days=3) and n == len(inside)
        assert volume == pytest.approx(sum(float(r[2]) * float(r[3]) for r in inside))
    assert sum(n for _, _, n in got.values()) == 3 * len(rows)


def test_marks_join_positions(spark, tmp_path):
    positions = spark.createDataFrame([("A", 2.0, 10.0), ("B", -1.0, 10.0), ("C", 0.0, 1.0)], "coin string, szi double, entryPx double")
    marks = files(spark, str(tmp_path / "in"), [[("A", 12.0)], [("B", 12.0), ("C", 5.0), ("Z", 1.0)]], "coin string, mid double")
    R.write_appends(R.marked_positions(marks, positions), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["coin"]: (r["value"], r["unrealized_pnl"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"A": (24.0, 4.0), "B": (12.0, -2.0)}


def test_current_predictions(spark, tmp_path):
    day = datetime(2024, 1, 1)
    parts = [[(day, "A", 1.0), (day, "B", 5.0)], [(day + timedelta(days=1), "A", 0.5)], [(day, "A", 9.0), (day, "B", 6.0)]]
    stream = files(spark, str(tmp_path / "in"), parts, "pred_date timestamp_ntz, id string, pred double")
    R.write_changes(R.current_predictions(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = R.read_latest(spark, str(tmp_path / "out"), ["id"]).select("id", "pred_date", "pred")
    batch = latest_predictions(spark.read.parquet(str(tmp_path / "in"))).select("id", "pred_date", "pred")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) == [("A", day + timedelta(days=1), 0.5), ("B", day, 6.0)]


def test_late_fills_are_dropped(spark, tmp_path):
    day = datetime(2024, 1, 10, 12)

    def fill(when):
        return (when, "A", "1", "10", "0.1", "0")

    # A batch drops what is behind the watermark that the batch before it began with.
    parts = [[fill(day)], [fill(day + timedelta(days=9))], [fill(day + timedelta(days=9))], [fill(day), fill(day + timedelta(days=8, hours=8))]]
    stream = files(spark, str(tmp_path / "in"), parts, SCHEMA)
    R.write_changes(R.daily_totals(stream, late_days=1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["day"].day: r["n_fills"] for r in R.read_latest(spark, str(tmp_path / "out"), ["day"]).collect()}
    assert got == {10: 1, 18: 1, 19: 2}  # the second fill of the 10th came after the watermark, the one of the 18th did not


def test_log_is_compacted(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), fill_parts(), SCHEMA)
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    R.write_changes(R.running_pnl(stream), plain, str(tmp_path / "cp1")).awaitTermination()
    R.write_changes(R.running_pnl(stream), packed, str(tmp_path / "cp2"), keys=["coin"], compact_every=3).awaitTermination()
    assert sorted(n for n in child_names(spark, packed) if not n.startswith(("_", "."))) == ["base_upto=2", "batch_id=3"]
    assert len([n for n in child_names(spark, plain) if n.startswith("batch_id")]) == 4
    a, b = (sorted(map(tuple, R.read_latest(spark, p, ["coin"]).collect())) for p in (plain, packed))
    assert a == b
    R.compact(spark, packed, ["coin"])
    assert sorted(map(tuple, R.read_latest(spark, packed, ["coin"]).collect())) == a


def test_newest_marks_meet_positions(spark, tmp_path):
    day = datetime(2024, 1, 1)
    positions = spark.createDataFrame([("A", 2.0, 10.0), ("B", -1.0, 10.0)], "coin string, szi double, entryPx double")
    parts = [[(day, "A", 12.0), (day + timedelta(hours=1), "A", 13.0), (day, "B", 5.0)], [(day + timedelta(hours=2), "A", 11.0)]]
    marks = files(spark, str(tmp_path / "in"), parts, "ts timestamp, coin string, mid double")
    seen = []

    def apply(batch):
        seen.append(batch.count())
        return R.marked_positions(R.newest_marks(batch), positions)

    R.write_changes(marks, str(tmp_path / "out"), str(tmp_path / "cp"), each=apply).awaitTermination()
    got = {r["coin"]: r["value"] for r in R.read_latest(spark, str(tmp_path / "out"), ["coin"]).collect()}
    assert got == {"A": 22.0, "B": 5.0} and sum(seen) == 4


PANE = 7 * 3_600_000


def test_totals_until_any_moment(spark, tmp_path):
    """After each batch the log gives what the batch operator gives over the fills so far, wherever the window ends."""
    start = datetime(2024, 1, 1, 6, tzinfo=timezone.utc)
    at = lambda hours: int((start + timedelta(hours=hours)).timestamp() * 1000)
    schema = "time bigint, coin string, sz string, px string, fee string, closedPnl string"
    parts = [[(at(9 * (3 * p + i)) + p, f"C{i % 2}", str(i + 1), "10", None if i == 2 else "0.25", "0") for i in range(4)] for p in range(4)]
    parts.append([(at(1), "C0", "3", "10", "x", "0"), (at(30), "C1", "no", "10", "1", "0")])  # late, and unreadable
    moments = [(start + timedelta(hours=h, milliseconds=ms), days) for h, ms, days in
               ((0, 0, 1), (27, 0, 1), (27, -1, 1), (33, 1, 1), (90, 3, 2), (66, 0, 3), (18, 0, 30), (-30, 0, 1), (24 * 50, 0, 1))]
    for p, rows in enumerate(parts):
        stream = files(spark, str(tmp_path / "in"), [rows], schema)
        path = str(tmp_path / "log")
        R.write_fill_log(stream, path, str(tmp_path / "cp"), PANE).awaitTermination()
        for now, days in moments if p == len(parts) - 1 else moments[p:p + 2]:
            got = R.totals_until(spark, path, now, days, PANE).first()
            want = fee_summary(fills_last_days(spark.read.parquet(str(tmp_path / "in")), days, now)).first()
            assert got.asDict() == pytest.approx(want.asDict()), (p, now, days)


def test_fill_log_reads_the_cut_panes_only_and_forgets_old_ones(spark, tmp_path):
    schema = "time bigint, coin string, sz string, px string, fee string, closedPnl string"
    rows = [(d * DAY_MS + 5, "A", "1", "1", "1", "0") for d in range(20_000, 20_020)]
    path = str(tmp_path / "log")
    R.write_fill_log(files(spark, str(tmp_path / "in"), [rows], schema), path, str(tmp_path / "cp"), keep_panes=12).awaitTermination()
    assert sorted(n for n in child_names(spark, path + "/panes") if "=" in n) == [f"pane={d}" for d in range(20_008, 20_020)]
    now = datetime(1970, 1, 1) + timedelta(days=20_019, hours=3)
    totals = R.totals_until(spark, path, now, 7)
    assert totals.first()["n_fills"] == 7
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*IN \(20012,20019\)|PartitionFilters: \[[^\]]*INSET 20012, 20019", plan)
