"""Streams over the driver tables, run to the end of the available data."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quantloom import streaming as R
from quantloom.session import work_path

from . import sql as Q
from . import tables as T
from .registry import days, query, rounded

COIN = "'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR)"
PURCHASES = f"""WITH fills AS (SELECT ts, {COIN} AS coin, value * 1000 AS v, user_id % 5 AS fee, user_id % 7 - 3 AS pnl
  FROM events WHERE event_type = 'purchase')"""


def changed(stream, name, keys):
    spark = stream.sparkSession
    path = work_path(spark, name)
    R.write_changes(stream, path, work_path(spark, f"{name}-checkpoint")).awaitTermination()
    return R.read_latest(spark, path, keys)


@query(PURCHASES + f""" SELECT coin, {Q.r('sum(CAST(pnl AS DOUBLE))', 'realized_pnl')}, {Q.r('sum(CAST(fee AS DOUBLE))', 'fees')},
  {Q.r('sum(v)', 'volume', 2)}, count(*) AS n_fills FROM fills GROUP BY 1""")
def stream_running_pnl(spark, d):
    got = changed(R.running_pnl(T.fill_stream(spark, d)), "running-pnl", ["coin"])
    return rounded(rounded(got, "realized_pnl", "fees"), "volume", places=2)


@query(PURCHASES + f""", starts AS (SELECT *, date_trunc('day', ts) - INTERVAL 1 DAY * i AS s FROM fills, range(7) AS o(i))
SELECT strftime(s, '%Y-%m-%d') AS window_start, strftime(s + INTERVAL 7 DAY, '%Y-%m-%d') AS window_end,
  {Q.r('sum(v)', 'volume', 2)}, {Q.r('sum(CAST(fee AS DOUBLE))', 'fees')}, count(*) AS n_fills FROM starts GROUP BY s""")
def stream_trailing_totals(spark, d):
    got = R.trailing_totals(changed(R.daily_totals(T.fill_stream(spark, d)), "daily", ["day"]), 7)
    return rounded(rounded(days(got, "window_start", "window_end"), "volume", places=2), "fees")


@query(f"""WITH fills AS (SELECT epoch_ms(ts) AS time, value * 1000 AS v, user_id % 5 AS fee FROM events WHERE event_type = 'purchase'),
now AS (SELECT epoch_ms(max(ts)) - 45296789 AS until FROM events),
inside AS (SELECT fills.* FROM fills, now WHERE time BETWEEN until - 7 * 86400000 AND until)
SELECT count(*) AS n_fills, {Q.r('coalesce(sum(v), 0)', 'volume', 2)}, {Q.r('coalesce(sum(CAST(fee AS DOUBLE)), 0)', 'actual_fees')},
  {Q.r('coalesce(sum(v), 0) * 0.00035', 'estimated_fees')}, CAST(0 AS BIGINT) AS n_missing_fee FROM inside""")
def stream_totals_from_now(spark, d):
    """The seven days that end in the middle of a day, half a day before the last event."""
    fills = T.fill_stream(spark, d).select(F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), "coin", "sz", "px", "fee", "closedPnl")
    path = work_path(spark, "fill-log")
    R.write_fill_log(fills, path, work_path(spark, "fill-log-checkpoint")).awaitTermination()
    last = T.table(spark, d, "events").agg(F.unix_millis(F.max("ts").cast("timestamp"))).first()[0]
    now = datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=last - 45_296_789)
    got = R.totals_until(spark, path, now, 7).select("n_fills", "volume", "actual_fees", "estimated_fees", "n_missing_fee")
    return rounded(rounded(got, "actual_fees", "estimated_fees"), "volume", places=2)


@query(Q.with_(Q.POSITIONS) + f""", marks AS (SELECT event_id, {COIN} AS coin, 1000 + value AS mid FROM events)
SELECT event_id, coin, {Q.r('abs(szi * mid)', 'value')},
  {Q.r('CASE WHEN szi > 0 THEN (mid - entryPx) * szi ELSE (entryPx - mid) * abs(szi) END', 'unrealized_pnl')}
FROM marks JOIN positions USING (coin) WHERE szi <> 0""")
def stream_marked_positions(spark, d):
    marks = T.event_stream(spark, d).select("event_id", "coin", (1000 + F.col("value")).alias("mid"))
    path = work_path(spark, "marked")
    R.write_appends(R.marked_positions(marks, T.positions(spark, d)), path, work_path(spark, "marked-checkpoint")).awaitTermination()
    return rounded(spark.read.parquet(path), "value", "unrealized_pnl").select("event_id", "coin", "value", "unrealized_pnl")


@query(Q.with_(Q.PREDS, Q.LATEST) + "SELECT id, CAST(pred_date AS VARCHAR) AS pred_date, pred FROM latest")
def stream_current_predictions(spark, d):
    got = changed(R.current_predictions(T.order_stream(spark, d)), "current-predictions", ["id"])
    return days(got, "pred_date")


@query(Q.with_(Q.POSITIONS) + f""", marks AS (SELECT ts, {COIN} AS coin, 1000 + value AS mid FROM events),
newest AS (SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY coin ORDER BY ts DESC, mid DESC) = 1)
SELECT coin, {Q.r('abs(szi * mid)', 'value')} FROM newest JOIN positions USING (coin) WHERE szi <> 0""")
def stream_newest_marks(spark, d):
    """Only the newest mark of a coin in each micro-batch meets its positions."""
    marks = T.event_stream(spark, d).select("ts", "coin", (1000 + F.col("value")).alias("mid"))
    positions, path = T.positions(spark, d), work_path(spark, "newest")
    R.write_changes(marks, path, work_path(spark, "newest-checkpoint"), each=lambda batch: R.marked_positions(
        R.newest_marks(batch), positions)).awaitTermination()
    return rounded(R.read_latest(spark, path, ["coin"]), "value").select("coin", "value")
