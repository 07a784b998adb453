"""Streaming twins of batch operators.

Each transformation takes a streaming DataFrame and returns one; two sinks make the results queryable. A replayed
batch overwrites its own files, so results survive restarts without duplicates.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_TAKER_RATE
from ..operators.fills import DAY_MS, fee_sums, fee_totals, parse_fills
from ..session import child_names, remove_path


def running_pnl(fills: DataFrame) -> DataFrame:
    """Realized PnL, fees and volume of each coin so far; the state is one row for each coin."""
    return parse_fills(fills).groupBy("coin").agg(
        F.sum("pnl").alias("realized_pnl"), F.sum("paid_fee").alias("fees"), F.sum("value").alias("volume"),
        F.count(F.lit(1)).alias("n_fills"))


def daily_totals(fills: DataFrame, time_column: str = "ts", late_days: int = 1) -> DataFrame:
    """Volume and fees of each day; fills later than the watermark are dropped.

    The state is one row for each open day, whatever windows are read from it: see :func:`trailing_totals`. Days start at
    midnight of the session time zone when that is UTC.
    """
    return (
        parse_fills(fills).withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, f"{late_days} days")
        .groupBy(F.window(time_column, "1 day").alias("w"))
        .agg(F.sum("value").alias("volume"), F.sum("paid_fee").alias("fees"), F.count(F.lit(1)).alias("n_fills"))
        .select(F.col("w.start").alias("day"), "volume", "fees", "n_fills")
    )


def trailing_totals(daily: DataFrame, days: int) -> DataFrame:
    """Volume and fees over ``days`` days, a window for every day, from the current rows of :func:`daily_totals`.

    Only one row for each day is copied into the windows that it belongs to, never a fill.
    """
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.col("day") - F.make_dt_interval(k.cast("int"))))
    return (
        daily.select(start.alias("window_start"), "volume", "fees", "n_fills").groupBy("window_start")
        .agg(F.sum("volume").alias("volume"), F.sum("fees").alias("fees"), F.sum("n_fills").alias("n_fills"))
        .select("window_start", (F.col("window_start") + F.make_dt_interval(F.lit(days))).alias("window_end"), "volume", "fees", "n_fills")
    )


def newest_marks(marks: DataFrame, time_column: str = "ts") -> DataFrame:
    """The newest mark ``(coin, mid)`` of each coin in one micro-batch; equal times by the larger mid."""
    return marks.groupBy("coin").agg(F.max(F.struct(time_column, "mid")).alias("_m")).select(
        "coin", F.col(f"_m.{time_column}").alias(time_column), "_m.mid")


def marked_positions(marks: DataFrame, positions: DataFrame) -> DataFrame:
    """Every mark ``(coin, mid, ...)`` of a stream applied to a static table of positions ``(coin, szi, entryPx)``.

    Where only the newest price matters, apply it to :func:`newest_marks` of each micro-batch (``each`` of :func:`write_changes`).
    """
    size, entry, mid = F.col("szi"), F.coalesce("entryPx", F.lit(0.0)), F.col("mid")
    return (
        marks.join(positions.where(F.col("szi") != 0), "coin")
        .withColumn("value", F.abs(size * mid))
        .withColumn("unrealized_pnl", F.when(size > 0, (mid - entry) * size).otherwise((entry - mid) * F.abs(size)))
    )


def current_predictions(predictions: DataFrame) -> DataFrame:
    """The newest prediction of each asset so far; the state is one row for each asset."""
    return predictions.groupBy("id").agg(F.max(F.struct("pred_date", "pred")).alias("_p")).select(
        "id", "_p.pred_date", "_p.pred")


def write_changes(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None,
                  keys: list[str] | None = None, compact_every: int = 50, **trigger) -> StreamingQuery:
    """Keep the rows that each micro-batch changed, in one folder for each batch below ``path``.

    ``each`` is applied to every micro-batch, for instance to join only its newest marks. With ``keys`` the log is
    compacted after every ``compact_every`` batches, so what a reader has to go through does not grow with uptime.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch if each is None else each(batch)
        rows.write.mode("overwrite").parquet(os.path.join(path, f"{_BATCH}{batch_id}"))
        if keys and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, path, keys)

    return (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(keep).start()
    )


# Folders of a change log, followed by a batch number.
_BATCH, _BASE = "batch_id=", "base_upto="


def _log(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """Number of the newest complete base, and of the batches that are newer."""
    names = child_names(spark, path)
    bases = [int(n.removeprefix(_BASE)) for n in names if n.startswith(_BASE) and "_SUCCESS" in child_names(spark, os.path.join(path, n))]
    base = max(bases, default=None)
    batches = sorted(int(n.removeprefix(_BATCH)) for n in names if n.startswith(_BATCH))
    return base, [b for b in batches if base is None or b > base]


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Replace the batches so far by their current rows. Old folders go only once the new one is complete, so a compaction
    that dies is done again by the next one; readers that have begun before it need to begin again."""
    base, batches = _log(spark, path)
    if not batches:
        return
    read_latest(spark, path, keys).write.mode("overwrite").parquet(os.path.join(path, f"{_BASE}{batches[-1]}"))
    for old in [f"{_BATCH}{b}" for b in batches] + ([] if base is None else [f"{_BASE}{base}"]):
        remove_path(spark, os.path.join(path, old), below=path)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current row of each key: the one from the newest batch that changed it."""
    base, batches = _log(spark, path)
    parts = [(b, f"{_BATCH}{b}") for b in batches] + ([] if base is None else [(base, f"{_BASE}{base}")])
    if not parts:
        raise FileNotFoundError(f"No batches below {path}")
    rows = [spark.read.parquet(os.path.join(path, name)).withColumn("_batch", F.lit(b)) for b, name in parts]
    changes = reduce(DataFrame.unionByName, rows)
    values = [c for c in changes.columns if c not in (*keys, "_batch")]
    return (
        changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")
    )


# Folders of a fill log and the columns by which they are partitioned.
_FILLS, _PANES, _PANE, _WRITTEN = "fills", "panes", "pane", "written_by"


def write_fill_log(stream: DataFrame, path: str, checkpoint: str, pane_ms: int = DAY_MS, keep_panes: int | None = None, **trigger) -> StreamingQuery:
    """Keep fills ``(time, ...)`` such that their totals up to any moment can be read: see :func:`totals_until`.

    A micro-batch adds its fills, and their sums for each pane of ``pane_ms`` milliseconds, below ``path``; a replayed batch overwrites
    what it wrote. Fills may be late by any time. With ``keep_panes`` only so many of the newest panes stay after each batch.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumns({_PANE: F.floor(F.col("time") / pane_ms).cast("bigint"), _WRITTEN: F.lit(batch_id)})
        for name, rows in ((_FILLS, placed), (_PANES, parse_fills(placed).groupBy(_PANE, _WRITTEN).agg(*fee_sums(placed)))):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PANE, _WRITTEN).parquet(os.path.join(path, name))
        if keep_panes is not None:
            panes = sorted(_panes(spark, path))
            for old in panes[:-keep_panes]:
                for name in (_PANES, _FILLS):  # a pane without sums is not read, whatever is left of its fills
                    remove_path(spark, os.path.join(path, name, f"{_PANE}={old}"), below=path)

    return (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(keep).start()
    )


def _panes(spark: SparkSession, path: str) -> list[int]:
    names = child_names(spark, os.path.join(path, _PANES))
    return [int(n.removeprefix(f"{_PANE}=")) for n in names if n.startswith(f"{_PANE}=")]


def totals_until(spark: SparkSession, path: str, now: datetime, days: int, pane_ms: int = DAY_MS, taker_rate: float = DEFAULT_TAKER_RATE) -> DataFrame:
    """``fee_summary`` of the last ``days`` days up to ``now``, to the millisecond and both ends included, from a fill log.

    Whole panes count by their sums. Only the panes at both ends are cut, and only their folders of fills are read.
    """
    until = int(now.replace(tzinfo=now.tzinfo or timezone.utc).timestamp() * 1000)
    since = until - days * DAY_MS
    first, last = since // pane_ms, until // pane_ms
    cut = [p for p in sorted({first, last}) if p * pane_ms < since or (p + 1) * pane_ms - 1 > until]
    sums = spark.read.parquet(os.path.join(path, _PANES)).where(F.col(_PANE).between(first, last) & ~F.col(_PANE).isin(cut))
    fills = spark.read.parquet(os.path.join(path, _FILLS)).where(F.col(_PANE).isin(cut) & F.col("time").between(since, until))
    names = ["n_fills", "volume", "actual_fees", "n_missing_fee", "n_unreadable"]
    parts = sums.select(*names).unionByName(parse_fills(fills).agg(*fee_sums(fills)))
    zero = F.lit(0).cast("bigint")
    return fee_totals(parts.agg(*[(F.sum(n) if n in ("volume", "actual_fees") else F.coalesce(F.sum(n), zero)).alias(n) for n in names]), taker_rate)


def write_appends(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the rows of a stateless stream as Parquet."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start(path)
    )
