"""Fill history, fees and PnL. Numbers of a fill arrive as text."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TAKER_RATE
from ..functions import one_row_each

DAY_MS = 86_400_000


def _number(name: str) -> Column:
    return F.expr(f"try_cast(`{name}` AS double)")


def parse_fills(fills: DataFrame) -> DataFrame:
    """Adds the numeric columns ``size``, ``price``, ``value``, ``paid_fee`` and ``pnl``; a missing fee or PnL is 0.

    ``unreadable`` marks a fill with a text that is there but is no number; what depends on it is NULL, or 0 for fee and PnL.
    """
    # Each text is read once, by a projection of its own; everything else looks at the numbers.
    read = {name: f"_{name}_number" for name in ("sz", "px", "fee", "closedPnl") if name in fills.columns}
    numbers = {name: F.col(number) for name, number in read.items()}
    unreadable, zero = F.lit(False), F.lit(0.0)
    for name, number in numbers.items():
        unreadable = unreadable | (F.col(name).isNotNull() & number.isNull())
    return (
        fills.withColumns({number: _number(name) for name, number in read.items()})
        .withColumns({
            "size": numbers["sz"], "price": numbers["px"], "value": numbers["sz"] * numbers["px"],
            "paid_fee": F.coalesce(numbers["fee"], zero) if "fee" in read else zero,
            "pnl": F.coalesce(numbers["closedPnl"], zero) if "closedPnl" in read else zero, "unreadable": unreadable})
        .drop(*read.values())
    )


def _millis(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)


def fills_between(fills: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Fills from ``start`` to ``end``, both taken at midnight UTC and inclusive; without bounds all of them."""
    chosen = fills
    if start is not None:
        chosen = chosen.where(F.col("time") >= _millis(start))
    if end is not None:
        chosen = chosen.where(F.col("time") <= _millis(end))
    return chosen


def fills_last_days(fills: DataFrame, days: int, now: datetime) -> DataFrame:
    """Fills of the last ``days`` days up to ``now``."""
    until = int(now.replace(tzinfo=now.tzinfo or timezone.utc).timestamp() * 1000)
    return fills.where(F.col("time").between(until - days * DAY_MS, until))


def fills_of_coin(fills: DataFrame, coin: str) -> DataFrame:
    """Fills of one coin, in any letter case."""
    return fills.where(F.upper("coin") == coin.upper())


def newest_fills(fills: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` fills, newest first; equal times by order id, then by what else tells them apart."""
    return fills.orderBy(F.col("time").desc(), *[c for c in ("oid", "coin", "side", "sz", "px", "fee", "closedPnl", "dir")
                                                 if c in fills.columns]).limit(limit)


def fee_sums(fills: DataFrame) -> list[Column]:
    """Aggregates over :func:`parse_fills` of these fills from which :func:`fee_totals` follows; they add up over parts."""
    missing = F.count_if(F.col("fee").isNull()) if "fee" in fills.columns else F.count(F.lit(1))
    return [F.count(F.lit(1)).alias("n_fills"), F.sum("value").alias("volume"), F.sum("paid_fee").alias("actual_fees"),
            missing.alias("n_missing_fee"), F.count_if("unreadable").alias("n_unreadable")]


def fee_totals(sums: DataFrame, taker_rate: float = DEFAULT_TAKER_RATE) -> DataFrame:
    """The row of :func:`fee_summary` from its sums."""
    volume, paid = (F.coalesce(name, F.lit(0.0)) for name in ("volume", "actual_fees"))
    return sums.select(
        "n_fills", volume.alias("volume"), paid.alias("actual_fees"), (volume * taker_rate).alias("estimated_fees"), "n_missing_fee", "n_unreadable",
    ).withColumn("fee_diff_pct", F.when(
        F.col("actual_fees") > 0, F.abs(F.col("actual_fees") - F.col("estimated_fees")) / F.col("actual_fees") * 100))


def fee_summary(fills: DataFrame, taker_rate: float = DEFAULT_TAKER_RATE) -> DataFrame:
    """One row: number of fills, volume, fees paid and estimated, their difference in percent, fills without a fee, and
    fills with an unreadable number, which the sums lack.

    The difference is NULL when no fee was paid.
    """
    return fee_totals(parse_fills(fills).agg(*fee_sums(fills)), taker_rate)


def pnl_by_coin(fills: DataFrame, positions: DataFrame) -> DataFrame:
    """Realized and unrealized PnL, fees and volume of every coin in either table, sorted by coin, and how many of its
    fills have an unreadable number. A NaN stays NaN.

    ``positions``: ``(coin, unrealized_pnl)`` with one row for each coin. Fills fold map-side, so a hot coin costs a
    row for each task; the join sees one row for each coin.
    """
    realized = parse_fills(fills).groupBy("coin").agg(
        F.sum("pnl").alias("realized_pnl"), F.sum("paid_fee").alias("fees"), F.sum("value").alias("volume"),
        F.count_if("unreadable").alias("n_unreadable"))
    held = one_row_each(positions.select("coin", "unrealized_pnl"), ["coin"], "positions")
    return (
        realized.join(held, "coin", "full_outer")
        .select("coin", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("realized_pnl", "unrealized_pnl", "fees", "volume")],
                F.coalesce("n_unreadable", F.lit(0).cast("bigint")).alias("n_unreadable"))
        .orderBy("coin")
    )


def pnl_totals(pnl: DataFrame) -> DataFrame:
    """PnL of every coin with its total, and the grand total in a row named TOTAL."""
    return (
        pnl.rollup("coin").agg(
            F.sum("realized_pnl").alias("realized_pnl"), F.sum("unrealized_pnl").alias("unrealized_pnl"),
            F.sum("fees").alias("fees"), F.sum("volume").alias("volume"), F.sum("n_unreadable").alias("n_unreadable"), F.grouping("coin").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("coin")).alias("coin"), "realized_pnl", "unrealized_pnl",
            (F.col("realized_pnl") + F.col("unrealized_pnl")).alias("total_pnl"), "fees", "volume", "n_unreadable", "_all")
        .orderBy("_all", "coin").drop("_all")
    )
