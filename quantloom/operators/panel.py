"""Price panel and trading calendar."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ceil_day_index, chunk_of, day_index, on_schedule, plus_days


def price_returns(prices: DataFrame, chunk_days: int = 32) -> DataFrame:
    """``(date, id, ret)``: close over the asset's previous row, minus one; NULL on its first row or after a zero.
    A pair of date and id that occurs twice raises an error.

    A window over ``id`` alone would put the whole history of one asset into one task. Here history is cut into
    calendar chunks: the last close of every chunk is computed first (a small aggregate, folded map-side), handed to
    the asset's next chunk as one extra row, and the window runs within ``(id, chunk)``.
    """
    return chunk_returns(chunked_prices(prices, chunk_days))


def chunked_prices(prices: DataFrame, chunk_days: int = 32) -> DataFrame:
    """``(date, id, close, _chunk, _extra)``: prices in calendar chunks, each after the first with the close before it as an extra row."""
    chunked = prices.select("date", "id", "close", chunk_of(F.col("date"), chunk_days).alias("_chunk"))
    chunk_ends = chunked.groupBy("id", "_chunk").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    handed_on = chunk_ends.select(
        "date", "id", "close",
        F.lead("_chunk").over(Window.partitionBy("id").orderBy("_chunk")).alias("_chunk"),
        F.lit(True).alias("_extra"),
    ).where(F.col("_chunk").isNotNull())
    return chunked.withColumn("_extra", F.lit(False)).unionByName(handed_on)


def chunk_returns(rows: DataFrame) -> DataFrame:
    """The returns of :func:`price_returns` from :func:`chunked_prices`, by one window within each chunk."""
    by_date = Window.partitionBy("id", "_chunk").orderBy("date")
    before = F.lag("close").over(by_date)
    # Rows of one asset and date are neighbours here, so repeats are seen without another pass.
    repeated = F.raise_error(F.concat(F.lit("Repeated (date, id) in prices: "), F.col("date").cast("string"), F.lit(", "), F.col("id").cast("string")))
    return (
        rows.select("date", "id", "_extra", F.when(F.lag("date").over(by_date) == F.col("date"), repeated.cast("double")).otherwise(
            F.try_divide(F.col("close"), before) - 1).alias("ret"))
        .where(~F.col("_extra"))
        .select("date", "id", "ret")
    )


def usable(ret: str = "ret") -> Column:
    """A return that is neither NULL nor NaN."""
    return F.col(ret).isNotNull() & ~F.isnan(ret)


def duplicate_keys(prices: DataFrame) -> DataFrame:
    """``(date, id, n)`` for every pair that occurs more than once; returns and pivots need none."""
    return prices.groupBy("date", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def returns_wide(returns: DataFrame, ids: list[str]) -> DataFrame:
    """One row for each date and one column for each id of the given list, in date order. An output operator."""
    return returns.groupBy("date").pivot("id", ids).agg(F.first("ret")).orderBy("date")


def available_assets(returns: DataFrame) -> DataFrame:
    """``(date, id)`` of every usable return."""
    return returns.where(usable()).select("date", "id")


@dataclass(frozen=True)
class TradingWindow:
    """First and last valid trading date; the first one anchors the rebalance schedule.

    ``stamps`` is about how many distinct dates there are, where that was counted: several a day in an intraday panel.
    """

    first: datetime
    last: datetime
    stamps: int | None = field(default=None, compare=False)

    @property
    def days(self) -> int:
        return (self.last.date() - self.first.date()).days

    def steps(self, every: list[int]) -> int:
        """Scheduled steps of all schedules; a bound on tables with a row for each step."""
        return sum(self.days // n + 1 for n in every)

    def covers(self, date: Column) -> Column:
        return date.between(F.lit(self.first).cast("timestamp_ntz"), F.lit(self.last).cast("timestamp_ntz"))


def trading_window(prices: DataFrame, predictions: DataFrame, lag_days: int = 1, start: datetime | None = None,
                   end: datetime | None = None) -> TradingWindow | None:
    """Bounds of the valid trading dates, or None where there are none.

    A date is valid from ``lag_days`` after the first prediction on, within the optional inclusive bounds. One job
    over the two date columns brings back the bounds, which then reach every scan as literals, and about how many dates there are.
    """
    earliest = predictions.agg(plus_days(F.min("pred_date"), F.lit(lag_days))).scalar()
    dates = prices.where(F.col("date") >= earliest)
    if start is not None:
        dates = dates.where(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        dates = dates.where(F.col("date") <= F.lit(end).cast("timestamp_ntz"))
    row = dates.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.approx_count_distinct("date", 0.02).alias("stamps")).first()
    return None if row["first"] is None else TradingWindow(row["first"], row["last"], row["stamps"])


def trading_dates(prices: DataFrame, window: TradingWindow) -> DataFrame:
    """Distinct price dates within the window."""
    return prices.where(window.covers(F.col("date"))).select("date").distinct()


def usable_predictions(predictions: DataFrame, window: TradingWindow, lag_days: int = 1) -> DataFrame:
    """Predictions that some valid date may use: released at least ``lag_days`` before the last one."""
    last = plus_days(window.last, F.lit(-lag_days))
    return predictions.where(F.col("pred_date") <= last)


#: Largest table, by a bound on its rows that is known before it is computed, that is sent to every task.
ROWS_TO_ALL_TASKS = 500_000


def to_all_tasks(df: DataFrame, at_most: int | None) -> DataFrame:
    """The table, broadcast if it has no more rows than is fit for that; else Spark joins it as it sees fit."""
    return F.broadcast(df) if at_most is not None and at_most <= ROWS_TO_ALL_TASKS else df


def kept_steps(dates: DataFrame, window: TradingWindow, every: list[int]) -> dict[int, list[int]]:
    """The steps of each schedule that have a price date, in order; others are skipped, not moved.

    They come to the driver, at most one number for each calendar day, whatever the number of dates or assets.
    """
    scheduled = F.lit(False)
    for n in every:
        scheduled = scheduled | on_schedule(F.col("date"), window.first, F.lit(n))
    days = dates.where(window.covers(F.col("date")) & scheduled).select(day_index(F.col("date"), window.first).alias("d")).distinct()
    found = sorted(r["d"] for r in days.collect())
    return {n: [d // n for d in found if d % n == 0] for n in every}


def _looked_up(numbers: list[int | None], at: Column) -> Column:
    """Entry of a constant list, NULL before its beginning and where there is none."""
    text = ",".join("-1" if x is None else str(x) for x in numbers)
    entry = F.get(F.split(F.lit(text), ",").cast("array<int>"), F.greatest(at, F.lit(0)))  # one constant, once optimised
    return F.when((at >= 0) & (entry >= 0), entry)


def step_of_date(date: Column, window: TradingWindow, kept: dict[int, list[int]]) -> Column:
    """For each schedule a struct ``(rebalance_days, k, held_k, next_k)``, as an array.

    ``k`` numbers the scheduled steps and is NULL on other dates. ``held_k`` is the last kept step strictly before the date,
    whose weights earn the date's return; ``next_k`` the next kept one after step k. The last scheduled step before a date is
    arithmetic, and which kept step holds there is looked up, so dates are never sorted and a day may have any number of them.
    """
    structs = []
    for n, steps in kept.items():
        holds, follows, there = [], [], set(steps)
        for j in range(window.days // n + 1):
            holds.append(j if j in there else holds[-1] if holds else None)
        for j in reversed(range(window.days // n + 1)):
            follows.append(None if j == window.days // n else j + 1 if j + 1 in there else follows[-1])
        day = day_index(date, window.first)
        k = F.when(on_schedule(date, window.first, F.lit(n)), F.floor(day / n).cast("int"))
        before = F.floor((ceil_day_index(date, window.first) - 1) / n).cast("int")
        structs.append(F.struct(F.lit(n).alias("rebalance_days"), k.alias("k"), _looked_up(holds, before).alias("held_k"),
                                _looked_up(follows[::-1], k).alias("next_k")))
    return F.array(*structs)


def rebalance_calendar(dates: DataFrame, window: TradingWindow, every: list[int]) -> DataFrame:
    """``(rebalance_days, date, k, held_k)`` of distinct dates for each schedule in ``every``; see :func:`step_of_date`."""
    steps = step_of_date(F.col("date"), window, kept_steps(dates, window, every))
    return dates.select("date", F.explode(steps).alias("_s")).select("_s.rebalance_days", "date", "_s.k", "_s.held_k")
