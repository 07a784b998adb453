"""Which prediction counts, and which assets it selects.

Order of assets everywhere: highest prediction first, equal predictions by id. Shorts are read from the other end of
the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ceil_day_index, day_index, on_schedule, plus_days
from .panel import TradingWindow, available_assets


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """``(id, pred_date, pred)`` with the newest prediction of each asset; on one date the higher one.

    A plain aggregate: it folds map-side, so a hot asset costs one row for each task.
    """
    return (
        predictions.groupBy("id")
        .agg(F.max(F.struct("pred_date", "pred")).alias("_p"))
        .select("id", "_p.pred_date", "_p.pred")
    )


def step_signals(predictions: DataFrame, window: TradingWindow, every: list[int], lag_days: int = 1) -> DataFrame:
    """As-of join of predictions with the rebalance steps: ``(rebalance_days, k, date, id, pred)``.

    A prediction first counts at step ``ceil((pred_date + lag - anchor) / n)``. Of the predictions an asset gets
    between two steps only the newest can be used, so they fold into one before any shuffle of rows; it then serves
    all steps up to the asset's next one. Steps are numbers, so no inequality join is needed.
    """
    anchor = window.first
    n = F.col("rebalance_days")
    last_k = F.floor(day_index(F.lit(window.last).cast("timestamp_ntz"), anchor) / n).cast("int")
    ready = ceil_day_index(F.col("pred_date"), anchor) + F.lit(lag_days)
    newest = (
        predictions.select("id", "pred_date", "pred", F.explode(F.array(*[F.lit(e) for e in every])).alias("rebalance_days"))
        .withColumn("_from", F.greatest(F.lit(0), F.ceil(ready / n)).cast("int"))
        .where(F.col("_from") <= last_k)
        .groupBy("rebalance_days", "id", "_from")
        .agg(F.max(F.struct("pred_date", "pred")).alias("_p"))
    )
    following = F.lead("_from").over(Window.partitionBy("rebalance_days", "id").orderBy("_from"))
    return (
        newest.withColumn("_to", F.coalesce(following - 1, last_k))
        .select("rebalance_days", F.explode(F.sequence("_from", "_to")).alias("k"), "id", F.col("_p.pred").alias("pred"))
        .withColumn("date", plus_days(anchor, F.col("k") * n))
    )


def eligible_signals(signals: DataFrame, returns: DataFrame, window: TradingWindow, every: list[int]) -> DataFrame:
    """Signals of assets that have a usable return on the rebalance date itself."""
    scheduled = F.lit(False)
    for n in every:
        scheduled = scheduled | on_schedule(F.col("date"), window.first, F.lit(n))
    tradable = available_assets(returns).where(window.covers(F.col("date")) & scheduled)
    return signals.join(tradable, ["date", "id"])


def rank_ends(signals: DataFrame, group: list[str], num_top: int, num_bottom: int, salts: int = 16) -> DataFrame:
    """Both ends of every group's order, with ``rank_top`` and ``rank_bottom`` (from 1) and the group's ``n_assets``.

    Keeps at least the first ``num_top`` and the last ``num_bottom`` rows. A group is first cut into ``salts`` parts
    by asset; each part keeps only rows that can still reach an end and one row that carries its count, so the final
    window of a group sees about ``salts * (num_top + num_bottom)`` rows whatever the size of the group.
    """
    order = [F.col("pred").desc(), F.col("id").asc()]
    part = Window.partitionBy(*group, "_salt")
    parts = (
        signals.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .withColumn("_rn", F.row_number().over(part.orderBy(*order)))
        .withColumn("_cnt", F.count(F.lit(1)).over(part))
        .where((F.col("_rn") <= max(num_top, 1)) | (F.col("_rn") > F.col("_cnt") - num_bottom))
        .withColumn("_cnt", F.when(F.col("_rn") == 1, F.col("_cnt")).otherwise(0))
    )
    whole = Window.partitionBy(*group)
    return (
        parts.withColumn("rank_top", F.row_number().over(whole.orderBy(*order)))
        .withColumn("rank_bottom", F.count(F.lit(1)).over(whole) - F.col("rank_top") + 1)
        .withColumn("n_assets", F.sum("_cnt").over(whole))
        .where((F.col("rank_top") <= num_top) | (F.col("rank_bottom") <= num_bottom))
        .drop("_salt", "_rn", "_cnt")
    )


def backtest_side(num_long: Column | int, num_short: Column | int) -> Column:
    """LONG, SHORT or NULL for a row of :func:`rank_ends`. Longs are served first, so no asset gets both sides."""
    longs = F.least(_lit(num_long), F.col("n_assets"))
    shorts = F.least(_lit(num_short), F.col("n_assets") - longs)
    return F.when(F.col("rank_top") <= longs, "LONG").when(F.col("rank_bottom") <= shorts, "SHORT")


def select_backtest(signals: DataFrame, group: list[str], num_long: int, num_short: int) -> DataFrame:
    """Longs and shorts of every group, never overlapping."""
    return (
        rank_ends(signals, group, num_long, num_short)
        .withColumn("side", backtest_side(num_long, num_short))
        .where(F.col("side").isNotNull())
    )


def select_live(latest: DataFrame, num_long: int, num_short: int) -> DataFrame:
    """Longs from the top and, independently, shorts from the bottom of one list: ``(id, pred, side)``.

    With too few assets an asset can be picked twice and then has a row for each side.
    """
    ends = rank_ends(latest, [], num_long, num_short, salts=256)
    sides = F.array_compact(F.array(
        F.when(F.col("rank_top") <= num_long, F.lit("LONG")),
        F.when(F.col("rank_bottom") <= num_short, F.lit("SHORT"))))
    return ends.select("id", "pred", F.explode(sides).alias("side"))


def tradeable(predictions: DataFrame, universe: DataFrame) -> DataFrame:
    """Predictions of assets that are listed and not delisted."""
    listed = universe.where(~F.coalesce(F.col("isDelisted"), F.lit(False))).select(F.col("name").alias("id"))
    return predictions.join(listed, "id", "left_semi")


def universe_mismatch(predictions: DataFrame, universe: DataFrame) -> DataFrame:
    """``(id, missing_from)``: listed assets without prediction and predicted assets that are not listed."""
    listed = universe.where(~F.coalesce(F.col("isDelisted"), F.lit(False))).select(F.col("name").alias("id")).distinct()
    predicted = predictions.select("id").distinct()
    return (
        listed.join(predicted, "id", "left_anti").withColumn("missing_from", F.lit("predictions"))
        .unionByName(predicted.join(listed, "id", "left_anti").withColumn("missing_from", F.lit("universe")))
    )


def shortage(latest: DataFrame, num_long: int, num_short: int) -> DataFrame:
    """One row: how many assets there are, how many are wanted, and whether that is too few."""
    return latest.agg(F.count(F.lit(1)).alias("available")).select(
        "available", F.lit(num_long + num_short).cast("bigint").alias("requested"),
        (F.col("available") < num_long + num_short).alias("short_of_assets"))


def _lit(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
