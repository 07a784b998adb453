"""Analytics over the position snapshots ``(date, id, weight)`` of a backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_snapshot(positions: DataFrame) -> DataFrame:
    """Positions of the last rebalance, largest absolute weight first, then by id."""
    last = positions.agg(F.max("date")).scalar()
    weight = F.format_string("%.10e", F.abs("weight")).cast("double")  # equal shares may differ in their last bits
    return positions.where(F.col("date") == last).orderBy(weight.desc(), "id")


def snapshot_counts(snapshot: DataFrame) -> DataFrame:
    """One row: long and short positions of a snapshot."""
    longs = F.count_if(F.col("weight") > 0)
    return snapshot.agg(longs.alias("n_long"), (F.count(F.lit(1)) - longs).alias("n_short"))


def asset_history(positions: DataFrame) -> DataFrame:
    """How often, on which side and how heavily each asset was held.

    ``frequency_pct`` is relative to the rebalances that hold any position; ``current_weight`` is 0 for an asset that
    the last rebalance does not hold.
    """
    weight, held = F.col("weight"), F.col("weight") != 0
    # Both numbers fold map-side to one row for each rebalance date.
    by_date = positions.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    last = by_date.agg(F.max("date")).scalar()
    periods = by_date.agg(F.count(F.lit(1))).scalar()
    longs, shorts = F.col("times_long"), F.col("times_short")
    return (
        positions.withColumn("_last", last)
        .groupBy("id")
        .agg(
            F.count_if(held).alias("times_held"),
            F.avg(F.when(held, weight)).alias("avg_weight"),
            F.count_if(weight > 0).alias("times_long"),
            F.count_if(weight < 0).alias("times_short"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.coalesce(F.max(F.when(F.col("date") == F.col("_last"), weight)), F.lit(0.0)).alias("current_weight"),
        )
        .where(F.col("times_held") > 0)
        .withColumn("predominant_side", F.when(longs > shorts, "LONG").when(shorts > longs, "SHORT").otherwise("MIXED"))
        .withColumn("frequency_pct", 100.0 * F.try_divide(F.col("times_held"), periods))
    )


def by_consistency(history: DataFrame) -> DataFrame:
    """Most often held first, then largest absolute average weight, then id."""
    weight = F.format_string("%.10e", F.abs("avg_weight")).cast("double")  # last bits of an average depend on the order of its rows
    return history.orderBy(F.col("times_held").desc(), weight.desc(), "id")


def most_consistent(history: DataFrame) -> DataFrame:
    return by_consistency(history).limit(1)


def history_totals(history: DataFrame) -> DataFrame:
    """One row: assets ever held, and the long and short positions of the last rebalance."""
    current = F.col("current_weight")
    return history.agg(
        F.count(F.lit(1)).alias("n_assets"), F.count_if(current > 0).alias("current_longs"),
        F.count_if(current < 0).alias("current_shorts"))
