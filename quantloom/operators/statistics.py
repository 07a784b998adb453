"""Performance statistics over daily series, for any number of runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365


def performance_stats(daily: DataFrame, start_capital: float, group: list[str] | None = None) -> DataFrame:
    """Eleven statistics for each group of daily rows ``(date, returns, equity, drawdown, turnover)``.

    Returns are before cost and equity after cost, so volatility, Sharpe, Sortino and win rate ignore costs.
    """
    group, start_capital = group or [], float(start_capital)
    r = F.col("returns")
    sums = daily.groupBy(*group).agg(
        F.count(F.lit(1)).alias("days"),
        F.max_by("equity", "date").alias("final_equity"),
        F.stddev_samp(r).alias("_std"),
        F.avg(r).alias("_mean"),
        F.min("drawdown").alias("max_drawdown"),
        F.count_if(r > 0).alias("_wins"),
        F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))).alias("_turnover"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down_std"),
        F.count_if(r < 0).alias("_losses"),
    ).where(F.col("days") > 0)
    return (
        sums.selectExpr(
            "*", f"final_equity / {start_capital!r}D AS _growth", f"_mean * {DAYS_PER_YEAR} AS _yearly",
            f"coalesce(_std, 0D) * sqrt({DAYS_PER_YEAR}D) AS annual_volatility",
            f"coalesce(_down_std, 0D) * sqrt({DAYS_PER_YEAR}D) AS _down")
        .selectExpr(
            "*", "_growth - 1 AS total_return",
            f"CASE WHEN final_equity > 0 THEN power(_growth, {DAYS_PER_YEAR} / days) - 1 ELSE _growth - 1 END AS cagr",
            "CASE WHEN annual_volatility > 0 THEN _yearly / annual_volatility ELSE 0D END AS sharpe_ratio",
            "CASE WHEN _down > 0 THEN _yearly / _down WHEN _losses = 0 AND _yearly > 0 THEN double('Infinity') ELSE 0D END "
            "AS sortino_ratio",
            "_wins / days AS win_rate", "coalesce(_turnover, 0D) AS avg_turnover")
        .withColumn("calmar_ratio", F.expr("CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0D END"))
        .select(*group, "days", "total_return", "cagr", "annual_volatility", "sharpe_ratio", "sortino_ratio",
                "max_drawdown", "calmar_ratio", "win_rate", "avg_turnover", "final_equity")
    )


def histograms(df: DataFrame, columns: dict[str, Column], bins: int = 15) -> DataFrame:
    """``(series, bin, low, high, n)`` of equally wide bins between each series' minimum and maximum.

    NULL values are left out; the maximum falls into the last bin, and a series with one distinct value into the
    first. The extremes come from one aggregate row; counting folds map-side.
    """
    picked = df.select(*[c.alias(name) for name, c in columns.items()])
    long = picked.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("series"), F.col(name).cast("double").alias("value")) for name in columns
    ])).alias("_p")).select("_p.series", "_p.value").where(F.col("value").isNotNull())
    extremes = picked.agg(*[F.min(F.col(n).cast("double")).alias(f"{n}_min") for n in columns],
                          *[F.max(F.col(n).cast("double")).alias(f"{n}_max") for n in columns])
    ranges = extremes.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("series"), F.col(f"{n}_min").alias("_min"), F.col(f"{n}_max").alias("_max"))
        for n in columns])).alias("_r")).select("_r.*")
    width = (F.col("_max") - F.col("_min")) / bins
    place = F.when(F.col("_max") <= F.col("_min"), 1).when(F.col("value") >= F.col("_max"), bins).otherwise(
        F.width_bucket("value", F.col("_min"), F.col("_max"), F.lit(bins)))
    # `ranges` has one row for each named column, so it is always small enough to broadcast.
    return (
        long.join(F.broadcast(ranges), "series")
        .groupBy("series", "_min", "_max", place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("series", "bin", (F.col("_min") + (F.col("bin") - 1) * width).alias("low"),
                (F.col("_min") + F.col("bin") * width).alias("high"), "n")
    )


def daily_histograms(daily: DataFrame, bins: int = 15) -> DataFrame:
    """Distributions of daily returns, drawdown and non-zero turnover."""
    return histograms(daily, {
        "returns": F.col("returns"), "drawdown": F.col("drawdown"),
        "turnover": F.when(F.col("turnover") != 0, F.col("turnover"))}, bins)
