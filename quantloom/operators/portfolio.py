"""Account state, mark to market and exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import one_row_each

# The layout of an account's state document. All numbers are strings.
ACCOUNT_STATE_SCHEMA = (
    "marginSummary struct<accountValue:string,totalNtlPos:string,totalMarginUsed:string,totalRawUsd:string>, "
    "crossMarginSummary struct<accountValue:string,totalMarginUsed:string,totalMaintenanceMargin:string>, "
    "withdrawable string, "
    "assetPositions array<struct<position:struct<coin:string,szi:string,entryPx:string,liquidationPx:string,"
    "marginUsed:string>>>"
)


def parse_state(states: DataFrame, state_column: str = "state") -> DataFrame:
    """The JSON document of each account as a struct in its place."""
    return states.withColumn(state_column, F.from_json(state_column, ACCOUNT_STATE_SCHEMA))


def _number(text: str, default: float | None = 0.0) -> Column:
    """A text as a number: the default where there is none, NULL where it is no number."""
    number = F.expr(f"try_cast({text} AS double)")
    return number if default is None else F.when(F.expr(f"{text} IS NULL"), F.lit(default)).otherwise(number)


def _unreadable(*texts: str) -> Column:
    out = F.lit(False)
    for text in texts:
        out = out | F.expr(f"{text} IS NOT NULL AND try_cast({text} AS double) IS NULL")
    return out


def open_positions(states: DataFrame, account: str = "account", state_column: str = "state") -> DataFrame:
    """Open positions ``(account, coin, szi, entryPx, liquidationPx, marginUsed, unreadable)`` of parsed account states.

    A position with a text that is no number is kept, with NULL in its place and ``unreadable`` set.
    """
    return (
        states.select(account, F.explode(f"{state_column}.assetPositions").alias("_a"))
        .select(account, "_a.position.*")
        .select(account, "coin", _number("szi").alias("szi"), _number("entryPx").alias("entryPx"),
                _number("liquidationPx", None).alias("liquidationPx"), _number("marginUsed", None).alias("marginUsed"),
                _unreadable("szi", "entryPx", "liquidationPx", "marginUsed").alias("unreadable"))
        .where(F.col("szi").isNull() | (F.col("szi") != 0))
    )


def account_metrics(states: DataFrame, account: str = "account", state_column: str = "state") -> DataFrame:
    """Value, margin, free collateral and leverage of each parsed account state.

    A missing entry counts as 0; one that is no number gives NULL, also in what is computed from it, and sets ``unreadable``.
    """
    margin, cross = f"{state_column}.marginSummary", f"{state_column}.crossMarginSummary"
    value = F.col("account_value")
    has_cross = F.col(cross).isNotNull()
    return (
        states.withColumns({
            "account_value": _number(f"{margin}.accountValue"),
            "total_position_value": _number(f"{margin}.totalNtlPos"),
            "margin_used": _number(f"{margin}.totalMarginUsed"),
            "cash_balance": _number(f"{margin}.totalRawUsd"),
            "withdrawable": _number(f"{state_column}.withdrawable"),
        })
        .withColumn("free_collateral", value - F.col("margin_used"))
        .withColumn("current_leverage", F.when(value.isNotNull(), F.when(
            value > 0, F.col("total_position_value") / value).otherwise(0.0)))
        .withColumn("cross_leverage", F.when(
            has_cross & value.isNotNull(), F.when(value > 0, _number(f"{cross}.accountValue") / value).otherwise(0.0)))
        .withColumn("cross_margin_used", F.when(has_cross, _number(f"{cross}.totalMarginUsed")))
        .withColumn("cross_maintenance_margin", F.when(has_cross, _number(f"{cross}.totalMaintenanceMargin")))
        .withColumn("unreadable", _unreadable(
            *[f"{margin}.{n}" for n in ("accountValue", "totalNtlPos", "totalMarginUsed", "totalRawUsd")], f"{state_column}.withdrawable",
            *[f"{cross}.{n}" for n in ("accountValue", "totalMarginUsed", "totalMaintenanceMargin")]))
        .select(account, "account_value", "total_position_value", "margin_used", "free_collateral", "cash_balance",
                "withdrawable", "current_leverage", "cross_leverage", "cross_margin_used", "cross_maintenance_margin",
                "unreadable")
    )


def mark_to_market(positions: DataFrame, mids: DataFrame) -> DataFrame:
    """Open positions ``(coin, szi, entryPx, ...)`` valued at the mid price, or at entry where there is no mid.

    Other columns of the positions are kept. Mids have one row for each coin.
    """
    size, entry, mark = F.col("szi"), F.col("entry_price"), F.col("mark_price")
    return (
        positions.where(F.col("szi") != 0)
        .join(one_row_each(mids.select("coin", "mid"), ["coin"], "mids"), "coin", "left")
        .withColumn("entry_price", F.coalesce("entryPx", F.lit(0.0)))
        .withColumn("mark_price", F.coalesce("mid", "entry_price"))
        .withColumn("side", F.when(size > 0, "LONG").otherwise("SHORT"))
        .withColumn("value", F.abs(size * mark))
        .withColumn("unrealized_pnl", F.when(size > 0, (mark - entry) * size).otherwise((entry - mark) * F.abs(size)))
        .withColumn("return_pct", F.when(
            entry > 0, F.col("unrealized_pnl") / (F.abs(size) * entry) * 100).otherwise(0.0))
        .withColumn("size", F.abs(size))
        .drop("szi", "entryPx", "mid")
    )


def exposure(marked: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Long, short, net and total value, unrealized PnL and position counts."""
    long_value = F.sum(F.when(F.col("side") == "LONG", F.col("value")).otherwise(0.0))
    short_value = F.sum(F.when(F.col("side") == "SHORT", F.col("value")).otherwise(0.0))
    zero = F.lit(0.0)
    return marked.groupBy(*(group or [])).agg(
        F.coalesce(long_value, zero).alias("total_long_value"),
        F.coalesce(short_value, zero).alias("total_short_value"),
        F.coalesce(long_value - short_value, zero).alias("net_exposure"),
        F.coalesce(long_value + short_value, zero).alias("total_exposure"),
        F.coalesce(F.sum("unrealized_pnl"), zero).alias("total_unrealized_pnl"),
        F.count_if(F.col("side") == "LONG").alias("n_long"),
        F.count_if(F.col("side") == "SHORT").alias("n_short"),
    )


def exposure_percent(exposures: DataFrame, account_value: Column) -> DataFrame:
    """Exposure and unrealized PnL in percent of the account value; a value that is not positive counts as 1."""
    value = F.when(account_value > 0, account_value).otherwise(1.0)
    return (
        exposures.withColumn("long_pct", F.col("total_long_value") / value * 100)
        .withColumn("short_pct", F.col("total_short_value") / value * 100)
        .withColumn("net_pct", F.col("net_exposure") / value * 100)
        .withColumn("gross_pct", F.col("long_pct") + F.col("short_pct"))
        .withColumn("pnl_pct", F.col("total_unrealized_pnl") / value * 100)
    )


def position_list(marked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Largest absolute value first, then by the keys of a position."""
    return marked.orderBy(F.abs("value").desc(), *(keys or ["coin"]))
