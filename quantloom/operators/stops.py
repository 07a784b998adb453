"""Stop-loss levels for open positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import with_half_even, with_perp_price
from ..functions.numeric import INTEGER_PRICE_ABOVE, MAX_PRICE_DECIMALS, PRICE_DIGITS
from .trades import size_decimals

# The reasons for which a position gets no stop, and which position sides a setting covers.
NOT_CONFIGURED = ("Side ", " not configured")
BAD_ENTRY = "Invalid entry price"
NO_DECIMALS = "Unknown szDecimals"
NO_PRICE = "No price after rounding"
COVERED_SIDES = {"none": [], "both": ["LONG", "SHORT"], "long_only": ["LONG"], "short_only": ["SHORT"]}


def stop_eligible(side: Column, setting: str) -> Column:
    """Whether a position of this side gets a stop."""
    if setting not in COVERED_SIDES:
        raise ValueError(f"Unknown stop loss setting: {setting}")
    covered = COVERED_SIDES[setting]
    return side.isin(*covered) if covered else F.lit(False)


def rounds_to_nothing(price: Column, size_decimals: Column) -> Column:
    """Whether so many size decimals leave nothing of a price: at most half a step, as five digits show it.

    Told from the price itself: a filter on this is pushed down to it and must not carry the whole rounding along.
    """
    half_step = F.pow(F.lit(10.0), (size_decimals - MAX_PRICE_DECIMALS).cast("double")) / 2
    return (price <= INTEGER_PRICE_ABOVE) & (price <= half_step * (1 + 10.0 ** -PRICE_DIGITS))


def stop_levels(positions: DataFrame, universe: DataFrame, setting: str, pct: float, slippage: float) -> DataFrame:
    """Every open position ``(coin, szi, entryPx, ...)`` with its stop order or the reason why it gets none.

    The trigger lies ``pct`` beyond entry on the losing side, the limit ``slippage`` beyond the trigger before
    rounding. Prices and sizes follow the exchange's rounding.
    """
    is_long = F.col("szi") > 0
    decimals = F.col("size_decimals")
    trigger = F.when(is_long, F.col("entryPx") * (1 - pct)).otherwise(F.col("entryPx") * (1 + pct))
    limit = F.when(is_long, trigger * (1 - slippage)).otherwise(trigger * (1 + slippage))
    open_ones = positions.where(F.col("szi") != 0).join(size_decimals(universe), "coin", "left")
    placed = F.col("skip_reason").isNull()
    reasoned = open_ones.withColumn("side", F.when(is_long, "LONG").otherwise("SHORT")).withColumn(
        "skip_reason",
        F.when(~stop_eligible(F.col("side"), setting), F.concat(F.lit(NOT_CONFIGURED[0]), F.col("side"), F.lit(NOT_CONFIGURED[1])))
        .when((F.coalesce(F.col("entryPx"), F.lit(0.0)) <= 0) | F.isnan("entryPx"), BAD_ENTRY)
        .when(decimals.isNull(), NO_DECIMALS)
        .when(rounds_to_nothing(F.least(trigger, limit), decimals), NO_PRICE),
    ).withColumn("is_buy", F.when(placed, ~is_long))
    levels = with_perp_price(reasoned, "trigger_px", F.when(placed, trigger), decimals)
    levels = with_perp_price(levels, "limit_px", F.when(placed, limit), decimals)
    return with_half_even(levels, "sz", F.when(placed, F.abs("szi")), decimals).drop("size_decimals")


def stop_report(levels: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Number of positions for each outcome; ``side_skip`` marks those left out by the side setting on purpose."""
    outcome = F.coalesce("skip_reason", F.lit("applied"))
    return levels.groupBy(*(group or []), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "side_skip", F.col("outcome").startswith(NOT_CONFIGURED[0]))
