"""Trades that lead from current to target positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TAKER_RATE
from ..functions import one_row_each, with_half_even, with_perp_price, with_size_up

# Order of execution, risk first, and the reasons for a skipped trade.
PRIORITY = {"close": 0, "reduce": 1, "flip": 1, "increase": 2, "open": 3}
DEFAULT_SIZE_DECIMALS = 2
NO_MID = "No mid price available"
NO_DECIMALS = "Unknown szDecimals (meta)"
NOT_A_NUMBER = "Target or position is not a number"
ZERO_SIZE = ("Rounded size is 0 at ", " dp")
BELOW_MINIMUM = "Below minimum ${}"
BELOW_AFTER_FORCE = "Below minimum even after force composition (${})"

TRADE_COLUMNS = ["coin", "is_buy", "sz", "price", "current_value", "target_value", "delta_value", "type",
                 "estimated_fee", "skipped", "skip_reason", "force", "force_id", "force_seq"]


def size_decimals(universe: DataFrame) -> DataFrame:
    """``(coin, size_decimals)`` of the assets that are listed and not delisted."""
    return universe.where(F.col("name").isNotNull() & ~F.coalesce(F.col("isDelisted"), F.lit(False))).select(
        F.col("name").alias("coin"), F.coalesce("szDecimals", F.lit(DEFAULT_SIZE_DECIMALS)).alias("size_decimals"))


def round_sizes(sizes: DataFrame, universe: DataFrame, size: str = "size") -> DataFrame:
    """Adds ``rounded_size`` by each coin's own decimals; NULL where they are unknown."""
    known = sizes.join(size_decimals(universe), "coin", "left")
    return with_half_even(known, "rounded_size", F.col(size), F.col("size_decimals"))


def market_table(mids: DataFrame, universe: DataFrame) -> DataFrame:
    """``(coin, price, size_decimals)``: everything a trade needs to know about its coin, one row for each coin.

    A price is NULL unless there is a positive mid, decimals are NULL unless the coin is listed.
    """
    priced = mids.where((F.col("mid") > 0) & ~F.isnan("mid")).select("coin", F.col("mid").alias("price"))
    return one_row_each(priced, ["coin"], "mids").join(one_row_each(size_decimals(universe), ["coin"], "universe"), "coin", "full_outer")


def trade_deltas(targets: DataFrame, positions: DataFrame, market: DataFrame, keys: list[str]) -> DataFrame:
    """Target against current value of every coin in either table, one row for each of ``keys``.

    ``targets``: ``(*keys, target_value)``; ``positions``: ``(*keys, szi)``; ``market``: see :func:`market_table`.
    Without a price the values that need it are NULL. The books are matched on all keys; only then is the market, one
    row for each coin, looked up: broadcast when it is small at run time, else joined with the skew handling of
    adaptive execution, which splits the rows of a hot coin.
    """
    price = F.col("price")
    return (
        one_row_each(targets.select(*keys, "target_value"), keys, "targets")
        .join(one_row_each(positions.select(*keys, "szi"), keys, "positions"), keys, "full_outer")
        # A coin that one book lacks counts as 0 there; NaN stays, as it says that a number is wrong, not that there is none.
        .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("target_value", "szi")})
        .join(market, "coin", "left")
        .withColumn("current_value", F.col("szi") * price)
        .withColumn("delta_value", F.col("target_value") - F.col("current_value"))
        .withColumns({"is_buy": F.col("delta_value") > 0, "size": F.abs("delta_value") / price})
    )


def trade_type(current: Column, target: Column) -> Column:
    same_sign = ((current > 0) & (target > 0)) | ((current < 0) & (target < 0))
    return (
        F.when(current == 0, F.when(target != 0, "open").otherwise("increase"))
        .when(target == 0, "close")
        .when(same_sign, F.when(F.abs(target) < F.abs(current), "reduce").otherwise("increase"))
        .otherwise("flip")
    )


def plan_trades(targets: DataFrame, positions: DataFrame, mids: DataFrame, universe: DataFrame, min_trade_value: float,
                taker_rate: float = DEFAULT_TAKER_RATE, force: bool = False, keys: list[str] | None = None) -> DataFrame:
    """All trades, executable and skipped, with one layout; a field that does not apply is NULL.

    With ``force``, closing a position below the minimum becomes two trades: one that increases it by at least the
    minimum, one that closes everything. ``keys`` names the columns that identify a position, ``coin`` among them, so
    that the books of many accounts are planned at once.
    """
    keys = keys or ["coin"]
    deltas = trade_deltas(targets, positions, market_table(mids, universe), keys)
    priced = with_half_even(deltas, "rounded_size", F.col("size"), F.col("size_decimals"))
    current, target, delta, price = (F.col(c) for c in ("current_value", "target_value", "delta_value", "price"))
    minimum, decimals = F.lit(float(min_trade_value)), F.col("size_decimals")
    wrong = F.isnan("delta_value")
    too_small = F.abs(F.col("rounded_size") * price) < minimum
    forced = too_small & (target == 0) & F.lit(force)

    grow_buy = current > 0
    grow_value = F.col("_up") * price
    close_value = F.abs(current) + grow_value
    chain_ok = (grow_value >= minimum) & (F.col("_close_sz") * price >= minimum)

    reason = (
        F.when(price.isNull(), NO_MID)
        .when(decimals.isNull(), NO_DECIMALS)
        .when(wrong, NOT_A_NUMBER)
        .when(F.col("rounded_size") == 0, F.concat(F.lit(ZERO_SIZE[0]), decimals.cast("string"), F.lit(ZERO_SIZE[1])))
        .when(forced & ~chain_ok, BELOW_AFTER_FORCE.format(float(min_trade_value)))
        .when(too_small & ~forced, BELOW_MINIMUM.format(float(min_trade_value)))
    )
    none = F.lit(None)
    # A trade that was skipped before it was fully known keeps only its coin and target.
    partial = price.isNull() | decimals.isNull() | wrong | (F.col("rounded_size") == 0) | (forced & ~chain_ok)

    def known(value: Column) -> Column:
        return F.when(~F.coalesce(partial, F.lit(True)), value)

    def trade(is_buy, sz, cur, tgt, dlt, kind, force_id, seq) -> Column:
        return F.struct(
            is_buy.alias("is_buy"), sz.alias("sz"), known(price).alias("price"), cur.alias("current_value"),
            tgt.cast("double").alias("target_value"), dlt.alias("delta_value"), kind.alias("type"),
            (F.abs(dlt) * taker_rate).alias("estimated_fee"), F.col("_reason").isNotNull().alias("skipped"),
            F.col("_reason").alias("skip_reason"), F.lit(seq is not None).alias("force"),
            force_id.cast("string").alias("force_id"), F.lit(seq).cast("int").alias("force_seq"))

    plain = trade(known(F.col("is_buy")), known(F.col("rounded_size")), known(current), target, known(delta),
                  known(trade_type(current, target)), none, None)
    chain = F.concat(F.lit("force_close:"), F.col("coin"))
    signed_grow = F.when(grow_buy, grow_value).otherwise(-grow_value)
    grow = trade(grow_buy, F.col("_up"), current, current + F.when(current >= 0, grow_value).otherwise(-grow_value),
                 signed_grow, F.lit("increase"), chain, 0)
    close = trade(~grow_buy, F.col("_close_sz"), current + signed_grow, F.lit(0.0),
                  F.when(~grow_buy, close_value).otherwise(-close_value), F.lit("close"), chain, 1)
    if force:
        priced = with_half_even(with_size_up(priced, "_up", minimum, price, decimals), "_close_sz", close_value / price, decimals)
    else:
        priced = priced.withColumns({"_up": F.lit(0.0), "_close_sz": F.lit(0.0)})
    return (
        priced.withColumn("_reason", reason)
        .withColumn("_forced", F.coalesce(forced, F.lit(False)) & F.col("_reason").isNull())
        .select(*keys, F.explode(F.when(F.col("_forced"), F.array(grow, close)).otherwise(F.array(plain))).alias("_t"))
        .select(*keys, "_t.*")
    )


def plan_close_all(positions: DataFrame, mids: DataFrame, universe: DataFrame, min_trade_value: float,
                   taker_rate: float = DEFAULT_TAKER_RATE, force: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Trades that bring every open position to zero."""
    keys = keys or ["coin"]
    held = positions.where(F.col("szi") != 0)
    return plan_trades(held.select(*keys, F.lit(0.0).alias("target_value")), held, mids, universe, min_trade_value,
                       taker_rate, force, keys)


def executable(plan: DataFrame) -> DataFrame:
    return plan.where(~F.col("skipped"))


def skipped(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("skipped"))


def execution_order(plan: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Adds what trades are to be sorted by: forced chains in sequence, then whatever reduces leverage first."""
    rank = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return plan.withColumn("stage", F.when(F.col("force"), 0).otherwise(1)).withColumn(
        "priority", F.when(F.col("force"), 0).otherwise(F.coalesce(F.element_at(rank, F.col("type")), F.lit(2)))
    ).orderBy(*(group or []), "stage", F.coalesce("force_id", F.lit("")), F.coalesce("force_seq", F.lit(0)), "priority", "coin")


def plan_summary(plan: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Counts for each type, buys, sells, volumes and fees of executable trades, and the number of skipped ones."""
    ok = ~F.col("skipped")
    buy = ok & F.coalesce("is_buy", F.lit(False))
    size = F.abs("delta_value")

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))

    return plan.groupBy(*(group or [])).agg(
        F.count_if(ok).alias("n_trades"),
        *[F.count_if(ok & (F.col("type") == t)).alias(f"n_{t}") for t in ("open", "close", "flip", "reduce", "increase")],
        F.count_if(buy).alias("n_buy"),
        F.count_if(ok & ~F.coalesce("is_buy", F.lit(False))).alias("n_sell"),
        total(buy, size).alias("buy_volume"),
        total(ok & ~F.coalesce("is_buy", F.lit(False)), size).alias("sell_volume"),
        total(ok, F.col("estimated_fee")).alias("estimated_fees"),
        F.count_if(~ok).alias("n_skipped"),
    )


def target_totals(targets: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Long and short money of the target book."""
    value = F.col("target_value")
    return targets.groupBy(*(group or [])).agg(
        F.coalesce(F.sum(F.when(value > 0, value)), F.lit(0.0)).alias("target_long"),
        F.abs(F.coalesce(F.sum(F.when(value < 0, value)), F.lit(0.0))).alias("target_short"))


def plan_rows(plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Executable trades first, then the largest change first; equal ones by their keys."""
    return plan.orderBy("skipped", F.coalesce(F.abs("delta_value"), F.lit(0.0)).desc(), *(keys or ["coin"]))


def rounded_prices(prices: DataFrame, universe: DataFrame, price: str = "price") -> DataFrame:
    """Adds ``rounded_price`` by the exchange's price rule."""
    known = prices.join(size_decimals(universe), "coin", "left")
    return with_perp_price(known, "rounded_price", F.col(price), F.col("size_decimals"))


def passive_limits(trades: DataFrame, mids: DataFrame, universe: DataFrame, offset: float) -> DataFrame:
    """Adds ``limit_px`` of each trade: below the mid for buys, above it for sells, rounded."""
    side = F.when(F.col("is_buy"), 1 - offset).otherwise(1 + offset)
    wanted = trades.join(mids.select("coin", "mid"), "coin").withColumn("_px", F.col("mid") * side)
    return rounded_prices(wanted, universe, "_px").withColumnRenamed("rounded_price", "limit_px").drop("_px", "size_decimals")
