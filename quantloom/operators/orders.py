"""Order responses, execution summaries and open orders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The layout of one order response, and the times in force under which a resting order is a success.
RESPONSE_SCHEMA = (
    "status string, response struct<data:struct<statuses:array<struct<"
    "filled:struct<totalSz:string,avgPx:string,fee:string,oid:bigint>,resting:struct<oid:bigint>,error:string>>>>"
)
RESTING_TIFS = ("Gtc", "Alo")
REJECTED = "Order rejected or not filled"
UNKNOWN = "Unknown error"
NO_STATUS = "No status returned"
NO_DOCUMENT = "Unexpected response format: "
UNREADABLE = "Unreadable fill"


def classify_responses(trades: DataFrame, response: str = "response", tif: str = "time_in_force") -> DataFrame:
    """Outcome of each trade from its JSON response: ``status`` (filled, resting or failed), error text, fill and slippage.

    The first status of a response counts. Slippage is in percent of the expected price and positive when the fill was
    worse; a fill without a price counts as filled at the expected one. A fill whose price, size or fee is there but is no number
    counts as failed, with a text that says so, and so does a response that is there but is no document; null counts as absent.
    """
    parsed = trades.withColumn("_r", F.from_json(response, RESPONSE_SCHEMA))
    first = F.get("_r.response.data.statuses", 0)
    bad = F.coalesce(F.col("_r.status") == "err", F.lit(False))
    unreadable = F.lit(False)
    for name in ("avgPx", "totalSz", "fee"):
        unreadable = unreadable | (F.col(f"_s.filled.{name}").isNotNull() & F.expr(f"try_cast(_s.filled.{name} AS double)").isNull())
    # Anything but a document leaves the parsed response empty, its text is there all the same.
    text = F.get_json_object(response, "$.response")
    no_document = F.col("_r.response").isNull() & text.isNotNull()
    garbled = ~bad & F.col("_s.filled").isNotNull() & unreadable
    filled = ~bad & F.col("_s.filled").isNotNull() & ~unreadable
    resting = ~bad & F.col("_s.resting").isNotNull() & F.col(tif).isin(*RESTING_TIFS)
    expected, paid = F.col("price"), F.col("avg_px")
    gap = F.when(F.col("is_buy"), paid - expected).otherwise(expected - paid)
    return (
        parsed.withColumn("_s", first)
        .withColumn("status", F.when(filled, "filled").when(resting, "resting").otherwise("failed"))
        .withColumn("error", F.when(F.col("status") == "failed", F.when(
            bad, F.coalesce(text, F.lit(UNKNOWN))
        ).when(no_document, F.concat(F.lit(NO_DOCUMENT), text)).when(F.col("_s").isNull(), NO_STATUS).when(garbled, UNREADABLE).otherwise(F.coalesce("_s.error", F.lit(REJECTED)))))
        .withColumn("avg_px", F.when(F.col("status") == "filled", F.coalesce(
            F.expr("try_cast(_s.filled.avgPx AS double)"), expected)))
        .withColumn("total_sz", F.when(F.col("status") == "filled", F.coalesce(
            F.expr("try_cast(_s.filled.totalSz AS double)"), F.lit(0.0))))
        .withColumn("filled_px", F.when(F.col("status") == "filled", F.coalesce(
            F.expr("try_cast(_s.filled.avgPx AS double)"), F.lit(0.0))))
        .withColumn("actual_fee", F.when(F.col("status") == "filled", F.coalesce(
            F.expr("try_cast(_s.filled.fee AS double)"), F.lit(0.0))))
        .withColumn("resting_oid", F.when(F.col("status") == "resting", F.col("_s.resting.oid")))
        .withColumn("slippage_pct", F.when(F.col("status") == "filled", gap / expected * 100))
        .drop("_r", "_s", response)
    )


def execution_summary(outcomes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Successes, failures, success rate, slippage (a resting order counts as 0), fees and filled volume."""
    ok = F.col("status") != "failed"
    slip = F.when(ok, F.coalesce("slippage_pct", F.lit(0.0)))
    zero = F.lit(0.0)
    return outcomes.groupBy(*(group or [])).agg(
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_failed"),
        F.try_divide(F.count_if(ok) * 100.0, F.count(F.lit(1))).alias("success_pct"),
        F.coalesce(F.avg(slip), zero).alias("avg_slippage"),
        F.coalesce(F.max(slip), zero).alias("max_slippage"),
        F.coalesce(F.min(slip), zero).alias("min_slippage"),
        F.coalesce(F.sum(F.when(ok, F.coalesce("actual_fee", zero))), zero).alias("actual_fees"),
        F.coalesce(F.sum(F.col("total_sz") * F.col("filled_px")), zero).alias("filled_volume"),
    )


def target_exposure(targets: DataFrame, account_value: float) -> DataFrame:
    """One row: total and net exposure of the target book, its leverage, and net in percent of account value.

    The percentage is NULL for an account value that is not positive.
    """
    value = F.col("target_value")
    longs = F.coalesce(F.sum(F.when(value > 0, value)), F.lit(0.0))
    shorts = F.abs(F.coalesce(F.sum(F.when(value < 0, value)), F.lit(0.0)))
    funded = F.lit(account_value) > 0
    return targets.agg(longs.alias("long_value"), shorts.alias("short_value")).select(
        "long_value", "short_value", (F.col("long_value") + F.col("short_value")).alias("total_exposure"),
        (F.col("long_value") - F.col("short_value")).alias("net_exposure"),
    ).withColumn("leverage", F.when(funded, F.col("total_exposure") / account_value).otherwise(0.0)).withColumn(
        "net_pct", F.when(funded, F.col("net_exposure") / account_value * 100))


def failed_trades(trades: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Trades whose coin and direction did not succeed."""
    done = outcomes.where(F.col("status") != "failed").select("coin", "is_buy").distinct()
    return trades.join(done, ["coin", "is_buy"], "left_anti")


def open_orders(orders: DataFrame, coin: str | None = None) -> DataFrame:
    """Open orders with side and time spelled out, of one coin or all; ``timestamp`` is in milliseconds since 1970 UTC."""
    since_epoch = F.make_dt_interval(secs=(F.col("timestamp") / 1000).cast("decimal(18,6)"))
    chosen = orders if coin is None else orders.where(F.col("coin") == coin)
    return chosen.select(
        "oid", "coin", F.when(F.col("side") == "B", "BUY").otherwise("SELL").alias("side"),
        F.expr("try_cast(sz AS double)").alias("size"), F.expr("try_cast(limitPx AS double)").alias("limit_px"),
        (F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz") + since_epoch).alias("placed_at"))


def trigger_orders(orders: DataFrame) -> DataFrame:
    """Take-profit and stop orders: ``orderType`` is a document with a ``trigger`` entry, or a text that contains it."""
    kind = F.trim("orderType")
    is_document = kind.startswith("{")
    return orders.where(
        F.when(is_document, F.get_json_object("orderType", "$.trigger").isNotNull())
        .otherwise(F.lower(kind).contains("trigger")))
