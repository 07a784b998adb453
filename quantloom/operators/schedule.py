"""Rebalance schedule of many accounts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(day: Column, at_time: str) -> Column:
    hour, minute = at_time.split(":")
    return day.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(int(hour)), F.lit(int(minute)))


def next_rebalance(accounts: DataFrame, every_n_days: int, at_time: str, now: datetime) -> DataFrame:
    """Adds ``next_rebalance`` (UTC wall clock) to ``(account, last_rebalance)``.

    An account without history is due today at ``at_time``, or now if that has passed; any other one
    ``every_n_days`` after the date of its last rebalance.
    """
    current = F.lit(now).cast("timestamp_ntz")
    today = _at(F.lit(now.date()), at_time)
    return accounts.withColumn("next_rebalance", F.when(
        F.col("last_rebalance").isNull(), F.when(current < today, today).otherwise(current)
    ).otherwise(_at(F.date_add(F.to_date("last_rebalance"), every_n_days), at_time)))


def due_accounts(scheduled: DataFrame, now: datetime) -> DataFrame:
    """Accounts whose next rebalance has come."""
    return scheduled.where(F.col("next_rebalance") <= F.lit(now).cast("timestamp_ntz"))


def countdown(scheduled: DataFrame, now: datetime) -> DataFrame:
    """Adds whether the account is due, seconds until its next and since its last rebalance (NULL without history)."""
    current = F.lit(now).cast("timestamp_ntz")

    def seconds(span: Column) -> Column:
        return (F.extract(F.lit("DAY"), span) * 86_400 + F.extract(F.lit("HOUR"), span) * 3_600
                + F.extract(F.lit("MINUTE"), span) * 60 + F.floor(F.extract(F.lit("SECOND"), span))).cast("bigint")

    return (
        scheduled.withColumn("due", F.col("next_rebalance") <= current)
        .withColumn("seconds_until", seconds(F.greatest(F.col("next_rebalance"), current) - current))
        .withColumn("seconds_since", seconds(current - F.col("last_rebalance").cast("timestamp_ntz")))
    )
