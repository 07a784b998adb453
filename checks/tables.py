"""Panels and account tables that Spark derives from the driver tables.

Aggregates use max, min or sums of whole numbers, so every engine gets the same bits.
"""

from __future__ import annotations

import os
import zlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import work_path
from quantloom.sources import prediction_panel, price_panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _midnight_ms(name: str):
    return F.unix_date(F.to_date(name)).cast("bigint") * 86_400_000


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("id"))


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close of each brand."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_quantity")
    return (
        items.join(brands(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("date", "id").agg((1000 + F.max("l_quantity")).alias("close"))
    )


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each brand on each order date, under the provider's column names."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("release_date"), "o_totalprice")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(brands(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("release_date", "id").agg(F.max("o_totalprice").alias("pred_10d"))
    )


def _state(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes with the sizes and times of the files that the panels come from."""
    found = []
    for name in ("lineitem", "orders", "part"):
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
        for file in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return zlib.crc32(repr(sorted(found)).encode())


def _landed(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The panel as a Parquet table, derived from the driver tables once for each session and state of their files."""
    key = f"quantloom.landed.{name}.{sf_dir}.{_state(spark, sf_dir)}"
    path = spark.conf.get(key, None)
    if path is None:
        path = work_path(spark, name) + ".parquet"
        build(spark, sf_dir).write.parquet(path)
        spark.conf.set(key, path)
    return spark.read.parquet(path)


def price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, sf_dir, "prices", raw_prices)


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, sf_dir, "predictions", raw_predictions)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_panel(price_table(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_panel(prediction_table(spark, sf_dir))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min("p_partkey")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(
        (first % 6).cast("int").alias("szDecimals"), (first % 10 == 9).alias("isDelisted"))


def mids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest close of each brand but one."""
    return prices(spark, sf_dir).where(F.col("id") != "Brand#1").groupBy(F.col("id").alias("coin")).agg(
        F.max_by("close", "date").alias("mid"))


def _book(lines: DataFrame, keys: list[str]) -> DataFrame:
    signed = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).when(
        F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(0.0)
    return lines.groupBy(*keys).agg((F.sum(signed) / 1000).alias("szi"), F.min("p_retailprice").alias("entryPx"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("coin"), "p_retailprice")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book: net quantity and lowest price of each brand."""
    return _book(_lines(spark, sf_dir), ["coin"])


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each customer."""
    owner = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("account"))
    lines = _lines(spark, sf_dir).join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
    return _book(lines, ["account", "coin"])


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money and last rebalance of each customer; some have negative money, some no history."""
    key = F.col("c_custkey")
    shifted = F.lit(datetime(2024, 1, 1, 9, 30)).cast("timestamp_ntz") + F.make_dt_interval((key % 20).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("account"), F.col("c_acctbal").alias("value"), F.when(key % 7 != 0, shifted).alias("last_rebalance"))


def account_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON state document for each customer, with at most one position for each brand."""
    def text(c):
        return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")

    held = books(spark, sf_dir).groupBy("account").agg(F.collect_list(F.struct(F.struct(
        "coin", text("szi").alias("szi"), text("entryPx").alias("entryPx"),
        F.when(F.col("szi") > 0, text(F.col("entryPx") / 2)).alias("liquidationPx"),
        text(F.abs("szi")).alias("marginUsed")).alias("position"))).alias("assetPositions"))
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account")).agg(
        F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least"))
    all_accounts = accounts(spark, sf_dir).join(held, "account", "left").join(spent, "account", "left").fillna(
        0.0, ["most", "least"])
    margin = F.struct(text("value").alias("accountValue"), text("most").alias("totalNtlPos"),
                      text("least").alias("totalMarginUsed"), text(F.col("value") - F.col("least")).alias("totalRawUsd"))
    cross = F.when(F.col("account") % 3 == 0, F.struct(
        text(F.col("value") / 2).alias("accountValue"), text(F.col("least") / 2).alias("totalMarginUsed"),
        text(F.col("least") / 4).alias("totalMaintenanceMargin")))
    state = F.struct(margin.alias("marginSummary"), cross.alias("crossMarginSummary"),
                     text(F.col("value") / 4).alias("withdrawable"), "assetPositions")
    return all_accounts.select("account", F.to_json(state).alias("state"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fill for each order line, numbers as text; one line number has no fee."""
    flag = F.col("l_returnflag")
    return _lines(spark, sf_dir).select(
        _midnight_ms("l_shipdate").alias("time"), F.col("l_shipdate").alias("ts"), "coin",
        F.when(F.col("l_linestatus") == "O", "B").otherwise("A").alias("side"),
        F.when(flag == "N", "Open Long").when(flag == "A", "Close Long").otherwise("Close Short").alias("dir"),
        F.col("l_quantity").cast("string").alias("sz"), F.col("p_retailprice").cast("string").alias("px"),
        F.when(F.col("l_linenumber") != 7, F.col("l_tax").cast("string")).alias("fee"),
        F.when(flag == "N", "0.0").otherwise((F.col("l_discount") - 0.05).cast("string")).alias("closedPnl"),
        F.col("l_orderkey").alias("oid"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sent order with its JSON response for each order line; the line number decides the kind of response."""
    n, tif = F.col("l_linenumber"), F.col("l_returnflag")
    paid = F.col("p_retailprice") * (1 + F.col("l_tax") / 100)

    def statuses(inner):
        return F.concat(F.lit('{"status":"ok","response":{"type":"order","data":{"statuses":['), inner, F.lit("]}}}"))

    filled = F.concat(F.lit('{"filled":{"totalSz":"'), F.col("l_quantity").cast("string"), F.lit('","avgPx":"'),
                      paid.cast("string"), F.lit('","fee":"'), F.col("l_tax").cast("string"), F.lit('","oid":1}}'))
    no_price = F.concat(F.lit('{"filled":{"totalSz":"'), F.col("l_quantity").cast("string"), F.lit('","oid":1}}'))
    response = (
        F.when(n <= 2, statuses(filled)).when(n == 3, statuses(no_price))
        .when(n == 4, statuses(F.lit('{"resting":{"oid":77}}')))
        .when(n == 5, F.lit('{"status":"err","response":"Insufficient margin"}'))
        .when(n == 6, statuses(F.lit(""))).otherwise(statuses(F.lit('{"error":"Price too far"}'))))
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("trade_id"), n.alias("line"), "coin", (F.col("l_linestatus") == "O").alias("is_buy"),
        F.col("l_quantity").alias("sz"), F.col("p_retailprice").alias("price"),
        F.when(tif == "A", "Gtc").when(tif == "R", "Alo").otherwise("Ioc").alias("time_in_force"),
        response.alias("response"))


def resting_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open order for each row of orders; the priority decides how its type is written."""
    kind = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("oid"),
        F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("coin"),
        F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("side"),
        (F.col("o_custkey") % 10 + 1).cast("string").alias("sz"), F.col("o_totalprice").cast("string").alias("limitPx"),
        _midnight_ms("o_orderdate").alias("timestamp"),
        F.when(kind == "1", '{"trigger":{"isMarket":false,"tpsl":"sl"}}').when(kind == "2", "Stop Trigger")
        .when(kind == "3", '{"limit":{"tif":"Gtc"}}').otherwise("Limit").alias("orderType"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with the coin that an event's user stands for."""
    batch = table(spark, sf_dir, "events")
    return (
        spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        .withColumn("coin", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")))
    )


def fill_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        "ts", "coin", F.col("value").cast("string").alias("sz"),
        F.lit("1000").alias("px"), (F.col("user_id") % 5).cast("string").alias("fee"),
        (F.col("user_id") % 7 - 3).cast("string").alias("closedPnl"))


def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that arrive with orders, as a stream joined to the static order lines."""
    batch = table(spark, sf_dir, "orders")
    arriving = spark.readStream.schema(batch.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir).select(
        "o_orderkey", F.to_date("o_orderdate").cast("timestamp_ntz").alias("pred_date"), F.col("o_totalprice").alias("pred"))
    ids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(
        brands(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return arriving.join(ids, F.col("o_orderkey") == F.col("l_orderkey")).select("pred_date", "id", "pred")
