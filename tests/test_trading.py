import json
import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quantloom.functions import with_half_even, with_perp_price, with_size_up
from quantloom.operators.fills import (
    fee_summary, fills_between, fills_last_days, fills_of_coin, newest_fills, pnl_by_coin, pnl_totals,
)
from quantloom.operators.orders import classify_responses, execution_summary, failed_trades, open_orders, trigger_orders
from quantloom.operators.portfolio import account_metrics, exposure, mark_to_market, open_positions, parse_state
from quantloom.operators.schedule import countdown, due_accounts, next_rebalance
from quantloom.operators.stops import stop_levels, stop_report
from quantloom.operators.trades import execution_order, executable, plan_close_all, plan_summary, plan_trades, skipped


def test_rounding_matches_python(spark):
    rng = random.Random(3)
    values = [2.675, 2.665, 0.5, 1.5, 2.5, 1.005, 1e-9, 0.0, 12345.678, 5012.65, 0.025, 1e16, 123456789.123456]
    values += [rng.uniform(0, 10 ** rng.randint(-4, 6)) for _ in range(300)]
    values += [round(rng.uniform(0, 1000), 4) + 0.00005 for _ in range(300)]
    rows = [(v * s, d) for v in values for s in (1, -1) for d in range(-6, 16)] + [(15.0, -1), (25.0, -1), (250.0, -2), (1.0, None), (1.23456789012345, 12), (2.0 ** 52 + 0.5, 0), (4503599627370497.5, 0), (1e300, 5), (1e300, -5), (7.0, -400), (1e-20, 18), (5e-324, 300)]
    # Both neighbours of a midpoint, and doubles that are one.
    for d in (0, 1, 2, 4, 6, 9, 12, 20, 30):
        for k in (rng.randrange(10 ** 7) for _ in range(60)):
            middle = (k + 0.5) / 10.0 ** d
            rows += [(middle, d), (math.nextafter(middle, 0.0), d), (-math.nextafter(middle, math.inf), d)]
        rows += [((2 * k + 1) / 2.0 ** (d + 1), d) for k in range(20)]
    rows += [(math.inf, 2), (-math.inf, -2), (None, 2), (1.5, 2 ** 31 - 1)]
    frame = spark.createDataFrame(rows, "v double, d int")
    for r in with_half_even(frame, "got", F.col("v"), F.col("d")).collect():
        if r["v"] is None or math.isinf(r["v"]):
            assert r["got"] == r["v"]
            continue
        assert r["got"] == (None if r["d"] is None else round(r["v"], r["d"])), r


def test_price_rule(spark):
    rng = random.Random(4)
    values = [100_000.0, 100_000.5, 100_001.5, 250_000.4, 99_999.5, 38228.5, 38229.5, 5012.65, 1.23456, 0.00012345678, 1e-6, 0.0, 999.9999, 1.23456e-9, 7.654325e-12, 1024.6]
    values += [rng.uniform(0, 10 ** rng.randint(-5, 6)) for _ in range(400)]
    rows = [(v, d) for v in values for d in (None, 0, 1, 3, 5, 7, 8, 9, 12)]
    frame = spark.createDataFrame(rows, "px double, d int")
    for r in with_perp_price(frame, "got", F.col("px"), F.col("d")).collect():
        digits = float(f"{r['px']:.5g}")
        want = float(round(r["px"])) if r["px"] > 100_000 else digits if r["d"] is None else round(digits, 6 - r["d"])
        assert r["got"] == want, r


def test_size_up(spark):
    frame = spark.createDataFrame([(10.0, 3.0, 0), (10.0, 3.0, 2), (10.0, 1030.0, 3), (10.0, 0.0, 2), (10.0, 5.0, None)], "n double, p double, d int")
    got = [r["up"] for r in with_size_up(frame, "up", F.col("n"), F.col("p"), F.col("d")).collect()]
    assert got == [4.0, 3.34, 0.01, 0.0, None]


def book(spark, rows):
    return spark.createDataFrame(rows, "coin string, szi double, entryPx double")


@pytest.fixture(scope="module")
def market(spark):
    mids = spark.createDataFrame([("BTC", 50_000.0), ("ETH", 2_000.0), ("SOL", 100.0), ("OLD", 1.0), ("DOGE", 0.1), ("ADA", 2.0)], "coin string, mid double")
    universe = spark.createDataFrame(
        [("BTC", 5, False), ("ETH", 4, None), ("SOL", 2, False), ("OLD", 2, True), ("DOGE", 0, False), ("ADA", None, False), ("XRP", 0, False)],
        "name string, szDecimals int, isDelisted boolean")
    return mids, universe


def test_trade_types_and_skips(spark, market):
    mids, universe = market
    targets = spark.createDataFrame(
        [("BTC", 1000.0), ("ETH", -500.0), ("SOL", 300.0), ("XRP", 50.0), ("OLD", 20.0), ("DOGE", 0.01), ("ADA", 4.0)], "coin string, target_value double")
    held = book(spark, [("ETH", 0.5, 1900.0), ("SOL", 1.0, 90.0), ("LINK", 1.0, 10.0)])
    plan = {r["coin"]: r for r in plan_trades(targets, held, mids, universe, 10.0).collect()}
    assert (plan["BTC"]["type"], plan["BTC"]["sz"], plan["BTC"]["is_buy"]) == ("open", 0.02, True)
    assert (plan["ETH"]["type"], plan["ETH"]["sz"], plan["ETH"]["is_buy"]) == ("flip", 0.75, False)
    assert (plan["SOL"]["type"], plan["SOL"]["sz"]) == ("increase", 2.0)
    assert plan["SOL"]["estimated_fee"] == pytest.approx(200 * 0.00035)
    assert plan["XRP"]["skip_reason"] == plan["LINK"]["skip_reason"] == "No mid price available"
    assert plan["OLD"]["skip_reason"] == "Unknown szDecimals (meta)"
    assert plan["DOGE"]["skip_reason"] == "Rounded size is 0 at 0 dp"
    assert plan["ADA"]["skip_reason"] == "Below minimum $10.0" and plan["ADA"]["sz"] == 2.0
    assert plan["DOGE"]["sz"] is None and plan["DOGE"]["price"] is None
    frame = plan_trades(targets, held, mids, universe, 10.0)
    assert executable(frame).count() == 3 and skipped(frame).count() == 5
    summary = plan_summary(frame).first()
    assert (summary["n_trades"], summary["n_buy"], summary["n_sell"], summary["n_skipped"]) == (3, 2, 1, 5)


def test_forced_close(spark, market):
    mids, universe = market
    held = book(spark, [("SOL", 0.05, 90.0), ("ETH", -0.001, 1900.0), ("BTC", 0.1, 40_000.0)])
    plain = {r["coin"]: r for r in plan_close_all(held, mids, universe, 10.0).collect()}
    assert plain["SOL"]["skipped"] and plain["ETH"]["skipped"] and plain["BTC"]["type"] == "close"
    forced = execution_order(plan_close_all(held, mids, universe, 10.0, force=True)).collect()
    assert [(r["coin"], r["type"], r["force_seq"]) for r in forced] == [
        ("ETH", "increase", 0), ("ETH", "close", 1), ("SOL", "increase", 0), ("SOL", "close", 1), ("BTC", "close", None)]
    eth_up, eth_close, sol_up, sol_close, _ = forced
    assert (sol_up["is_buy"], sol_up["sz"], sol_close["is_buy"], sol_close["sz"]) == (True, 0.1, False, 0.15)
    assert (eth_up["is_buy"], eth_up["sz"], eth_close["is_buy"], eth_close["sz"]) == (False, 0.005, True, 0.006)
    assert sol_up["target_value"] == pytest.approx(15.0) and sol_close["delta_value"] == pytest.approx(-15.0)
    assert eth_close["target_value"] == 0.0 and eth_close["force_id"] == "force_close:ETH"


def test_execution_priority(spark):
    rows = [("A", "open", False), ("B", "increase", False), ("C", "flip", False), ("D", "reduce", False), ("E", "close", False)]
    plan = spark.createDataFrame(rows, "coin string, type string, force boolean").withColumns(
        {"force_id": F.lit(None).cast("string"), "force_seq": F.lit(None).cast("int")})
    assert [r["coin"] for r in execution_order(plan).collect()] == ["E", "C", "D", "B", "A"]


def test_account_state(spark):
    state = {"marginSummary": {"accountValue": "1000", "totalNtlPos": "2500", "totalMarginUsed": "400", "totalRawUsd": "-10"},
             "crossMarginSummary": {"accountValue": "500", "totalMarginUsed": "100", "totalMaintenanceMargin": "50"}, "withdrawable": "77",
             "assetPositions": [{"position": {"coin": "BTC", "szi": "-0.5", "entryPx": "100", "liquidationPx": None, "marginUsed": "3"}},
                                {"position": {"coin": "ETH", "szi": "0.0", "entryPx": "1"}}]}
    states = parse_state(spark.createDataFrame([(1, json.dumps(state)), (2, "{}")], "account int, state string"))
    one, two = account_metrics(states).orderBy("account").collect()
    assert (one["free_collateral"], one["current_leverage"], one["cross_leverage"], one["withdrawable"]) == (600.0, 2.5, 0.5, 77.0)
    assert two["current_leverage"] == 0 and two["cross_leverage"] is None
    held = open_positions(states)
    assert [(r["coin"], r["szi"]) for r in held.collect()] == [("BTC", -0.5)]
    mids = spark.createDataFrame([("BTC", 90.0)], "coin string, mid double")
    row = mark_to_market(held, mids).first()
    assert (row["side"], row["value"], row["unrealized_pnl"], row["return_pct"], row["margin_used" if "margin_used" in row else "marginUsed"]) == (
        "SHORT", 45.0, 5.0, pytest.approx(10.0), 3.0)
    total = exposure(mark_to_market(held, mids)).first()
    assert (total["net_exposure"], total["total_exposure"], total["n_short"]) == (-45.0, 45.0, 1)
    assert exposure(mark_to_market(held, mids).where("false")).first()["total_exposure"] == 0.0


def response(*statuses):
    return json.dumps({"status": "ok", "response": {"type": "order", "data": {"statuses": list(statuses)}}})


def test_order_outcomes(spark):
    rows = [("A", True, 100.0, "Ioc", response({"filled": {"totalSz": "2", "avgPx": "101", "fee": "0.5", "oid": 1}})),
            ("B", False, 100.0, "Ioc", response({"filled": {"totalSz": "2", "avgPx": "101", "oid": 1}})),
            ("C", True, 100.0, "Gtc", response({"resting": {"oid": 9}})), ("D", True, 100.0, "Ioc", response({"resting": {"oid": 9}})),
            ("E", True, 100.0, "Ioc", json.dumps({"status": "err", "response": "no margin"})), ("F", True, 100.0, "Ioc", response()),
            ("G", True, 100.0, "Ioc", response({"error": "bad tick"})), ("H", True, 100.0, "Ioc", response({"filled": {"totalSz": "1"}}))]
    sent = spark.createDataFrame(rows, "coin string, is_buy boolean, price double, time_in_force string, response string")
    found = classify_responses(sent)
    got = {r["coin"]: (r["status"], r["error"], r["slippage_pct"]) for r in found.collect()}
    assert got == {"A": ("filled", None, pytest.approx(1.0)), "B": ("filled", None, pytest.approx(-1.0)), "C": ("resting", None, None),
                   "D": ("failed", "Order rejected or not filled", None), "E": ("failed", "no margin", None),
                   "F": ("failed", "No status returned", None), "G": ("failed", "bad tick", None), "H": ("filled", None, 0.0)}
    row = execution_summary(found).first()
    assert (row["n_success"], row["n_failed"], row["avg_slippage"], row["actual_fees"], row["filled_volume"]) == (4, 4, 0.0, 0.5, 404.0)
    assert sorted(r["coin"] for r in failed_trades(sent, found).collect()) == ["D", "E", "F", "G"]


def test_open_and_trigger_orders(spark):
    rows = [(1, "BTC", "B", "0.5", "100.5", 1704067200123, '{"trigger": {"tpsl": "sl"}}'), (2, "ETH", "A", "1", "2", 0, "Stop TRIGGER"),
            (3, "ETH", "A", "1", "2", 0, '{"limit": {"tif": "trigger"}}'), (4, "ETH", "B", "1", "2", 0, "Limit")]
    orders = spark.createDataFrame(rows, "oid long, coin string, side string, sz string, limitPx string, timestamp long, orderType string")
    first = open_orders(orders, "BTC").first()
    assert (first["side"], first["size"], first["placed_at"]) == ("BUY", 0.5, datetime(2024, 1, 1, 0, 0, 0, 123000))
    assert open_orders(orders).count() == 4
    assert sorted(r["oid"] for r in trigger_orders(orders).collect()) == [1, 2]


FILLS = [("BTC", "10.5", "0.05", "1.0", "50000.0"), ("BTC", "2.1", "0.03", "0.5", "50000.0"), ("ETH", "-5.3", "0.10", "10.0", "3000.0")]


def fill_frame(spark, rows=FILLS):
    return spark.createDataFrame(rows, "coin string, closedPnl string, fee string, sz string, px string")


def test_pnl_by_coin(spark):
    positions = spark.createDataFrame([("SOL", 1.65), ("ETH", 1.85)], "coin string, unrealized_pnl double")
    rows = pnl_by_coin(fill_frame(spark), positions).collect()
    assert [r["coin"] for r in rows] == ["BTC", "ETH", "SOL"]
    btc, eth, sol = rows
    assert (btc["fees"], btc["volume"], btc["unrealized_pnl"]) == (pytest.approx(0.08), 75_000.0, 0.0)
    assert (eth["fees"], eth["volume"], eth["realized_pnl"]) == (pytest.approx(0.10), 30_000.0, pytest.approx(-5.3))
    assert (sol["realized_pnl"], sol["volume"], sol["unrealized_pnl"]) == (0.0, 0.0, 1.65)
    totals = pnl_totals(pnl_by_coin(fill_frame(spark), positions)).collect()
    assert totals[-1]["coin"] == "TOTAL" and totals[-1]["realized_pnl"] == pytest.approx(7.3)
    assert totals[-1]["total_pnl"] == pytest.approx(7.3 + 3.5)
    assert pnl_by_coin(fill_frame(spark).where("false"), positions.where("false")).count() == 0


def test_fill_filters_and_fees(spark):
    def ms(*when):
        return int((datetime(*when) - datetime(1970, 1, 1)).total_seconds() * 1000)

    rows = [(ms(2024, 10, 26, 4, 48), "BTC", "1", "10", "0.5"), (ms(2024, 10, 6, 19), "BTC", "2", "10", None), (ms(2024, 10, 27), "eth", "1", "5", "0.1")]
    frame = spark.createDataFrame(rows, "time long, coin string, sz string, px string, fee string")
    assert fills_between(frame).count() == 3
    assert fills_between(frame, date(2024, 10, 26)).count() == 2
    assert fills_between(frame, date(2024, 10, 26), date(2024, 10, 27)).count() == 2
    assert fills_between(frame, end=date(2024, 10, 26)).count() == 1
    assert fills_last_days(frame, 1, datetime(2024, 10, 26, 12)).count() == 1
    assert fills_of_coin(frame, "ETH").count() == 1 and fills_of_coin(frame, "btc").count() == 2
    assert [r["coin"] for r in newest_fills(frame, 2).collect()] == ["eth", "BTC"]
    row = fee_summary(frame, 0.01).first()
    assert (row["n_fills"], row["volume"], row["actual_fees"], row["n_missing_fee"]) == (3, 35.0, pytest.approx(0.6), 1)
    assert row["fee_diff_pct"] == pytest.approx(abs(0.6 - 0.35) / 0.6 * 100)
    free = fee_summary(frame.drop("fee")).first()
    assert free["n_missing_fee"] == 3 and free["fee_diff_pct"] is None


def test_stops(spark, market):
    _, universe = market
    held = book(spark, [("BTC", 0.123456, 50_000.0), ("ETH", -1.0, 2_000.0), ("SOL", 1.0, 0.0), ("OLD", 1.0, 5.0), ("ADA", 0.0, 5.0)])
    levels = stop_levels(held, universe, "both", 0.17, 0.05)
    got = {r["coin"]: r for r in levels.collect()}
    assert set(got) == {"BTC", "ETH", "SOL", "OLD"}
    assert (got["BTC"]["trigger_px"], got["BTC"]["limit_px"], got["BTC"]["sz"], got["BTC"]["is_buy"]) == (41_500.0, 39_425.0, 0.12346, False)
    assert (got["ETH"]["trigger_px"], got["ETH"]["limit_px"], got["ETH"]["is_buy"]) == (2_340.0, 2_457.0, True)
    assert got["SOL"]["skip_reason"] == "Invalid entry price" and got["OLD"]["skip_reason"] == "Unknown szDecimals"
    report = {r["outcome"]: (r["n"], r["side_skip"]) for r in stop_report(stop_levels(held, universe, "short_only", 0.17, 0.05)).collect()}
    assert report == {"Side LONG not configured": (3, True), "applied": (1, False)}
    assert stop_levels(held, universe, "none", 0.17, 0.05).where("skip_reason is null").count() == 0
    with pytest.raises(ValueError):
        stop_levels(held, universe, "some", 0.17, 0.05)


def test_schedule(spark):
    accounts = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 15, 23, 0)), (3, datetime(2024, 1, 20, 1, 0))], "account int, last_rebalance timestamp_ntz")
    early, late = datetime(2024, 1, 25, 10), datetime(2024, 1, 25, 20)
    assert [r["next_rebalance"] for r in next_rebalance(accounts, 10, "18:15", early).orderBy("account").collect()] == [
        datetime(2024, 1, 25, 18, 15), datetime(2024, 1, 25, 18, 15), datetime(2024, 1, 30, 18, 15)]
    after = next_rebalance(accounts, 10, "18:15", late)
    assert after.where("account = 1").first()["next_rebalance"] == late
    assert sorted(r["account"] for r in due_accounts(after, late).collect()) == [1, 2]
    waiting = countdown(after, late).where("account = 3").first()
    assert waiting["seconds_until"] == 4 * 86_400 + 22 * 3_600 + 15 * 60 and waiting["seconds_since"] == 5 * 86_400 + 19 * 3_600
