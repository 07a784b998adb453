"""Inputs that are not as they should be: repeated keys, NaN, texts that are no numbers, no shared folder."""

import json
import math

import pytest
from pyspark.sql import functions as F

from checks import tables as T
from quantloom.config import BacktestConfig, StrategyParams
from quantloom.functions import one_row_each
from quantloom.operators.fills import fee_summary, pnl_by_coin, pnl_totals
from quantloom.operators.orders import UNREADABLE, classify_responses
from quantloom.operators.panel import price_returns
from quantloom.operators.portfolio import account_metrics, mark_to_market, open_positions, parse_state
from quantloom.operators.stops import NO_PRICE, stop_levels, stop_report
from quantloom.operators.trades import NOT_A_NUMBER, plan_trades
from quantloom.operators.weights import MIN_POWER, rank_sums, target_notionals
from quantloom.plans import parameter_grid, run_backtest, run_sweep
from quantloom.plans.sweep import apply_best, best_params, top_results
from quantloom.session import remove_path, shared_dir, work_path

SF = "/root/testdata/sf0.001"
CONFIG = BacktestConfig(StrategyParams(3, 3, 1.0, 10, 1.0))

# A fill history as (coin, side, dir, sz, px, fee, closedPnl, oid) and what it has to add up to.
FILLS = [
    ("BTC", "A", "Close Long", "0.0004", "110577.00", "0.02", "-5.91", 4172812081), ("BTC", "B", "Open Long", "0.0004", "125341.00", "0.02", "0.0", 4026434298),
    ("SOL", "B", "Open Long", "0.1600", "189.00", "0.01", "0.0", 4172807304), ("SOL", "B", "Open Long", "0.2100", "235.20", "0.02", "0.0", 4026434782),
    ("ETH", "B", "Open Long", "0.0079", "3851.40", "0.01", "0.0", 4172805889), ("ETH", "B", "Open Long", "0.0100", "4702.60", "0.02", "0.0", 4026434667),
    ("ETH", "B", "Open Long", "0.0006", "4703.20", "0.00", "0.0", 4026434667), ("APE", "A", "Close Long", "112.6000", "0.44", "0.02", "-0.15", 4172805310),
    ("APE", "B", "Open Long", "112.6000", "0.44", "0.02", "0.0", 4172769095), ("GRASS", "B", "Close Short", "114.9000", "0.43", "0.02", "0.10", 4172805253),
    ("GRASS", "A", "Open Short", "114.9000", "0.43", "0.02", "0.0", 4172769529), ("MAV", "B", "Close Short", "844.0000", "0.04", "0.01", "17.26", 4172768974),
    ("MAV", "A", "Open Short", "844.0000", "0.06", "0.02", "0.0", 4026435452), ("APT", "A", "Close Long", "9.2400", "3.30", "0.01", "-19.45", 4172768912),
    ("APT", "B", "Open Long", "9.2400", "5.41", "0.02", "0.0", 4026434856), ("RSR", "B", "Close Short", "7629.0000", "0.01", "0.02", "8.51", 4172768705),
    ("RSR", "A", "Open Short", "7629.0000", "0.01", "0.02", "0.0", 4026436090), ("BNB", "A", "Close Long", "0.0410", "1118.50", "0.02", "-4.34", 4172768002),
    ("BNB", "B", "Open Long", "0.0410", "1224.40", "0.02", "0.0", 4026433914)]
REALIZED = {"BTC": -5.91, "APE": -0.15, "GRASS": 0.10, "MAV": 17.26, "APT": -19.45, "RSR": 8.51, "BNB": -4.34, "SOL": 0.0, "ETH": 0.0}
UNREALIZED = {"SOL": 1.65, "ETH": 1.85, "BTC": 0.0}


def test_fill_history(spark):
    fills = spark.createDataFrame(FILLS, "coin string, side string, dir string, sz string, px string, fee string, closedPnl string, oid long")
    held = spark.createDataFrame(list(UNREALIZED.items()), "coin string, unrealized_pnl double")
    pnl = pnl_by_coin(fills, held)
    rows = {r.coin: r for r in pnl.collect()}
    assert {c: r.realized_pnl for c, r in rows.items()} == pytest.approx(REALIZED)
    assert all(rows[c].unrealized_pnl == UNREALIZED.get(c, 0.0) and rows[c].n_unreadable == 0 for c in rows)
    assert rows["BTC"].fees == pytest.approx(0.04) and rows["BTC"].volume == pytest.approx(0.0004 * (110577 + 125341))
    total = [r for r in pnl_totals(pnl).collect() if r.coin == "TOTAL"][0]
    assert total.realized_pnl == pytest.approx(sum(REALIZED.values())) and total.unrealized_pnl == pytest.approx(3.5)


def test_repeated_price_is_refused(spark):
    prices, predictions = T.prices(spark, SF), T.predictions(spark, SF)
    some = prices.agg(F.min("id")).head()[0]
    doubled = prices.unionByName(prices.where(F.col("id") == some))
    assert run_backtest(prices, predictions, CONFIG).stats.count() == 1
    with pytest.raises(Exception, match="Repeated .date, id. in prices"):
        run_backtest(doubled, predictions, CONFIG).stats.collect()
    with pytest.raises(Exception, match="Repeated .date, id. in prices"):
        price_returns(doubled).collect()


def test_repeated_keys_of_small_tables_are_refused(spark):
    twice = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 1.0)], "coin string, mid double")
    held = spark.createDataFrame([("A", 2.0, 1.0)], "coin string, szi double, entryPx double")
    for frame in (one_row_each(twice, ["coin"], "mids"), mark_to_market(held, twice)):
        with pytest.raises(Exception, match="Repeated key in mids"):
            frame.collect()
    assert one_row_each(twice.where("mid = 1"), ["coin"], "mids").count() == 2


def test_nan_is_not_missing(spark):
    nan = float("nan")
    targets = spark.createDataFrame([("A", nan), ("B", 100.0)], "coin string, target_value double")
    held = spark.createDataFrame([("A", 5.0), ("C", 2.0)], "coin string, szi double")
    mids = spark.createDataFrame([("A", 10.0), ("B", 10.0), ("C", 10.0)], "coin string, mid double")
    universe = spark.createDataFrame([(c, 2) for c in "ABC"], "name string, szDecimals int").withColumn("isDelisted", F.lit(False))
    plan = {r.coin: r for r in plan_trades(targets, held, mids, universe, 10.0).collect()}
    assert plan["A"].skipped and plan["A"].skip_reason == NOT_A_NUMBER and plan["A"].sz is None
    assert plan["B"].type == "open" and plan["C"].type == "close" and not plan["C"].skipped
    book = spark.createDataFrame([("A", 0.5)], "id string, weight double")
    accounts = spark.createDataFrame([("x", nan), ("y", 10.0), ("z", -1.0)], "account string, value double")
    assert [tuple(r) for r in target_notionals(book, accounts).collect()] == [("y", "A", 5.0)]
    books = spark.createDataFrame([(s, f"{s}{i}", 0.5 + i) for s in "pq" for i in range(40)], "strategy string, id string, weight double")
    funded = spark.createDataFrame([("p", "x", 2.0), ("q", "y", 4.0), ("r", "z", 4.0)], "strategy string, account string, value double")
    got = {(r.account, r.id): r.target_value for r in target_notionals(books, funded, group=["strategy"]).collect()}
    assert got == {(a, f"{s}{i}"): v * (0.5 + i) for s, a, v in (("p", "x", 2.0), ("q", "y", 4.0)) for i in range(40)}
    fills = spark.createDataFrame([("A", "1", "2", "0", "NaN"), ("A", "1", "2", "0", "5"), ("B", "1", "2", "0", None)], "coin string, sz string, px string, fee string, closedPnl string")
    none = spark.createDataFrame([], "coin string, unrealized_pnl double")
    got = {r.coin: r.realized_pnl for r in pnl_by_coin(fills, none).collect()}
    assert math.isnan(got["A"]) and got["B"] == 0.0


def test_unreadable_numbers_are_reported(spark):
    fills = spark.createDataFrame([("A", "x", "2", "0", "1"), ("A", "1", "10", "0.1", "1")], "coin string, sz string, px string, fee string, closedPnl string")
    row = fee_summary(fills).head()
    assert (row.n_fills, row.volume, row.n_unreadable) == (2, 10.0, 1)
    state = {"marginSummary": {"accountValue": "oops", "totalNtlPos": "5"}, "assetPositions": [
        {"position": {"coin": "A", "szi": "1,000", "entryPx": "2"}}, {"position": {"coin": "B", "szi": "0"}}, {"position": {"coin": "C", "szi": "3"}}]}
    states = parse_state(spark.createDataFrame([(1, json.dumps(state))], "account int, state string"))
    rows = {r.coin: r for r in open_positions(states).collect()}
    assert rows.keys() == {"A", "C"} and rows["A"].szi is None and rows["A"].unreadable and not rows["C"].unreadable
    metrics = account_metrics(states).head()
    assert metrics.unreadable and metrics.account_value is None and metrics.current_leverage is None and metrics.margin_used == 0.0
    response = json.dumps({"status": "ok", "response": {"data": {"statuses": [{"filled": {"totalSz": "1", "avgPx": "abc"}}]}}})
    sent = spark.createDataFrame([("A", True, 10.0, "Ioc", response)], "coin string, is_buy boolean, price double, time_in_force string, response string")
    out = classify_responses(sent).head()
    assert out.status == "failed" and out.error == UNREADABLE and out.slippage_pct is None


def test_stop_without_a_price_is_not_applied(spark):
    held = spark.createDataFrame([("A", 1.0, 1234.5), ("B", 1.0, 1234.5)], "coin string, szi double, entryPx double")
    universe = spark.createDataFrame([("A", 9), ("B", 12)], "name string, szDecimals int").withColumn("isDelisted", F.lit(False))
    levels = stop_levels(held, universe, "both", 0.17, 0.05)
    got = {r.coin: (r.trigger_px, r.skip_reason) for r in levels.collect()}
    assert got == {"A": (1000.0, None), "B": (None, NO_PRICE)}
    assert {r.outcome: r.n for r in stop_report(levels).collect()} == {"applied": 1, NO_PRICE: 1}


def test_rank_sums_are_linear_and_exact():
    for num, power in ((1, 0.0), (7, 1.5), (60, 2.0), (200, 80.0)):
        want = [sum(((m - i + 1) / m) ** max(power, MIN_POWER) for i in range(1, m + 1)) for m in range(1, num + 1)]
        assert rank_sums(num, power) == pytest.approx(want, rel=1e-12)
    assert len(rank_sums(100_000, 1.5)) == 100_000 and rank_sums(0, 1.0) == []


def test_best_parameters_do_not_depend_on_the_partitions(spark):
    prices, predictions = T.prices(spark, SF), T.predictions(spark, SF)
    grid = parameter_grid(StrategyParams(), [3, 5], [2], [1.0, 3.0, 5.0], [8, 10], [0.0, 1.5])
    assert parameter_grid(StrategyParams(), []) == []
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for width in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            results = run_sweep(prices, predictions, grid, CONFIG, returns=price_returns(prices))
            best = best_params(results).head()
            seen.append((tuple(best), [(r.num_long, r.leverage, r.rebalance_days, r.rank_power) for r in top_results(results, "sharpe", 6).orderBy("place").collect()]))
            assert best.target_leverage == 1.0  # leverage does not change the Sharpe ratio, so the first of its values is taken
            assert apply_best(prices, predictions, results, CONFIG).config.params.leverage == 1.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


class Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class Session:
    def __init__(self, **values):
        self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})


def test_shared_folder(spark):
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(spark_master=master))
        assert shared_dir(Session(spark_master=master, spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"
    local = Session(spark_master="local[2]")
    assert shared_dir(local) == shared_dir(local)
    path = work_path(spark, "gone")
    spark.range(3).write.parquet(path)
    remove_path(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        remove_path(spark, "/somewhere/else")


def test_books_and_accounts_meet_in_blocks(spark):
    """However the two sides are cut, every funded account meets every asset of its book once."""
    book = spark.createDataFrame([(s, f"{s}{i}", float(i)) for s in "ab" for i in range(1, 8)], "strategy string, id string, weight double")
    accounts = spark.createDataFrame([(s, n, float(n)) for s in "abc" for n in range(-1, 10)], "strategy string, account int, value double")
    want = {(s, n, f"{s}{i}"): float(n * i) for s in "ab" for n in range(1, 10) for i in range(1, 8)}
    for sizes in ((2, 3), (100, 100)):
        rows = target_notionals(book, accounts, None, ["strategy"], *sizes).collect()
        assert len(rows) == len(want) and {(r.strategy, r.account, r.id): r.target_value for r in rows} == want
