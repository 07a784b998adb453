from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from model import START, expected_daily, random_panel
from quantloom.config import BacktestConfig, StrategyParams
from quantloom.operators import panel as panel_operators
from quantloom.operators.panel import (
    TradingWindow, duplicate_keys, price_returns, rebalance_calendar, returns_wide, trading_dates, trading_window,
)
from quantloom.plans import backtest
from quantloom.plans.backtest import equity_curve
from quantloom.plans import NoTradingDates, parameter_grid, run_backtest, run_sweep
from quantloom.plans.sweep import PARAM_COLUMNS, SweepSource, SweepStore, apply_best, best_params, sweep_daily, with_run_key, grid_table
from quantloom.sources import prediction_panel, price_panel

PRICE_SCHEMA = "date timestamp_ntz, id string, close double"
PREDICTION_SCHEMA = "release_date timestamp_ntz, id string, pred_10d double"


def frames(spark, prices, scores):
    return (price_panel(spark.createDataFrame(prices, PRICE_SCHEMA)),
            prediction_panel(spark.createDataFrame(scores, PREDICTION_SCHEMA)))


def two_assets(spark):
    day = [datetime(2023, 1, n) for n in (1, 2, 3)]
    prices = [(d, "AAA", c) for d, c in zip(day, (100.0, 110.0, 121.0))] + [(d, "BBB", c) for d, c in zip(day, (100.0, 99.0, 98.0))]
    scores = [(day[0], "AAA", 0.90), (day[0], "BBB", -0.10), (day[1], "AAA", 0.85), (day[1], "BBB", -0.20)]
    return frames(spark, prices, scores)


SMALL = BacktestConfig(StrategyParams(1, 0, 1.0, 1, 0.0), fee_bps=0.0, slippage_bps=0.0, start_capital=100.0,
                       start_date=datetime(2023, 1, 2), end_date=datetime(2023, 1, 3))


def test_two_assets_end_to_end(spark):
    result = run_backtest(*two_assets(spark), SMALL)
    assert result.daily.count() == 2
    stats = result.stats.first()
    assert stats["final_equity"] == pytest.approx(110.0)
    assert stats["total_return"] == pytest.approx(0.10)
    assert stats["avg_turnover"] == pytest.approx(1.0)
    held = result.positions.collect()
    assert len(held) == 2 and {r["id"] for r in held} == {"AAA"}


def test_valid_dates_respect_bounds(spark):
    prices, predictions = two_assets(spark)
    day = datetime(2023, 1, 2)
    window = trading_window(prices, predictions, 1, day, day)
    assert window == TradingWindow(day, day)
    assert [r["date"] for r in trading_dates(prices, window).collect()] == [day]


def test_no_overlap(spark):
    prices, predictions = two_assets(spark)
    with pytest.raises(NoTradingDates):
        run_backtest(prices, predictions, replace(SMALL, prediction_lag_days=30))
    assert run_sweep(prices, predictions, [SMALL.params], replace(SMALL, prediction_lag_days=30)).count() == 0


def test_single_cell_sweep(spark):
    prices, predictions = two_assets(spark)
    grid = parameter_grid(SMALL.params, num_longs=[1], num_shorts=[0], leverages=[1.0], rebalance_days=[1], rank_powers=[0.0])
    row = run_sweep(prices, predictions, grid, SMALL).first()
    assert [row[c] for c in PARAM_COLUMNS] == [1, 0, 1.0, 1, 0.0]
    assert row["final_equity"] == pytest.approx(110.0) and row["sharpe"] >= 0


@pytest.mark.parametrize("seed, longs, shorts, gross, every, power, midday", [
    (1, 2, 2, 1.0, 5, 1.5, False), (2, 3, 2, 5.0, 3, 0.0, False), (3, 6, 5, 2.0, 4, 2.0, True), (4, 0, 3, 1.5, 1, 0.5, False)])
def test_against_model(spark, seed, longs, shorts, gross, every, power, midday):
    prices, scores = random_panel(seed, midday=midday)
    rows, books = expected_daily(prices, scores, longs, shorts, gross, every, power)
    result = run_backtest(*frames(spark, prices, scores), BacktestConfig(StrategyParams(longs, shorts, gross, every, power)))
    got = result.daily.orderBy("date").collect()
    assert [r["date"] for r in got] == [r[0] for r in rows]
    names = ["returns", "equity", "drawdown", "turnover"]
    assert np.allclose([[r[n] for n in names] for r in got], [r[1:] for r in rows], rtol=1e-9, atol=1e-11)
    weights = {(r["date"], r["id"]): r["weight"] for r in result.positions.collect()}
    wanted = {(d, a): w for d, book in books.items() for a, w in book.items()}
    assert weights.keys() == wanted.keys()
    assert all(weights[k] == pytest.approx(w, rel=1e-9) for k, w in wanted.items())


def test_sweep_equals_model(spark):
    prices, scores = random_panel(7)
    grid = parameter_grid(StrategyParams(), [2, 5], [1, 4], [0.0, 1.0, 4.0], [3, 7], [0.0, 2.0])
    daily = sweep_daily(*frames(spark, prices, scores), grid, BacktestConfig(), max_runs=20)
    last = {tuple(r[c] for c in PARAM_COLUMNS): r for r in daily.groupBy(*PARAM_COLUMNS).agg(
        F.max_by("equity", "date").alias("equity"), F.min("drawdown").alias("drawdown"), F.sum("turnover").alias("turnover")).collect()}
    assert len(last) == len(grid) == 48
    for p in grid:
        rows, _ = expected_daily(prices, scores, p.num_long, p.num_short, p.leverage, p.rebalance_days, p.rank_power)
        row = last[(p.num_long, p.num_short, p.leverage, p.rebalance_days, p.rank_power)]
        assert row["equity"] == pytest.approx(rows[-1][2], rel=1e-9)
        assert row["drawdown"] == pytest.approx(min(r[3] for r in rows), rel=1e-9)
        assert row["turnover"] == pytest.approx(sum(r[4] for r in rows), rel=1e-9)


def test_sweep_store(spark, tmp_path):
    panel = two_assets(spark)
    store = SweepStore(spark, str(tmp_path / "results"), SweepSource("p", "q"), SMALL)
    grid = parameter_grid(SMALL.params, leverages=[1.0, 2.0, 3.0])
    assert store.missing(grid) == grid
    store.run(*panel, grid[:2])
    assert store.missing(grid) == grid[2:]
    results = store.run(*panel, grid)
    assert results.count() == 3 and store.stored().count() == 3
    assert store.run(*panel, grid).count() == 3 and store.stored().count() == 3
    other = SweepStore(spark, store.path, SweepSource("p", "q", prediction_columns=("release_date", "id", "pred_30d")), SMALL)
    assert other.missing(grid) == grid
    best = best_params(results, "cagr").first()
    assert best["target_leverage"] == 3.0
    assert apply_best(*panel, results, SMALL, "cagr").stats.first()["final_equity"] == pytest.approx(130.0)
    store.clear()
    assert store.missing(grid) == grid


def test_overlapping_and_dead_writers(spark, tmp_path):
    """Two sweeps that began with the same empty store give each run once; one that dies before its commit leaves nothing."""
    panel = two_assets(spark)
    store = SweepStore(spark, str(tmp_path / "shared"), SweepSource("p", "q"), SMALL)
    grid = parameter_grid(SMALL.params, leverages=[1.0, 2.0])
    first, second = (store.write(run_sweep(*panel, store.missing(grid), SMALL)) for _ in range(2))
    store.write(run_sweep(*panel, parameter_grid(SMALL.params, leverages=[9.0]), SMALL))  # never committed
    assert store.stored().count() == 0
    store.commit(first)
    store.commit(second)
    assert sorted(r["leverage"] for r in store.stored().collect()) == [1.0, 2.0]
    assert store.run(*panel, grid, returns=price_returns(panel[0])).count() == 2 and len(store.committed()) == 2
    with pytest.raises(Exception, match="exist"):
        store.commit(first)
    store.clear()
    assert store.stored().count() == 0 and store.committed() == []


def test_long_series_in_chunks(spark):
    """A million stamps of one run, in chunks, against a running product; growth below zero turns signs."""
    n = 1_000_000
    rng = np.random.default_rng(4)
    returns, turnover = rng.normal(0, 0.002, n), np.where(rng.random(n) < 0.01, 0.3, 0.0)
    returns[600_000] = -2.0
    stamps = np.datetime64("2020-01-01") + np.arange(n) * np.timedelta64(1, "m")
    table = {"run": np.full(n, 7), "date": stamps.astype("datetime64[us]"), "returns": returns, "turnover": turnover}
    flows = spark.createDataFrame(pa.table(table))
    got = equity_curve(flows, ["run"], 100.0, 0.001, chunk_days=20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan  # every window has a key
    got = got.orderBy("date").toArrow()
    equity = 100.0 * np.cumprod((1 + returns) * (1 - turnover * 0.001))
    before = np.concatenate(([100.0], equity[:-1])) * (1 + returns)
    peak = np.maximum(100.0, np.maximum.accumulate(before))
    assert len(got) == n and np.allclose(got["equity"], equity, rtol=1e-9) and np.allclose(got["drawdown"], (before - peak) / peak, atol=1e-9)


def test_backtest_in_chunks(spark, monkeypatch):
    prices, scores = random_panel(11)
    panel = frames(spark, prices, scores)
    config = BacktestConfig(StrategyParams(3, 2, 1.5, 4, 1.0))
    whole = run_backtest(*panel, config).daily.orderBy("date").collect()
    monkeypatch.setattr(backtest, "SERIES_IN_TASK", 10)
    result = run_backtest(*panel, config)
    assert backtest.series_chunk(result.window) < result.window.days / 4
    cut = result.daily.orderBy("date").collect()
    assert [r["date"] for r in cut] == [r["date"] for r in whole]
    assert all(tuple(a)[1:] == pytest.approx(tuple(b)[1:], rel=1e-12, abs=1e-12) for a, b in zip(whole, cut))
    swept = run_sweep(*panel, parameter_grid(config.params, leverages=[1.0, 1.5]), config).where("leverage = 1.5").first()
    assert swept["final_equity"] == pytest.approx(whole[-1]["equity"], rel=1e-9)
    assert swept["max_dd"] == pytest.approx(min(r["drawdown"] for r in whole), rel=1e-9)


def test_ends_beyond_the_broadcast_bound(spark, monkeypatch):
    prices, scores = random_panel(12)
    panel = frames(spark, prices, scores)
    config = BacktestConfig(StrategyParams(3, 2, 1.5, 4, 1.0))
    small = run_backtest(*panel, config).stats.first()
    monkeypatch.setattr(panel_operators, "ROWS_TO_ALL_TASKS", 0)
    assert tuple(run_backtest(*panel, config).stats.first()) == pytest.approx(tuple(small), rel=1e-12)


def test_run_key_depends_on_everything(spark):
    table = grid_table(spark, [SMALL.params])
    configs = [SMALL, replace(SMALL, fee_bps=1.0), replace(SMALL, end_date=None)]
    sources = [SweepSource("p", "q"), SweepSource("p", "q2"), SweepSource("p", "q", provider="numerai")]
    keys = {with_run_key(table, s, c).first()["run_key"] for s in sources for c in configs}
    assert len(keys) == 9


@pytest.mark.parametrize("chunk_days", [1, 3, 1000])
def test_returns_over_chunks(spark, chunk_days):
    prices, _ = random_panel(5)
    frame = price_panel(spark.createDataFrame(prices, PRICE_SCHEMA))
    got = {(r["date"], r["id"]): r["ret"] for r in price_returns(frame, chunk_days).collect()}
    before, wanted = {}, {}
    for when, asset, close in sorted(prices, key=lambda r: (r[1], r[0])):
        wanted[(when, asset)] = close / before[asset] - 1 if asset in before else None
        before[asset] = close
    assert got.keys() == wanted.keys()
    for key, value in wanted.items():
        assert got[key] is None if value is None else got[key] == pytest.approx(value, nan_ok=True)


def test_zero_close_and_duplicates(spark):
    rows = [(datetime(2023, 1, n), "A", c) for n, c in ((1, 0.0), (2, 5.0), (3, 10.0))]
    frame = price_panel(spark.createDataFrame(rows, PRICE_SCHEMA))
    assert [r["ret"] for r in price_returns(frame).orderBy("date").collect()] == [None, None, 1.0]
    assert duplicate_keys(frame).count() == 0
    assert duplicate_keys(frame.unionByName(frame)).count() == 3
    wide = returns_wide(price_returns(frame), ["A", "B"])
    assert wide.columns == ["date", "A", "B"]


def test_calendar_of_minutes(spark):
    """Several dates a day: a step is the first day's time of day, and holds from the next minute on."""
    start = datetime(2023, 1, 2, 9, 30)
    minutes = [start + timedelta(days=d, minutes=m) for d in range(12) if d != 4 for m in range(-30, 31, 15) if d or m >= 0]
    dates = spark.createDataFrame([(m,) for m in minutes], "date timestamp_ntz")
    window = TradingWindow(minutes[0], minutes[-1])
    got = {(r["rebalance_days"], r["date"]): (r["k"], r["held_k"]) for r in rebalance_calendar(dates, window, [2, 3]).collect()}
    for n in (2, 3):
        held = None
        for m in sorted(minutes):
            days, rest = divmod(m - start, timedelta(days=n))
            k = days if not rest else None
            assert got[n, m] == (k, held)
            held = held if k is None else k
    assert len(got) == 2 * len(minutes)


def test_missed_step_is_skipped(spark):
    dates = spark.createDataFrame([(datetime(2023, 1, n),) for n in (1, 2, 4, 6, 7)], "date timestamp_ntz")
    window = TradingWindow(START, datetime(2023, 1, 7))
    got = rebalance_calendar(dates, window, [2]).orderBy("date").collect()
    assert [(r["date"].day, r["k"], r["held_k"]) for r in got] == [(1, 0, None), (2, None, 0), (4, None, 0), (6, None, 0), (7, 3, 0)]
