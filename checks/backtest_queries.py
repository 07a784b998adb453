"""Backtest series, statistics and position analytics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quantloom.config import BacktestConfig, StrategyParams
from quantloom.operators import positions as N
from quantloom.operators import statistics as K
from quantloom.plans import run_backtest
from quantloom.session import work_path
from quantloom.sources import load_table, write_csv

from . import sql as Q
from . import tables as T
from .registry import days, numbered, query, rounded

CONFIG = BacktestConfig(StrategyParams(num_long=5, num_short=4, leverage=2.0, rebalance_days=10, rank_power=1.5))
ONE = "VALUES (0, 5, 4, 2.0, 10, 1.5)"
BT = Q.backtest(ONE)
STAT_NAMES = ["total_return", "cagr", "annual_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio",
              "win_rate", "avg_turnover"]
STAT_SQL = "days, " + ", ".join(Q.r(s, s) for s in STAT_NAMES) + ", " + Q.r("final_equity", "final_equity", 2)
DAILY_SQL = ("CAST(date AS VARCHAR) AS date, " + ", ".join(Q.r(c, c) for c in ("returns", "drawdown", "turnover"))
             + ", " + Q.r("equity", "equity", 2))


def backtest(spark, d, config=CONFIG):
    return run_backtest(T.prices(spark, d), T.predictions(spark, d), config)


def daily_rows(daily):
    return rounded(rounded(days(daily, "date"), "returns", "drawdown", "turnover"), "equity", places=2)


def stat_rows(stats):
    return rounded(rounded(stats, *STAT_NAMES), "final_equity", places=2)


@query(BT + f"SELECT CAST(date AS VARCHAR) AS date, {Q.r('returns', 'returns')} FROM daily")
def portfolio_returns(spark, d):
    return rounded(days(backtest(spark, d).daily, "date"), "returns").select("date", "returns")


@query(BT + f"""SELECT CAST(date AS VARCHAR) AS date, {Q.r('turnover', 'turnover')}, {Q.r('turnover * 0.0054', 'cost')}
  FROM daily WHERE turnover > 0""")
def rebalance_turnover(spark, d):
    daily = backtest(spark, d).daily.where("turnover > 0").withColumn("cost", F.col("turnover") * CONFIG.cost_rate)
    return rounded(days(daily, "date"), "turnover", "cost").select("date", "turnover", "cost")


@query(BT + f"SELECT CAST(date AS VARCHAR) AS date, {Q.r('equity', 'equity', 2)}, {Q.r('drawdown', 'drawdown')} FROM daily")
def equity_and_drawdown(spark, d):
    return daily_rows(backtest(spark, d).daily).select("date", "equity", "drawdown")


@query(BT + f"SELECT CAST(date AS VARCHAR) AS date, id, {Q.r('weight', 'weight')} FROM w")
def rebalance_positions(spark, d):
    return rounded(days(backtest(spark, d).positions, "date"), "weight")


@query(BT + f"SELECT {DAILY_SQL} FROM daily")
def backtest_daily(spark, d):
    return daily_rows(backtest(spark, d).daily)


@query(BT + f"SELECT {STAT_SQL} FROM stats")
def backtest_stats(spark, d):
    return stat_rows(backtest(spark, d).stats)


@query(Q.backtest("VALUES (0, 12, 14, 1.0, 7, 0.0)", "1996-03-01", "1999-10-31", 0.0, 1000.0) + f"SELECT {STAT_SQL} FROM stats")
def backtest_stats_bounded(spark, d):
    config = BacktestConfig(StrategyParams(12, 14, 1.0, 7, 0.0), fee_bps=0.0, slippage_bps=0.0, start_capital=1000.0,
                            start_date=datetime(1996, 3, 1), end_date=datetime(1999, 10, 31))
    return stat_rows(backtest(spark, d, config).stats)


@query(Q.backtest("VALUES (0, 3, 0, 5.0, 12, 0.5)") + f"SELECT {DAILY_SQL} FROM daily")
def backtest_long_only(spark, d):
    return daily_rows(backtest(spark, d, CONFIG.with_params(
        num_long=3, num_short=0, leverage=5.0, rebalance_days=12, rank_power=0.5)).daily)


@query(BT + f"SELECT {DAILY_SQL} FROM daily")
def daily_csv_round_trip(spark, d):
    path = work_path(spark, "daily") + ".csv"
    write_csv(backtest(spark, d).daily, path)
    return daily_rows(load_table(path, spark, "date timestamp_ntz, returns double, equity double, drawdown double, turnover double"))


@query(BT + f"""SELECT CAST(date AS VARCHAR) AS date, id, {Q.r('weight', 'weight')},
  row_number() OVER (ORDER BY round(abs(weight), 10) DESC, id) AS place FROM w WHERE date = (SELECT max(date) FROM w)""")
def latest_snapshot(spark, d):
    return numbered(N.latest_snapshot(backtest(spark, d).positions), lambda x: rounded(days(x, "date"), "weight"))


@query(BT + """SELECT count(*) FILTER (WHERE weight > 0) AS n_long, count(*) FILTER (WHERE weight <= 0) AS n_short FROM w
  WHERE date = (SELECT max(date) FROM w)""")
def snapshot_counts(spark, d):
    return N.snapshot_counts(N.latest_snapshot(backtest(spark, d).positions))


HISTORY = BT + """, history AS (
  SELECT id, count(*) FILTER (WHERE weight <> 0) AS times_held, avg(weight) FILTER (WHERE weight <> 0) AS avg_weight,
         count(*) FILTER (WHERE weight > 0) AS times_long, count(*) FILTER (WHERE weight < 0) AS times_short,
         min(date) AS first_date, max(date) AS last_date,
         coalesce(max(weight) FILTER (WHERE date = (SELECT max(date) FROM w)), 0) AS current_weight FROM w GROUP BY id),
sides AS (SELECT *, CASE WHEN times_long > times_short THEN 'LONG' WHEN times_short > times_long THEN 'SHORT'
                    ELSE 'MIXED' END AS predominant_side,
                 100.0 * times_held / (SELECT count(DISTINCT date) FROM w) AS frequency_pct FROM history WHERE times_held > 0)
"""
HISTORY_SQL = f"""id, times_held, {Q.r('avg_weight', 'avg_weight')}, times_long, times_short,
  CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date,
  {Q.r('current_weight', 'current_weight')}, predominant_side, {Q.r('frequency_pct', 'frequency_pct')}"""


def history(spark, d):
    return N.asset_history(backtest(spark, d).positions)


def history_rows(df):
    return rounded(days(df, "first_date", "last_date"), "avg_weight", "current_weight", "frequency_pct")


@query(HISTORY + f"""SELECT {HISTORY_SQL}, row_number() OVER (ORDER BY times_held DESC, round(abs(avg_weight), 12) DESC, id) AS place
  FROM sides""")
def asset_history(spark, d):
    return numbered(N.by_consistency(history(spark, d)), history_rows)


@query(HISTORY + f"SELECT {HISTORY_SQL} FROM sides ORDER BY times_held DESC, round(abs(avg_weight), 12) DESC, id LIMIT 1")
def most_consistent_asset(spark, d):
    return history_rows(N.most_consistent(history(spark, d)))


@query(HISTORY + """SELECT count(*) AS n_assets, count(*) FILTER (WHERE current_weight > 0) AS current_longs,
  count(*) FILTER (WHERE current_weight < 0) AS current_shorts FROM sides""")
def asset_history_totals(spark, d):
    return N.history_totals(history(spark, d))


def histogram_sql(source: str, series: dict[str, str]) -> str:
    long = " UNION ALL ".join(f"SELECT '{n}' AS series, CAST({e} AS DOUBLE) AS v FROM {source}" for n, e in series.items())
    return f""", long AS (SELECT * FROM ({long}) WHERE v IS NOT NULL),
ranges AS (SELECT series, min(v) AS lo, max(v) AS hi FROM long GROUP BY 1),
binned AS (SELECT series, lo, (hi - lo) / 15 AS width,
                  CASE WHEN hi <= lo THEN 1 WHEN v >= hi THEN 15 ELSE CAST(floor((v - lo) / (hi - lo) * 15) AS INTEGER) + 1 END AS bin
           FROM long JOIN ranges USING (series))
SELECT series, bin, {Q.r('lo + (bin - 1) * width', 'low')}, {Q.r('lo + bin * width', 'high')}, count(*) AS n
FROM binned GROUP BY series, bin, lo, width"""


@query(BT + histogram_sql("daily", {
    "returns": "returns", "drawdown": "drawdown", "turnover": "CASE WHEN turnover <> 0 THEN turnover END"}))
def daily_histograms(spark, d):
    return rounded(K.daily_histograms(backtest(spark, d).daily), "low", "high")
