"""Parameter sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.config import DEFAULT_GRID, BacktestConfig
from quantloom.operators.panel import rebalance_calendar, trading_dates, trading_window
from quantloom.plans import sweep as G
from quantloom.session import work_path
from quantloom.sources import load_table, write_csv

from . import sql as Q
from . import tables as T
from .backtest_queries import STAT_SQL, histogram_sql, stat_rows
from .registry import numbered, query, rounded

CONFIG = BacktestConfig()
LISTS = {"num_longs": [3, 5, 9], "num_shorts": [2, 6], "leverages": [1.0, 3.0], "rebalance_days": [8, 10], "rank_powers": [0.0, 1.5]}
METRICS = ["sharpe", "cagr", "calmar", "sortino", "max_dd", "volatility", "win_rate"]


def grid_sql(lists: dict) -> str:
    def values(name, column):
        return "(VALUES " + ", ".join(f"({v})" for v in lists[name]) + f") AS {column}({column})"

    return ("SELECT row_number() OVER () AS run, nl, ns, CAST(lev AS DOUBLE) AS lev, days, CAST(power AS DOUBLE) AS power FROM "
            + ", ".join([values("num_longs", "nl"), values("num_shorts", "ns"), values("leverages", "lev"),
                         values("rebalance_days", "days"), values("rank_powers", "power")]))


PARAMS_SQL = "nl AS num_long, ns AS num_short, lev AS leverage, p.days AS rebalance_days, power AS rank_power"
RESULTS = """, results AS (SELECT """ + PARAMS_SQL + """, sharpe_ratio AS sharpe, cagr, calmar_ratio AS calmar,
  sortino_ratio AS sortino, max_drawdown AS max_dd, annual_volatility AS volatility, win_rate, final_equity
  FROM params p JOIN stats USING (run))
"""
SWEEP = Q.backtest(grid_sql(LISTS)) + RESULTS
ROWS_SQL = ("num_long, num_short, leverage, rebalance_days, rank_power, " + ", ".join(Q.r(m, m) for m in METRICS) + ", "
            + Q.r("final_equity", "final_equity", 2))
BEST_SQL = SWEEP + """, best AS (SELECT * FROM results
  ORDER BY round(sharpe, 10) DESC, num_long, num_short, leverage, rebalance_days, rank_power LIMIT 1)
"""


def grid(lists=LISTS):
    return G.parameter_grid(CONFIG.params, **lists)


def results(spark, d, lists=LISTS):
    return G.run_sweep(T.prices(spark, d), T.predictions(spark, d), grid(lists), CONFIG)


def result_rows(df):
    return rounded(rounded(df, *METRICS), "final_equity", places=2)


@query(Q.with_(f"params AS ({grid_sql(DEFAULT_GRID)})", Q.PRICES, Q.PREDS, Q.VALID) + f""", steps AS (
  SELECT s.days, count(*) AS rebalances FROM (SELECT DISTINCT days FROM params) s, valid, bounds
  WHERE date_diff('day', first, date) % s.days = 0 GROUP BY 1)
SELECT {PARAMS_SQL}, rebalances FROM params p JOIN steps USING (days)""")
def parameter_grid(spark, d):
    """The default grid, each combination with the number of rebalances it will make."""
    prices = T.prices(spark, d)
    window = trading_window(prices, T.predictions(spark, d))
    steps = rebalance_calendar(trading_dates(prices, window), window, DEFAULT_GRID["rebalance_days"])
    made = steps.where(F.col("k").isNotNull()).groupBy("rebalance_days").agg(F.count(F.lit(1)).alias("rebalances"))
    return G.grid_table(spark, grid(DEFAULT_GRID)).drop("run_id").join(made, "rebalance_days").select(
        *G.PARAM_COLUMNS, "rebalances")


@query(SWEEP + f"SELECT {ROWS_SQL} FROM results")
def sweep_results(spark, d):
    return result_rows(results(spark, d))


@query(Q.backtest(grid_sql(DEFAULT_GRID)) + RESULTS + f"SELECT {ROWS_SQL} FROM results")
def sweep_default_grid(spark, d):
    return result_rows(results(spark, d, DEFAULT_GRID))


@query(SWEEP + f"SELECT {ROWS_SQL} FROM results")
def sweep_resumed(spark, d):
    """Half of the grid first, then all of it from the same result table."""
    store = G.SweepStore(spark, work_path(spark, "sweep"), G.SweepSource("prices", "predictions"), CONFIG)
    prices, predictions = T.prices(spark, d), T.predictions(spark, d)
    store.run(prices, predictions, [p for p in grid() if p.rank_power == 0.0])
    return result_rows(store.run(prices, predictions, grid()))


@query(SWEEP + f"SELECT {ROWS_SQL} FROM results")
def sweep_in_slices(spark, d):
    return result_rows(G.run_sweep(T.prices(spark, d), T.predictions(spark, d), grid(), CONFIG, max_runs=30))


@query(SWEEP + f"SELECT {ROWS_SQL} FROM results WHERE max_dd >= -0.93")
def sweep_drawdown_limit(spark, d):
    return result_rows(G.within_drawdown(results(spark, d), 0.93))


@query(SWEEP + f"""SELECT {ROWS_SQL}, row_number() OVER (ORDER BY round(calmar, 10) DESC, num_long, num_short, leverage,
  rebalance_days, rank_power) AS place FROM results QUALIFY place <= 20""")
def sweep_top(spark, d):
    return result_rows(G.top_results(results(spark, d), "calmar", 20)).withColumn("place", F.col("place").cast("bigint"))


@query(SWEEP + f"""SELECT {ROWS_SQL}, row_number() OVER (ORDER BY round(cagr, 10) DESC, num_long, num_short, leverage, rebalance_days,
  rank_power) AS place FROM results""")
def sweep_ranked(spark, d):
    return numbered(G.rank_results(results(spark, d), "cagr"), result_rows)


@query(SWEEP + "SELECT CAST(0 AS BIGINT) AS left_over, count(*) AS stored FROM results")
def sweep_cleared(spark, d):
    """Rows of the result table after a sweep, and after it was cleared."""
    store = G.SweepStore(spark, work_path(spark, "cleared"), G.SweepSource("prices", "predictions"), CONFIG)
    store.run(T.prices(spark, d), T.predictions(spark, d), grid())
    stored = store.stored().count()
    store.clear()
    return store.stored().agg(F.count(F.lit(1)).alias("left_over")).withColumn("stored", F.lit(stored).cast("bigint"))


@query(SWEEP + f"SELECT {ROWS_SQL} FROM results")
def sweep_csv_round_trip(spark, d):
    path = work_path(spark, "results") + ".csv"
    found = results(spark, d)
    write_csv(found, path)
    return result_rows(load_table(path, spark, found.schema))


@query(SWEEP + """SELECT count(*) AS tested, count(*) FILTER (WHERE sharpe > 0) AS positive_sharpe,
  round(100.0 * count(*) FILTER (WHERE sharpe > 0) / count(*), 6) AS positive_pct FROM results""")
def sweep_summary(spark, d):
    return rounded(G.sweep_summary(results(spark, d)), "positive_pct")


@query(BEST_SQL + """SELECT num_long, num_short, leverage AS target_leverage, rebalance_days AS rebalance_every_n_days, rank_power
  FROM best""")
def sweep_best(spark, d):
    return G.best_params(results(spark, d))


@query(BEST_SQL + f"""SELECT {STAT_SQL} FROM stats WHERE run = (SELECT run FROM params p, best b WHERE nl = num_long AND ns = num_short
  AND lev = leverage AND p.days = rebalance_days AND power = rank_power)""")
def sweep_best_applied(spark, d):
    best = G.apply_best(T.prices(spark, d), T.predictions(spark, d), results(spark, d), CONFIG)
    return stat_rows(best.stats)


@query(SWEEP + f""", cells AS (SELECT leverage, num_long, num_short, avg(sharpe) AS mean FROM results GROUP BY 1, 2, 3)
SELECT leverage, num_long, {Q.r('max(mean) FILTER (WHERE num_short = 2)', '"2"')},
       {Q.r('max(mean) FILTER (WHERE num_short = 6)', '"6"')} FROM cells GROUP BY 1, 2""")
def sweep_heatmap(spark, d):
    return rounded(G.heatmap(results(spark, d), LISTS["num_shorts"]), "2", "6")


@query(SWEEP + f"""SELECT leverage, count(*) AS n, {Q.r('max(sharpe)', 'best')}, {Q.r('min(sharpe)', 'worst')}
  FROM results GROUP BY 1 HAVING count(*) >= 4""")
def sweep_heatmap_extremes(spark, d):
    return rounded(G.heatmap_extremes(results(spark, d)), "best", "worst")


@query(SWEEP + f""", cells AS (SELECT leverage, num_long, num_short, avg(sharpe) AS mean FROM results GROUP BY 1, 2, 3)
SELECT leverage, num_long, num_short, {Q.r('mean', 'best_mean')} FROM cells
QUALIFY row_number() OVER (PARTITION BY leverage ORDER BY mean DESC) = 1""")
def sweep_best_cells(spark, d):
    return rounded(G.heatmap_best_cells(results(spark, d)), "best_mean")


@query(SWEEP + histogram_sql("results", {m: m for m in ("sharpe", "cagr", "calmar", "max_dd", "volatility")}))
def sweep_histograms(spark, d):
    found = G.run_sweep(T.prices(spark, d), T.predictions(spark, d), grid(), CONFIG)
    return rounded(G.metric_histograms(found), "low", "high")
