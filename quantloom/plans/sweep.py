"""Parameter sweeps: the whole grid is one plan, or a few plans when the grid exceeds the broadcast bound."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig, StrategyParams
from ..operators.panel import trading_window
from ..operators.statistics import histograms, performance_stats
from ..session import child_names, make_marker, remove_path
from .backtest import (
    MAX_NUMBERS_PER_PLAN, MAX_RUNS_PER_PLAN, BacktestResult, leveraged_daily, run_backtest, run_flows, runs_of, scheduled_panel,
    series_chunk,
)

# The columns of a sweep's result.
PARAM_COLUMNS = ["num_long", "num_short", "leverage", "rebalance_days", "rank_power"]
METRIC_COLUMNS = ["sharpe", "cagr", "calmar", "sortino", "max_dd", "volatility", "win_rate", "final_equity"]
# Metric name in a sweep's result -> name among the performance statistics.
_STAT_OF = {
    "sharpe": "sharpe_ratio", "cagr": "cagr", "calmar": "calmar_ratio", "sortino": "sortino_ratio",
    "max_dd": "max_drawdown", "volatility": "annual_volatility", "win_rate": "win_rate", "final_equity": "final_equity",
}
_PARAM_SCHEMA = "run_id bigint, num_long int, num_short int, leverage double, rebalance_days int, rank_power double"
RESULT_SCHEMA = "run_key string, num_long int, num_short int, leverage double, rebalance_days int, rank_power double, " \
    + ", ".join(f"{m} double" for m in METRIC_COLUMNS)


def parameter_grid(base: StrategyParams, num_longs: Sequence[int] | None = None, num_shorts: Sequence[int] | None = None,
                   leverages: Sequence[float] | None = None, rebalance_days: Sequence[int] | None = None,
                   rank_powers: Sequence[float] | None = None) -> list[StrategyParams]:
    """All combinations; a list that is not given takes the base value, an empty one leaves none. Repeats are dropped."""
    return list(dict.fromkeys(
        StrategyParams(nl, ns, float(lev), days, float(power))
        for nl, ns, lev, days, power in product(
            *(given if given is not None else [own] for given, own in (
                (num_longs, base.num_long), (num_shorts, base.num_short), (leverages, base.leverage),
                (rebalance_days, base.rebalance_days), (rank_powers, base.rank_power))))))


def grid_table(spark: SparkSession, grid: Sequence[StrategyParams]) -> DataFrame:
    """The grid as a table with a ``run_id``."""
    rows = [(i, p.num_long, p.num_short, p.leverage, p.rebalance_days, p.rank_power) for i, p in enumerate(grid)]
    return spark.createDataFrame(rows, _PARAM_SCHEMA)


def _slices(grid: Sequence[StrategyParams], max_runs: int) -> Iterator[Sequence[StrategyParams]]:
    """Consecutive parts of the grid whose parameter tables are small enough to broadcast.

    A run's row holds one number for each position it may take, so the bound counts rows and numbers.
    """
    start, numbers = 0, 0
    for i, p in enumerate(grid):
        numbers += p.num_long + p.num_short
        if i > start and (i - start >= max_runs or numbers > MAX_NUMBERS_PER_PLAN):
            yield grid[start:i]
            start, numbers = i, p.num_long + p.num_short
    yield grid[start:]


def sweep_daily(prices: DataFrame, predictions: DataFrame, grid: Sequence[StrategyParams], config: BacktestConfig,
                max_runs: int = MAX_RUNS_PER_PLAN, returns: DataFrame | None = None) -> DataFrame | None:
    """``(num_long ... rank_power, date, returns, equity, drawdown, turnover)`` of every combination, or None.

    Grids beyond the broadcast bound are cut into slices whose plans are united, so the broadcast parameter table keeps
    its bound and every combination is still run.
    """
    window = trading_window(prices, predictions, config.prediction_lag_days, config.start_date, config.end_date)
    if window is None or not grid:
        return None
    panel = scheduled_panel(
        prices, predictions, window, sorted({p.rebalance_days for p in grid}), config.prediction_lag_days,
        max(p.num_long for p in grid), max(p.num_short for p in grid), returns)
    spark = prices.sparkSession
    return reduce(DataFrame.unionByName, [_slice_daily(spark, panel, part, config) for part in _slices(grid, max_runs)])


def _slice_daily(spark: SparkSession, panel, grid: Sequence[StrategyParams], config: BacktestConfig) -> DataFrame:
    base_of = {p: replace(p, leverage=1.0) for p in grid}
    run_of = {b: i for i, b in enumerate(dict.fromkeys(base_of.values()))}
    variants = spark.createDataFrame(
        [(run_of[base_of[p]], i, max(p.leverage, 0.0)) for i, p in enumerate(grid)],
        "run bigint, run_id bigint, leverage double",
    ).groupBy("run").agg(F.collect_list(F.struct("run_id", "leverage")).alias("variants"))
    daily = leveraged_daily(run_flows(panel, runs_of(spark, [(i, b) for b, i in run_of.items()])), variants, config, series_chunk(panel.window))
    return daily.join(F.broadcast(grid_table(spark, grid)), "run_id").select(
        "run", *PARAM_COLUMNS, "date", "returns", "equity", "drawdown", "turnover")


def run_sweep(prices: DataFrame, predictions: DataFrame, grid: Sequence[StrategyParams], config: BacktestConfig,
              max_runs: int = MAX_RUNS_PER_PLAN, returns: DataFrame | None = None) -> DataFrame:
    """One row for each combination: its parameters and eight metrics. NaN metrics become 0, infinities stay.

    ``returns`` takes a stored result of ``price_returns``.

    Combinations without any trading date yield no row.
    """
    daily = sweep_daily(prices, predictions, grid, config, max_runs, returns)
    if daily is None:
        return prices.sparkSession.createDataFrame([], RESULT_SCHEMA).drop("run_key")
    # `run` comes first so that the rows are summed where the equity curve left them.
    stats = performance_stats(daily, config.start_capital, ["run", *PARAM_COLUMNS])
    return stats.select(*PARAM_COLUMNS, *[
        F.nanvl(F.col(_STAT_OF[m]).cast("double"), F.lit(0.0)).alias(m) for m in METRIC_COLUMNS])


@dataclass(frozen=True)
class SweepSource:
    """Names that identify the inputs of a sweep in its result table."""

    prices: str
    predictions: str
    price_columns: tuple[str, str, str] = ("date", "id", "close")
    prediction_columns: tuple[str, str, str] = ("release_date", "id", "pred_10d")
    provider: str | None = None


def with_run_key(params: DataFrame, source: SweepSource, config: BacktestConfig) -> DataFrame:
    """Adds ``run_key``: a hash of the parameters and of everything else that the metrics depend on."""
    fixed = {f.name: getattr(source, f.name) for f in fields(source)} | {
        f.name: getattr(config, f.name) for f in fields(config) if f.name != "params"}
    context = [F.lit(str(fixed[name])).alias(name) for name in sorted(fixed)]
    return params.withColumn("run_key", F.md5(F.to_json(F.struct(*[F.col(c) for c in PARAM_COLUMNS], *context))))


class SweepStore:
    """Results of earlier sweeps in a folder of Parquet tables; a sweep computes only what is not there yet.

    Each sweep writes a table of its own below ``runs`` and commits it by a marker below ``done``. Only committed tables are
    read, so a writer that died leaves nothing visible, and of runs that sweeps at the same time both computed one row is
    read, from the table whose name comes first. Which parameters are missing is a matter of the moment: overlapping sweeps may
    do the same work, but never spoil the result.
    """

    def __init__(self, spark: SparkSession, path: str, source: SweepSource, config: BacktestConfig):
        self.spark, self.path, self.source, self.config = spark, path.rstrip("/"), source, config

    def committed(self) -> list[str]:
        """Names of the tables that count."""
        return sorted(child_names(self.spark, f"{self.path}/done"))

    def stored(self) -> DataFrame:
        """One row for each run that some committed sweep has computed."""
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], RESULT_SCHEMA)
        rows = self.spark.read.schema(f"{RESULT_SCHEMA}, sweep string").option("basePath", f"{self.path}/runs").parquet(
            *[f"{self.path}/runs/sweep={name}" for name in names])
        columns = [c for c in rows.columns if c not in ("sweep", "run_key")]
        first = F.min_by(F.struct(*columns), "sweep").alias("_first")
        return rows.groupBy("run_key").agg(first).select("run_key", "_first.*")

    def keyed(self, grid: Sequence[StrategyParams]) -> DataFrame:
        return with_run_key(grid_table(self.spark, grid), self.source, self.config)

    def missing(self, grid: Sequence[StrategyParams]) -> list[StrategyParams]:
        """Combinations not in the table. Only parameters of the given grid come back."""
        todo = self.keyed(grid).join(self.stored().select("run_key"), "run_key", "left_anti")
        return [grid[r["run_id"]] for r in todo.select("run_id").orderBy("run_id").collect()]

    def write(self, results: DataFrame) -> str:
        """Write a sweep's results, not yet visible, and return the name by which :meth:`commit` makes them so."""
        name = uuid.uuid4().hex
        keyed = with_run_key(results, self.source, self.config).select(*[c.split()[0] for c in RESULT_SCHEMA.split(", ")])
        keyed.write.parquet(f"{self.path}/runs/sweep={name}")
        return name

    def commit(self, name: str) -> None:
        make_marker(self.spark, f"{self.path}/done/{name}")

    def run(self, prices: DataFrame, predictions: DataFrame, grid: Sequence[StrategyParams], returns: DataFrame | None = None) -> DataFrame:
        """Results of the whole grid; new ones are stored first. ``returns`` takes a stored result of ``price_returns``."""
        todo = self.missing(grid)
        if todo:
            self.commit(self.write(run_sweep(prices, predictions, todo, self.config, returns=returns)))
        return self.stored().join(self.keyed(grid).select("run_key"), "run_key", "left_semi").drop("run_key")

    def clear(self) -> None:
        """Forget all results. Markers go first, so nothing half removed is ever read."""
        for part in ("done", "runs"):
            remove_path(self.spark, f"{self.path}/{part}", self.path)


def within_drawdown(results: DataFrame, limit: float | None) -> DataFrame:
    """Results whose largest drawdown stays within the limit."""
    return results if limit is None else results.where(F.col("max_dd") >= -limit)


def rank_order(metric: str) -> list[Column]:
    """Best metric first; equal ones by their parameters.

    Metrics count as equal if they agree in eleven digits: runs that differ in leverage only have the same Sharpe ratio, but
    not the same last bits, and sums may differ in those from one execution to the next.
    """
    return [F.format_string("%.10e", metric).cast("double").desc(), *[F.col(c) for c in PARAM_COLUMNS]]


def rank_results(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Results in :func:`rank_order`."""
    return results.orderBy(*rank_order(metric))


def best_params(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    """The parameters of the first row of :func:`rank_results`, under their configuration names."""
    return rank_results(results, metric).limit(1).select(
        "num_long", "num_short", F.col("leverage").alias("target_leverage"),
        F.col("rebalance_days").alias("rebalance_every_n_days"), "rank_power")


def top_results(results: DataFrame, metric: str = "sharpe", top_n: int = 20) -> DataFrame:
    """The best ``top_n`` rows with their place, from 1."""
    first = rank_results(results, metric).limit(top_n)
    order = Window.partitionBy().orderBy(*rank_order(metric))  # over top_n rows only
    return first.withColumn("place", F.row_number().over(order))


def sweep_summary(results: DataFrame) -> DataFrame:
    """One row: combinations tested, how many have a positive Sharpe ratio, and their share in percent."""
    return results.agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("sharpe") > 0).alias("positive_sharpe")).select(
        "tested", "positive_sharpe", (100.0 * F.try_divide("positive_sharpe", "tested")).alias("positive_pct"))


def heatmap_cells(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    """``(leverage, num_long, num_short, mean)`` of every leverage with at least four results."""
    cells = results.groupBy("leverage", "num_long", "num_short").agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("_n"))
    # The window sees one row for each cell of the grid.
    found = F.sum("_n").over(Window.partitionBy("leverage"))
    return cells.withColumn("_found", found).where("_found >= 4").drop("_n", "_found")


def heatmap(results: DataFrame, num_shorts: Sequence[int], metric: str = "sharpe") -> DataFrame:
    """One row for each leverage and num_long, one column for each num_short of the given list."""
    return (
        heatmap_cells(results, metric).groupBy("leverage", "num_long").pivot("num_short", sorted(num_shorts))
        .agg(F.first("mean")).orderBy("leverage", "num_long")
    )


def heatmap_extremes(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Best and worst single result of each leverage with at least four results."""
    return (
        results.groupBy("leverage")
        .agg(F.count(F.lit(1)).alias("n"), F.max(metric).alias("best"), F.min(metric).alias("worst")).where("n >= 4")
    )


def heatmap_best_cells(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Cell with the highest mean of each leverage; of equal ones the smallest num_long, then num_short."""
    cell = F.struct(F.format_string("%.10e", "mean").cast("double").alias("key"), (-F.col("num_long")).alias("l"), (-F.col("num_short")).alias("s"), F.col("mean"))
    return (
        heatmap_cells(results, metric).groupBy("leverage").agg(F.max(cell).alias("_c"))
        .select("leverage", (-F.col("_c.l")).alias("num_long"), (-F.col("_c.s")).alias("num_short"),
                F.col("_c.mean").alias("best_mean"))
    )


def metric_histograms(results: DataFrame, bins: int = 15) -> DataFrame:
    """Distributions of five metrics over all combinations."""
    return histograms(results, {m: F.col(m) for m in ("sharpe", "cagr", "calmar", "max_dd", "volatility")}, bins)


def apply_best(prices: DataFrame, predictions: DataFrame, results: DataFrame, config: BacktestConfig,
               metric: str = "sharpe", returns: DataFrame | None = None) -> BacktestResult | None:
    """A full backtest with the best parameters, or None when there are no results. Brings one row to the driver."""
    row = best_params(results, metric).first()
    if row is None:
        return None
    return run_backtest(prices, predictions, config.with_params(
        num_long=row["num_long"], num_short=row["num_short"], leverage=row["target_leverage"],
        rebalance_days=row["rebalance_every_n_days"], rank_power=row["rank_power"]), returns)
