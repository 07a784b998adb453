"""Backtests: one configuration or a whole parameter table in a single plan keyed by run.

The panel is never multiplied by the number of runs. Returns, the as-of join and the ranking are computed once for each
rebalance schedule; only the few rows at both ends of a ranking meet the parameter table, inside one task each, and
are summed to one row for each run and date before the next shuffle. Weights, gross returns and turnover are
proportional to leverage, so runs that differ in leverage only share everything up to the equity curve.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig, StrategyParams
from ..functions import chunk_of, order_free_sum, plus_days
from ..operators.panel import (
    TradingWindow, kept_steps, price_returns, step_of_date, to_all_tasks, trading_dates, trading_window, usable, usable_predictions,
)
from ..operators.signals import eligible_signals, rank_ends, step_signals
from ..operators.statistics import performance_stats
from ..operators.weights import rank_sums, with_unit_weights
from ..session import shuffle_width

# Largest parameter table that is sent to every task, in rows and in stored numbers (8 bytes each, so 32 MB); a grid
# beyond either bound is run in slices.
MAX_RUNS_PER_PLAN = 20_000
MAX_NUMBERS_PER_PLAN = 4_000_000


@dataclass(frozen=True)
class ScheduledPanel:
    """Everything the runs share: window, kept steps, calendar, usable returns, and both ends of each step's ranking."""

    window: TradingWindow
    kept: dict[int, list[int]]
    calendar: DataFrame
    returns: DataFrame
    ends: DataFrame
    most_ends: int


def scheduled_panel(prices: DataFrame, predictions: DataFrame, window: TradingWindow, every: list[int], lag_days: int,
                    num_top: int, num_bottom: int, returns: DataFrame | None = None) -> ScheduledPanel:
    """``returns`` takes a stored result of ``price_returns``; a large panel is then not windowed twice."""
    if returns is None:
        # Returns look back only, so later prices need not be read; the bound is a literal and reaches the scan.
        returns = price_returns(prices.where(F.col("date") <= F.lit(window.last).cast("timestamp_ntz")))
    dates = trading_dates(prices, window)
    kept = kept_steps(prices.select("date"), window, every)
    calendar = dates.select("date", F.explode(F.array(*[F.lit(n) for n in every])).alias("rebalance_days"))
    signals = step_signals(usable_predictions(predictions, window, lag_days), window, every, lag_days)
    ends = rank_ends(eligible_signals(signals, returns, window, every), ["rebalance_days", "k"], num_top, num_bottom)
    in_window = returns.where(usable() & window.covers(F.col("date")))
    ends = ends.select("rebalance_days", "k", "date", "id", "rank_top", "rank_bottom", "n_assets")
    return ScheduledPanel(window, kept, calendar, in_window, ends, sum(map(len, kept.values())) * (num_top + num_bottom))


RANKS = ("rank_top", "rank_bottom", "n_assets")
RUN_SCHEMA = (
    "run bigint not null, rebalance_days int not null, num_long int not null, num_short int not null, "
    "rank_power double not null, long_sums array<double>, short_sums array<double>")
Runs = Callable[[DataFrame], DataFrame]


def runs_of(spark: SparkSession, params: list[tuple[int, StrategyParams]]) -> Runs:
    """Gives each row all runs of its rebalance schedule. The table of numbered runs is sent to every task if it is within
    the bounds of this module. Beyond them rows are dealt by a hash to four parts for each partition of a shuffle, so that
    partitions get about as many parts, and the runs are repeated for each part: the rows of one schedule, or of a single run, are
    never one task."""
    sums = {key: rank_sums(*key) for _, p in params for key in ((p.num_long, p.rank_power), (p.num_short, p.rank_power))}
    table = spark.createDataFrame(
        [(run, p.rebalance_days, p.num_long, p.num_short, float(p.rank_power), sums[p.num_long, p.rank_power], sums[p.num_short, p.rank_power])
         for run, p in params], RUN_SCHEMA)
    numbers = sum(p.num_long + p.num_short for _, p in params)
    within = len(params) <= MAX_RUNS_PER_PLAN and numbers <= MAX_NUMBERS_PER_PLAN
    if within:
        return lambda rows: rows.join(F.broadcast(table), "rebalance_days")
    parts = 4 * shuffle_width(spark)
    repeated = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return lambda rows: rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")).join(
        repeated, ["rebalance_days", "_part"]).drop("_part")


def _uses(panel: ScheduledPanel) -> DataFrame:
    """Returns with the steps whose ranking matters on their date: ``(rebalance_days, k, date, id, use, other_k, ret)``.

    ``held``: the date's return is earned with the weights of k. ``entry``: the step's own date, when weights change from those
    of the step before (``other_k``). ``exit``: found on the step's own date, dated by the next kept step (``other_k``), for
    assets that leave. Every ranked asset has a return on the step's own date by definition, so each of its uses is found.
    """
    def use(when: Column, name: str, k: str, date: Column, other: Column, ret: Column) -> Column:
        return F.when(when, F.struct(F.col(f"_s.{k}").alias("k"), date.alias("date"), F.lit(name).alias("use"), other.cast("int").alias("other_k"),
                                     ret.cast("double").alias("ret")))

    none, next_date = F.lit(None), plus_days(panel.window.first, F.col("_s.next_k") * F.col("_s.rebalance_days"))
    uses = F.array_compact(F.array(
        use(F.col("_s.held_k").isNotNull(), "held", "held_k", F.col("date"), none, F.col("ret")),
        use(F.col("_s.k").isNotNull(), "entry", "k", F.col("date"), F.coalesce("_s.held_k", F.lit(-1)), none),
        use(F.col("_s.next_k").isNotNull(), "exit", "k", next_date, F.col("_s.next_k"), none)))
    rows = panel.returns.select("date", "id", "ret", F.explode(step_of_date(F.col("date"), panel.window, panel.kept)).alias("_s"))
    return rows.select("id", "_s.rebalance_days", F.explode(uses).alias("_u")).select("id", "rebalance_days", "_u.*")


def _contributions(panel: ScheduledPanel) -> DataFrame:
    """Rows whose sums by run and date give gross return and turnover, before they meet the runs.

    Each carries an asset's ranks before (``old``) and after (``new``) the date's rebalance and, for a held asset, its
    return. A row for every calendar date is added, so that idle days appear too.

    Returns stay where their window left them: the steps that matter on a date are arithmetic, and the ends, of which there
    are at most as many as steps and positions allow, are looked up by step and asset. Ends beyond the bound of a
    broadcast are joined by a shuffle on both, which then moves the panel once.
    """
    ranks = F.struct(*[F.col(c).cast("double").alias(c) for c in RANKS])
    # At most one row for each step and asset, in the order of steps.
    by_step = Window.partitionBy("rebalance_days", "id").orderBy("k")
    ends = panel.ends.select(
        "rebalance_days", "k", "id", ranks.alias("ranks"),
        F.lag(F.struct("k", ranks.alias("ranks"))).over(by_step).alias("before"),
        F.lead("k").over(by_step).alias("ranked_k"))
    rows = _uses(panel).join(to_all_tasks(ends, panel.most_ends), ["rebalance_days", "k", "id"]).where(
        (F.col("use") != "exit") | F.col("ranked_k").isNull() | (F.col("ranked_k") != F.col("other_k")))
    entry, was_held = F.col("use") == "entry", F.col("before.k") == F.col("other_k")
    joined = rows.select(
        "rebalance_days", "date", "ret",
        F.when(entry, F.when(was_held, F.col("before.ranks"))).otherwise(F.col("ranks")).alias("old"),
        F.when(entry, F.col("ranks")).alias("new"))
    every_day = panel.calendar.select("rebalance_days", "date")
    return every_day.unionByName(joined, allowMissingColumns=True).select(
        "rebalance_days", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"),
        F.coalesce((F.col("ret").isNull()).cast("double"), F.lit(0.0)).alias("changes"),
        *[F.coalesce(f"{age}.{c}", F.lit(0.0)).alias(f"{age}_{c}") for age in ("old", "new") for c in RANKS])


def run_flows(panel: ScheduledPanel, runs: Runs) -> DataFrame:
    """``(run, date, returns, turnover)`` at leverage 1 of every run."""
    spark = panel.calendar.sparkSession
    # A fixed partition count: the rows are few here, but each will meet all runs of its schedule.
    rows = _contributions(panel).repartition(shuffle_width(spark), "rebalance_days", "date")
    # Sums that do not depend on how the rows were spread, so neither do a run's metrics nor its place among other runs.
    return (
        with_unit_weights(runs(rows), ["old", "new"])
        .select("rebalance_days", "date", "run",
                F.when(F.col("old_weight") != 0, F.col("old_weight") * F.col("ret")).otherwise(0.0).alias("_earned"),
                (F.col("changes") * F.abs(F.col("new_weight") - F.col("old_weight"))).alias("_traded"))
        .groupBy("rebalance_days", "date", "run")
        .agg(order_free_sum(F.col("_earned")).alias("returns"), order_free_sum(F.col("_traded")).alias("turnover"))
        .select("run", "date", "returns", "turnover")
    )


# Longest series, in dates, whose curve is one task's window; a longer one is cut into calendar chunks of about half of that.
SERIES_IN_TASK = 1 << 17


def series_chunk(window: TradingWindow) -> int | None:
    """Days in a chunk of a run's series, or None where the series is short enough to be left whole."""
    if not window.stamps or window.stamps <= SERIES_IN_TASK:
        return None
    return max(1, (window.days + 1) * SERIES_IN_TASK // (2 * window.stamps))


def equity_curve(flows: DataFrame, group: list[str], start_capital: float, cost_rate: float, chunk_days: int | None = None) -> DataFrame:
    """Daily rows ``(*group, date, returns, equity, drawdown, turnover)`` from returns and turnover.

    Equity is after the day's trading cost; peak and drawdown look at the equity just before it. One row for each
    run and date reaches these windows, whose key is the run. With ``chunk_days`` a run is cut into calendar chunks first, so
    that a series of many dates is not one task: growth, highest and lowest value are found within each chunk, as multiples
    of its beginning; a window over the chunks' ends carries growth and peak from chunk to chunk.
    """
    cap, key = F.lit(float(start_capital)), [*group, "_chunk"]
    chunk = F.lit(0) if chunk_days is None else chunk_of(F.col("date"), chunk_days)
    by_date = Window.partitionBy(*(group if chunk_days is None else key)).orderBy("date")
    so_far = by_date.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = (1 + F.col("returns")) * (1 - F.col("turnover") * cost_rate)
    rows = (
        flows.select(*group, "date", "returns", "turnover", chunk.alias("_chunk"))
        .withColumn("_grown", F.product(step).over(so_far))
        .withColumn("_pre", F.lag("_grown", 1, 1.0).over(by_date) * (1 + F.col("returns")))
        .withColumns({"_high": F.max("_pre").over(so_far), "_low": F.min("_pre").over(so_far)})
    )
    if chunk_days is None:
        rows = rows.withColumns({"_from": F.lit(1.0), "_peak": F.lit(1.0)})
    else:
        ends = rows.groupBy(*key).agg(F.max_by("_grown", "date").alias("_end"), F.max("_high").alias("_top"), F.min("_low").alias("_bottom"))
        earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_from", F.coalesce(F.product("_end").over(earlier), F.lit(1.0)))
        highest = F.col("_from") * F.when(F.col("_from") >= 0, F.col("_top")).otherwise(F.col("_bottom"))
        ends = ends.withColumn("_peak", F.greatest(F.lit(1.0), F.max(highest).over(earlier)))
        rows = rows.join(ends.select(*key, "_from", "_peak"), key)
    here = F.col("_from") * F.when(F.col("_from") >= 0, F.col("_high")).otherwise(F.col("_low"))
    return (
        rows.withColumns({"equity": cap * F.col("_from") * F.col("_grown"), "_pre": cap * F.col("_from") * F.col("_pre"),
                          "_peak": cap * F.greatest("_peak", here)})
        .withColumn("drawdown", F.when(F.col("_peak") > 0, (F.col("_pre") - F.col("_peak")) / F.col("_peak")).otherwise(0.0))
        .select(*group, "date", "returns", "equity", "drawdown", "turnover")
    )


def leveraged_daily(flows: DataFrame, variants: DataFrame, config: BacktestConfig, chunk_days: int | None = None) -> DataFrame:
    """Daily rows of every ``run_id`` from the flows of its base run.

    ``variants``: ``(run, variants array<struct<run_id, leverage>>)`` of checked size. Flows are placed by base run
    before they are multiplied, and the windows of the variants stay in the same partition.
    """
    spread = (
        flows.repartition(shuffle_width(flows.sparkSession), "run")
        .join(F.broadcast(variants), "run")
        .select("run", F.explode("variants").alias("_v"), "date", "returns", "turnover")
        .select("run", "_v.run_id", "date", (F.col("returns") * F.col("_v.leverage")).alias("returns"),
                (F.col("turnover") * F.col("_v.leverage")).alias("turnover"))
    )
    return equity_curve(spread, ["run", "run_id"], config.start_capital, config.cost_rate, chunk_days)


def run_positions(panel: ScheduledPanel, runs: Runs) -> DataFrame:
    """``(run, date, id, weight)`` at leverage 1 of every rebalance."""
    ends = panel.ends.select("rebalance_days", "date", "id", *[F.col(c).cast("double").alias(f"new_{c}") for c in RANKS])
    return with_unit_weights(runs(ends), ["new"]).select(
        "run", "date", "id", F.col("new_weight").alias("weight")).where(F.col("weight") != 0)


class BacktestResult:
    """Lazy results of one configuration: ``daily``, ``positions`` and ``stats``."""

    def __init__(self, panel: ScheduledPanel, config: BacktestConfig):
        self.panel, self.config, self.window = panel, config, panel.window
        self._leverage = max(config.params.leverage, 0.0)
        self._run = runs_of(panel.calendar.sparkSession, [(0, config.params)])

    @cached_property
    def daily(self) -> DataFrame:
        flows = run_flows(self.panel, self._run).select(
            "run", "date", (F.col("returns") * self._leverage).alias("returns"), (F.col("turnover") * self._leverage).alias("turnover"))
        return equity_curve(flows, ["run"], self.config.start_capital, self.config.cost_rate, series_chunk(self.window)).drop("run")

    @cached_property
    def positions(self) -> DataFrame:
        return run_positions(self.panel, self._run).select(
            "date", "id", (F.col("weight") * self._leverage).alias("weight")).where(F.col("weight") != 0)

    @cached_property
    def stats(self) -> DataFrame:
        return performance_stats(self.daily, self.config.start_capital)


class NoTradingDates(ValueError):
    """Neither prices nor predictions allow a single trading date."""


def run_backtest(prices: DataFrame, predictions: DataFrame, config: BacktestConfig | None = None,
                 returns: DataFrame | None = None) -> BacktestResult:
    """One configuration: lazy daily series, positions and statistics.

    Raises :class:`NoTradingDates` when the panels do not overlap; finding that out, and which steps have prices, are the
    only jobs started here.
    ``returns`` takes a stored result of ``price_returns``.
    """
    config = config or BacktestConfig()
    p = config.params
    window = trading_window(prices, predictions, config.prediction_lag_days, config.start_date, config.end_date)
    if window is None:
        raise NoTradingDates("No valid trading dates given returns and prediction coverage")
    panel = scheduled_panel(prices, predictions, window, [p.rebalance_days], config.prediction_lag_days,
                            p.num_long, p.num_short, returns)
    return BacktestResult(panel, config)
