"""Shape of the plans: what reaches the scan, how joins are made, how windows are split."""

import math
import re

from pyspark.sql import functions as F

from quantloom.config import BacktestConfig, StrategyParams
from quantloom.functions import order_free_sum, with_place
from quantloom.operators.panel import price_returns
from quantloom.plans import backtest, parameter_grid, run_backtest, run_sweep
from quantloom.sources import stored_prices, stored_returns, write_price_table
from checks import tables as T

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_join_without_keys_and_no_python(spark):
    prices, predictions = T.prices(spark, SF), T.predictions(spark, SF)
    config = BacktestConfig(StrategyParams(3, 3, 1.0, 10, 1.0))
    grid = parameter_grid(config.params, [2, 3], [1, 2], [1.0, 2.0], [8, 10], [0.0, 1.0])
    result = run_backtest(prices, predictions, config)
    for df in (result.stats, result.positions, run_sweep(prices, predictions, grid, config)):
        plan = plan_of(df)
        assert not re.search("NestedLoop|Cartesian|EvalPython|Python", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(date", plan_of(result.stats))
    # Repeated keys are seen by the window that computes the returns, which needs the rows and the ends of their chunks only.
    assert plan_of(price_returns(prices)).count("FileScan parquet") == 2


def test_scan_reads_only_what_is_needed(spark):
    plan = plan_of(price_returns(T.prices(spark, SF)))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"date:date,id:string,close:double"}


def test_history_is_split_into_chunks(spark):
    frame = price_returns(T.prices(spark, SF), chunk_days=100)
    over = [re.sub(r"#\d+", "", w) for w in re.findall(r"Window \[lag.*?\], \[(.*?)\], \[", plan_of(frame))]
    assert over == ["id, _chunk"]


def test_sweep_sums_runs_before_the_shuffle(spark):
    """After the rows have met the runs there is one exchange, by run, and nothing else."""
    grid = parameter_grid(StrategyParams(), [2, 3], [1, 2], [1.0, 2.0], [8, 10], [0.0, 1.0])
    plan = plan_of(run_sweep(T.prices(spark, SF), T.predictions(spark, SF), grid, BacktestConfig()))
    above = plan[:plan.index("Union")]
    shuffles = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\), REPARTITION", above)]
    assert shuffles == ["run", "rebalance_days, date"]


def test_panel_moves_once(spark):
    """Exchanges of one backtest as it is run: three for the returns, and none of the panel after those."""
    result = run_backtest(T.prices(spark, SF), T.predictions(spark, SF), BacktestConfig(StrategyParams(3, 3, 1.0, 10, 1.0)))
    stats = result.stats
    stats.collect()
    final = plan_of(stats).split("== Initial Plan")[0]
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", final)]
    assert len(keys) < 13 and "lookup_date, id" not in keys
    assert keys.count("id, _chunk") == 3 and final.count("ReusedExchange") == 1  # the returns' last one is read twice
    assert "SinglePartition" not in plan_of(result.daily)  # every window has a key


def test_rows_are_numbered_by_ranges(spark):
    rows = spark.range(10_000).selectExpr("id", "pmod(xxhash64(id), 1000) AS x")
    placed = with_place(rows, [F.col("x").desc(), F.col("id")], parts=7)
    assert "Window" not in plan_of(placed)
    want = sorted(((r["x"], r["id"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r["x"], r["id"]) for r in placed.orderBy("place").collect()] == want
    assert [r["place"] for r in placed.orderBy("place").collect()] == list(range(1, 10_001))
    assert [r["id"] for r in with_place(rows.orderBy("id")).orderBy("place").collect()] == list(range(10_000))
    assert with_place(rows.where("id < 0"), [F.col("id")]).collect() == []


def test_bucketed_panel_is_read_without_exchange(spark, tmp_path):
    prices = T.prices(spark, SF)
    write_price_table(prices, "bucketed_prices", str(tmp_path / "prices"), buckets=6, chunk_days=50)
    returns = stored_returns(spark, "bucketed_prices")
    assert "Exchange" not in plan_of(returns) and plan_of(returns).count("FileScan") == 1
    want = sorted(map(tuple, price_returns(prices).collect()), key=str)
    assert sorted(map(tuple, returns.collect()), key=str) == want
    assert sorted(map(tuple, stored_prices(spark, "bucketed_prices").collect())) == sorted(map(tuple, prices.select("date", "id", "close").collect()))
    config = BacktestConfig(StrategyParams(3, 3, 1.0, 10, 1.0))
    runs = [run_backtest(prices, T.predictions(spark, SF), config, given).stats.first() for given in (None, returns)]
    assert runs[0] == runs[1]
    spark.sql("DROP TABLE bucketed_prices")


def with_settings(spark, settings, do):
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        return do()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_metrics_do_not_depend_on_the_partitions(spark):
    """Every bit of every metric, so that ranks of nearly equal runs are the same each time."""
    grid = parameter_grid(StrategyParams(), [2, 5], [1, 4], [1.0, 1.5], [8], [0.0, 0.7])

    def metrics(parts, shuffled):
        prices, predictions = (df.repartition(parts, F.rand(shuffled)) for df in (T.prices(spark, SF), T.predictions(spark, SF)))
        return sorted(map(tuple, with_settings(
            spark, {"spark.sql.shuffle.partitions": str(parts)}, lambda: run_sweep(prices, predictions, grid, BacktestConfig()).collect())))

    first = metrics(2, 1)
    assert len(first) == len(grid) and first == metrics(7, 2)


def test_order_free_sum(spark):
    values = [0.1, -0.3, 1e-9, 2.0 ** 24 + 0.7, -(2.0 ** 24), 1 / 3, -1e-30, None] * 500
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    sums = {rows.repartition(n, F.rand(n)).agg(order_free_sum(F.col("v"))).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1 and abs(sums.pop() - math.fsum(v for v in values if v is not None)) < 1e-6
    kinds = {"nan": [float("nan"), 1.0], "inf": [float("inf"), 1.0], "both": [float("inf"), float("-inf")], "large": [1e300, 1.0], "none": [None]}
    flat = spark.createDataFrame([(k, v) for k, vs in kinds.items() for v in vs], "k string, v double")
    got = dict(map(tuple, flat.groupBy("k").agg(order_free_sum(F.col("v"))).collect()))
    assert math.isnan(got["nan"]) and math.isnan(got["both"]) and got["inf"] == float("inf") and got["large"] == 1e300 and got["none"] == 0.0


def test_wide_runs_meet_rows_in_parts(spark, monkeypatch):
    """With a table of runs beyond the bounds of a broadcast the rows of one schedule are spread over many tasks."""
    prices, predictions = T.prices(spark, SF), T.predictions(spark, SF)
    config = BacktestConfig(StrategyParams(5, 4, 1.0, 10, 1.0))
    want = run_backtest(prices, predictions, config).stats.first()
    monkeypatch.setattr(backtest, "MAX_RUNS_PER_PLAN", 0)
    monkeypatch.setattr(backtest, "MAX_NUMBERS_PER_PLAN", 0)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}

    def spread():
        rows = spark.range(4_000).selectExpr("10 AS rebalance_days", "id")
        met = backtest.runs_of(spark, [(0, config.params)])(rows)
        assert "BroadcastHashJoin" not in plan_of(met)
        counts = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        return counts, run_backtest(prices, predictions, config).stats.first()

    counts, got = with_settings(spark, settings, spread)
    assert sum(counts) == 4_000 and max(counts) <= 3_000 and got == want
