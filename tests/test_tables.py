from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quantloom.operators.signals import latest_predictions, rank_ends, select_live, shortage
from quantloom.operators.statistics import histograms, performance_stats
from quantloom.operators.weights import target_notionals, weights_from_ranks
from quantloom.sources import columns_for, load_predictions, load_table, write_csv, write_parquet


def weights(spark, scores, longs, shorts, gross, power):
    selection = spark.createDataFrame([(i, "LONG") for i in longs] + [(i, "SHORT") for i in shorts], "id string, side string")
    preds = spark.createDataFrame(list(scores.items()), "id string, pred double")
    return {r["id"]: r["weight"] for r in weights_from_ranks(selection, preds, [], gross, power).collect()}


def test_equal_weights(spark):
    got = weights(spark, {"AAA": 0.9, "BBB": 0.7, "CCC": -0.2}, ["AAA", "BBB"], ["CCC"], 1.2, 0.0)
    assert got == pytest.approx({"AAA": 0.4, "BBB": 0.4, "CCC": -0.4}, rel=1e-5)


def test_power_favours_the_best(spark):
    got = weights(spark, {"AAA": 0.9, "BBB": 0.6, "CCC": -0.4}, ["AAA", "BBB"], ["CCC"], 1.0, 2.0)
    assert got["AAA"] > got["BBB"] > 0 > got["CCC"]
    assert sum(map(abs, got.values())) == pytest.approx(1.0)
    assert got["AAA"] / got["BBB"] == pytest.approx(4.0)


def test_asset_without_score_is_dropped(spark):
    assert weights(spark, {"AAA": 0.5}, ["AAA", "BBB"], [], 1.0, 0.0) == {"AAA": pytest.approx(1.0)}
    assert weights(spark, {"AAA": 0.5}, ["AAA"], [], 0.0, 0.0) == {}


def test_overlap_keeps_the_short(spark):
    latest = spark.createDataFrame([("A", 3.0), ("B", 2.0), ("C", 1.0)], "id string, pred double")
    chosen = select_live(latest, 2, 2)
    assert sorted((r["id"], r["side"]) for r in chosen.collect()) == [("A", "LONG"), ("B", "LONG"), ("B", "SHORT"), ("C", "SHORT")]
    got = {r["id"]: r["weight"] for r in weights_from_ranks(chosen, latest, [], 1.0, 0.0).collect()}
    assert got["A"] > 0 > got["B"] and got["C"] < 0
    assert shortage(latest, 2, 2).first()["short_of_assets"]
    assert select_live(latest, 2, 0).where("side = 'SHORT'").count() == 0


def test_rank_ends_of_a_large_group(spark):
    n = 5000
    rows = spark.range(n).select(F.lit(1).alias("g"), F.format_string("%06d", "id").alias("id"), (F.col("id") % 97).cast("double").alias("pred"))
    got = rank_ends(rows, ["g"], 30, 40).collect()
    order = [i for _, i in sorted((-(k % 97), f"{k:06d}") for k in range(n))]
    assert len(got) == 70 and {r["n_assets"] for r in got} == {n}
    assert sorted((r["rank_top"], r["id"]) for r in got if r["rank_top"] <= 30) == list(enumerate(order[:30], 1))
    assert sorted((r["rank_bottom"], r["id"]) for r in got if r["rank_bottom"] <= 40) == list(enumerate(order[::-1][:40], 1))


def test_latest_prediction_prefers_the_higher_of_a_date(spark):
    rows = [(date(2024, 1, 1), "A", 9.0), (date(2024, 1, 2), "A", 1.0), (date(2024, 1, 2), "A", 2.0)]
    preds = load_predictions(spark.createDataFrame(rows, "release_date date, id string, pred_10d double"))
    row = latest_predictions(preds).first()
    assert (row["pred_date"], row["pred"]) == (datetime(2024, 1, 2), 2.0)


def test_targets_need_money_and_leverage(spark):
    book = spark.createDataFrame([("A", 0.5), ("B", -0.5)], "id string, weight double")
    accounts = spark.createDataFrame([(1, 100.0), (2, 0.0), (3, -5.0)], "account int, value double")
    got = target_notionals(book, accounts).collect()
    assert sorted((r["account"], r["id"], r["target_value"]) for r in got) == [(1, "A", 50.0), (1, "B", -50.0)]
    assert target_notionals(book, accounts, 0.0).count() == 0


def test_files_by_suffix(spark, tmp_path):
    frame = spark.createDataFrame([("2024-01-01", "A", 0.5), ("2024-01-02", "B", None), ("2024-01-03", "C", float("nan"))],
                                  "release_date string, id string, pred_10d double")
    write_parquet(frame, str(tmp_path / "x.parquet"))
    write_csv(frame.where("id = 'A'"), str(tmp_path / "x.csv"))
    assert load_table(str(tmp_path / "x.parquet")).count() == 3
    assert [tuple(r) for r in load_table(str(tmp_path / "x.csv"), schema=frame.schema).collect()] == [("2024-01-01", "A", 0.5)]
    assert load_table(frame) is frame
    with pytest.raises(ValueError, match="Unsupported file type"):
        load_table(str(tmp_path / "x.txt"), spark)
    loaded = load_predictions(str(tmp_path / "x.parquet"), spark=spark)
    assert sorted(r["id"] for r in loaded.collect()) == ["A", "C"]
    assert loaded.schema["pred_date"].dataType.simpleString() == "timestamp_ntz"


def test_time_of_day_is_kept(spark):
    frame = spark.createDataFrame([(datetime(2024, 1, 1, 7, 30), "A", 1.0)], "release_date timestamp_ntz, id string, pred_10d double")
    assert load_predictions(frame).first()["pred_date"] == datetime(2024, 1, 1, 7, 30)


def test_provider_columns():
    assert columns_for() == ("release_date", "id", "pred_10d")
    assert columns_for("numerai") == ("date", "symbol", "meta_model")
    assert columns_for("numerai", pred_column="mine") == ("date", "symbol", "mine")
    with pytest.raises(ValueError):
        columns_for("nobody")


def daily(spark, returns, equity, drawdown=None, turnover=None):
    n = len(returns)
    rows = [(datetime(2024, 1, 1 + i), returns[i], equity[i], (drawdown or [0.0] * n)[i], (turnover or [0.0] * n)[i]) for i in range(n)]
    return spark.createDataFrame(rows, "date timestamp_ntz, returns double, equity double, drawdown double, turnover double")


def test_statistics_edge_cases(spark):
    one = performance_stats(daily(spark, [0.01], [101.0]), 100.0).first()
    assert one["annual_volatility"] == 0 and one["sharpe_ratio"] == 0 and one["sortino_ratio"] == float("inf")
    single_loss = performance_stats(daily(spark, [0.02, -0.01], [102.0, 100.98]), 100.0).first()
    assert single_loss["sortino_ratio"] == 0 and single_loss["win_rate"] == 0.5
    ruined = performance_stats(daily(spark, [-2.0, 0.0], [-100.0, -100.0], [-2.0, -2.0]), 100.0).first()
    assert ruined["cagr"] == ruined["total_return"] == -2.0 and ruined["calmar_ratio"] == -1.0
    flat = performance_stats(daily(spark, [0.0, 0.0], [100.0, 100.0]), 100.0).first()
    assert flat["sharpe_ratio"] == 0 and flat["sortino_ratio"] == 0 and flat["calmar_ratio"] == 0 and flat["avg_turnover"] == 0
    assert performance_stats(daily(spark, [0.0], [1.0]).where("false"), 100.0).count() == 0


def test_histogram_edges(spark):
    frame = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0), (15.0, 5.0), (7.5, None)], "a double, b double")
    got = {(r["series"], r["bin"]): r["n"] for r in histograms(frame, {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 8): 1, ("a", 15): 1, ("b", 1): 3}
