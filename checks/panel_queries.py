"""Sources, price panel, calendar, signals and weights."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantloom import sources as S
from quantloom.operators import panel as P
from quantloom.operators import signals as A
from quantloom.operators import weights as W
from quantloom.session import work_path

from . import sql as Q
from . import tables as T
from .registry import days, query, r, rounded

PRICE_ROWS = Q.with_(Q.PRICES) + "SELECT CAST(date AS VARCHAR) AS date, id, close FROM prices"
PRED_ROWS = Q.with_(Q.PREDS) + "SELECT CAST(pred_date AS VARCHAR) AS pred_date, id, pred FROM preds"
NUM_LONG, NUM_SHORT, LEVERAGE, POWER = 5, 4, 1.2, 1.5


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def parquet_scan(spark, d):
    return S.load_table(f"{d}/orders.parquet", spark).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = work_path(spark, "customers") + ".csv"
    S.write_csv(T.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return S.load_table(path, spark, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_inferred_scan(spark, d):
    path = work_path(spark, "suppliers") + ".csv"
    S.write_csv(T.table(spark, d, "supplier"), path)
    got = S.load_table(path, spark)
    return got.select(F.col("s_suppkey").cast("bigint"), "s_name", "s_nationkey", "s_acctbal")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def parquet_round_trip(spark, d):
    path = work_path(spark, "segments") + ".parquet"
    S.write_parquet(T.table(spark, d, "customer"), path, ["c_mktsegment"])
    return S.load_table(path, spark).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT n_nationkey, n_name FROM nation")
def frame_source(spark, d):
    return S.load_table(T.table(spark, d, "nation")).select("n_nationkey", "n_name")


@query(PRICE_ROWS)
def price_load(spark, d):
    return days(S.load_prices(T.raw_prices(spark, d)), "date")


@query(PRED_ROWS)
def prediction_load(spark, d):
    return days(S.load_predictions(T.raw_predictions(spark, d)), "pred_date")


@query(PRED_ROWS)
def provider_columns(spark, d):
    theirs = T.raw_predictions(spark, d).toDF("date", "symbol", "meta_model")
    return days(S.load_predictions(theirs, provider="numerai"), "pred_date")


@query(PRED_ROWS)
def landed_predictions(spark, d):
    path = work_path(spark, "landed") + ".parquet"
    S.write_parquet(T.raw_predictions(spark, d).withColumnRenamed("pred_10d", "score"), path)
    return days(S.load_landed_predictions(path, "release", spark, pred_column="score"), "pred_date")


@query(Q.with_(Q.PRICES) + """SELECT count(*) AS n_rows, count(DISTINCT id) AS n_assets,
  CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, CAST(3 AS BIGINT) AS n_columns FROM prices""")
def dataset_summary(spark, d):
    return days(S.summarize(T.prices(spark, d), "date", "id"), "first_date", "last_date")


@query(Q.with_(Q.PRICES, Q.RET) + f"SELECT CAST(date AS VARCHAR) AS date, id, {Q.r('ret', 'ret')} FROM ret")
def price_returns(spark, d):
    return rounded(days(P.price_returns(T.prices(spark, d)), "date"), "ret")


@query(Q.with_(Q.PRICES, Q.RET) + f"SELECT CAST(date AS VARCHAR) AS date, id, close, {Q.r('ret', 'ret')} FROM ret JOIN prices USING (date, id)")
def bucketed_panel(spark, d):
    """Prices and returns read back from a bucketed table."""
    name = f"prices_{uuid.uuid4().hex}"
    S.write_price_table(T.prices(spark, d), name, work_path(spark, name))
    return rounded(days(S.stored_prices(spark, name).join(S.stored_returns(spark, name), ["date", "id"]), "date"), "ret")


WIDE_IDS = [f"Brand#{i}" for i in range(1, 26)]


@query(Q.with_(Q.PRICES, Q.RET) + "SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"round(max(ret) FILTER (WHERE id = '{i}'), 6) + 0.0 AS \"{i}\"" for i in WIDE_IDS) + " FROM ret GROUP BY 1")
def returns_pivot(spark, d):
    return rounded(days(P.returns_wide(P.price_returns(T.prices(spark, d)), WIDE_IDS), "date"), *WIDE_IDS)


@query("""SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, p_brand AS id, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_price_keys(spark, d):
    lines = T.table(spark, d, "lineitem").join(T.brands(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    return days(P.duplicate_keys(lines.select(F.to_date("l_shipdate").alias("date"), "id")), "date")


@query(Q.with_(Q.PRICES, Q.RET) + "SELECT CAST(date AS VARCHAR) AS date, id FROM ret WHERE ret IS NOT NULL")
def available_assets(spark, d):
    return days(P.available_assets(P.price_returns(T.prices(spark, d))), "date")


@query(Q.with_(Q.PRICES, Q.PREDS, Q.VALID) + "SELECT CAST(date AS VARCHAR) AS date FROM valid")
def valid_dates(spark, d):
    window = P.trading_window(T.prices(spark, d), T.predictions(spark, d), 1)
    return days(P.trading_dates(T.prices(spark, d), window), "date")


@query(Q.with_(Q.PRICES, Q.PREDS) + """SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM prices
  WHERE date >= (SELECT min(pred_date) + 30 FROM preds) AND date BETWEEN DATE '1996-02-10' AND DATE '1998-07-05'""")
def valid_dates_bounded(spark, d):
    from datetime import datetime
    prices = T.prices(spark, d)
    window = P.trading_window(prices, T.predictions(spark, d), 30, datetime(1996, 2, 10), datetime(1998, 7, 5))
    return days(P.trading_dates(prices, window), "date")


@query(Q.with_(Q.PRICES, Q.PREDS, Q.VALID) + """SELECT CAST(pred_date AS VARCHAR) AS pred_date, id, pred FROM preds
  WHERE pred_date <= (SELECT last - 1 FROM bounds)""")
def usable_predictions(spark, d):
    predictions = T.predictions(spark, d)
    return days(P.usable_predictions(predictions, P.trading_window(T.prices(spark, d), predictions)), "pred_date")


@query(Q.with_(Q.PRICES, Q.PREDS, Q.RET, Q.VALID) + f"""SELECT CAST(date AS VARCHAR) AS date, id, {Q.r('ret', 'ret')}
  FROM ret WHERE ret IS NOT NULL AND date IN (SELECT date FROM valid)""")
def returns_on_valid_dates(spark, d):
    prices = T.prices(spark, d)
    window = P.trading_window(prices, T.predictions(spark, d))
    got = P.price_returns(prices).where(P.usable() & window.covers(F.col("date")))
    return rounded(days(got, "date"), "ret")


@query(Q.with_(Q.PRICES, Q.PREDS, Q.VALID) + """, steps AS (
  SELECT n AS rebalance_days, date, CASE WHEN date_diff('day', first, date) % n = 0 THEN date_diff('day', first, date) // n END AS k
  FROM valid, bounds, (VALUES (8), (10), (12)) AS s(n))
SELECT rebalance_days, CAST(date AS VARCHAR) AS date, coalesce(k, -1) AS k, coalesce(max(k) OVER (
  PARTITION BY rebalance_days ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS held_k FROM steps""")
def rebalance_calendar(spark, d):
    prices = T.prices(spark, d)
    window = P.trading_window(prices, T.predictions(spark, d))
    cal = P.rebalance_calendar(P.trading_dates(prices, window), window, [8, 10, 12])
    return days(cal, "date").fillna(-1, ["k", "held_k"]).withColumns({c: F.col(c).cast("bigint") for c in ("k", "held_k")})


@query(Q.with_(Q.PREDS, Q.LATEST) + "SELECT id, CAST(pred_date AS VARCHAR) AS pred_date, pred FROM latest")
def latest_predictions(spark, d):
    return days(A.latest_predictions(T.predictions(spark, d)), "pred_date")


ASOF = Q.with_(Q.PRICES, Q.PREDS, Q.RET, Q.VALID) + """, rebal AS (
  SELECT date FROM valid, bounds WHERE date_diff('day', first, date) % 10 = 0),
known AS (SELECT r.date, p.id, arg_max(p.pred, p.pred_date) AS pred FROM rebal r JOIN preds p ON p.pred_date <= r.date - 1
         GROUP BY 1, 2)"""


def _signals(spark, d):
    prices, predictions = T.prices(spark, d), T.predictions(spark, d)
    window = P.trading_window(prices, predictions)
    steps = A.step_signals(P.usable_predictions(predictions, window), window, [10])
    return prices, window, steps


@query(ASOF + " SELECT CAST(date AS VARCHAR) AS date, id, pred FROM known")
def asof_signals(spark, d):
    prices, window, steps = _signals(spark, d)
    kept = steps.join(P.trading_dates(prices, window), "date", "left_semi")
    return days(kept, "date").select("date", "id", "pred")


@query(ASOF + """ SELECT CAST(a.date AS VARCHAR) AS date, a.id, a.pred FROM known a JOIN ret USING (date, id)
  WHERE ret IS NOT NULL""")
def eligible_signals(spark, d):
    prices, window, steps = _signals(spark, d)
    return days(A.eligible_signals(steps, P.price_returns(prices), window, [10]), "date").select("date", "id", "pred")


@query(ASOF + f""", ranked AS (
  SELECT a.date, a.id, pred, row_number() OVER (PARTITION BY a.date ORDER BY pred DESC, a.id) AS rn,
         count(*) OVER (PARTITION BY a.date) AS n FROM known a JOIN ret USING (date, id) WHERE ret IS NOT NULL),
sided AS (SELECT *, CASE WHEN rn <= least(7, n) THEN 'LONG'
          WHEN n - rn + 1 <= least(8, n - least(7, n)) THEN 'SHORT' END AS side FROM ranked)
SELECT CAST(date AS VARCHAR) AS date, id, pred, side, n AS n_assets FROM sided WHERE side IS NOT NULL""")
def backtest_selection(spark, d):
    prices, window, steps = _signals(spark, d)
    eligible = A.eligible_signals(steps, P.price_returns(prices), window, [10])
    return days(A.select_backtest(eligible, ["date"], 7, 8), "date").select("date", "id", "pred", "side", "n_assets")


@query(Q.with_(Q.PREDS, Q.LATEST, Q.UNIVERSE) + "SELECT id, pred FROM latest WHERE id IN (SELECT coin FROM decimals)")
def tradeable_predictions(spark, d):
    latest = A.latest_predictions(T.predictions(spark, d))
    return A.tradeable(latest, T.universe(spark, d)).select("id", "pred")


@query("""WITH listed AS (SELECT 'Brand#' || CAST(c_nationkey + 10 AS VARCHAR) AS id FROM customer GROUP BY 1),
predicted AS (SELECT DISTINCT p_brand AS id FROM part)
SELECT id, 'predictions' AS missing_from FROM listed WHERE id NOT IN (SELECT id FROM predicted)
UNION ALL SELECT id, 'universe' FROM predicted WHERE id NOT IN (SELECT id FROM listed)""")
def universe_mismatch(spark, d):
    listed = T.table(spark, d, "customer").select(
        F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 10).cast("string")).alias("name"),
        F.lit(False).alias("isDelisted")).distinct()
    predicted = T.table(spark, d, "part").select(F.col("p_brand").alias("id"))
    return A.universe_mismatch(predicted, listed)


def _live(spark, d, num_long, num_short):
    listed = A.tradeable(A.latest_predictions(T.predictions(spark, d)), T.universe(spark, d))
    return listed, A.select_live(listed, num_long, num_short)


LIVE = Q.with_(Q.PREDS, Q.LATEST, Q.UNIVERSE) + ", " + Q.live_targets(15, 12, 1.0, 1.0)


@query(LIVE + " SELECT s.id, o.pred, s.side FROM sel s JOIN ordered o USING (id)")
def live_selection(spark, d):
    return _live(spark, d, 15, 12)[1]


@query(Q.with_(Q.PREDS, Q.LATEST, Q.UNIVERSE) + """SELECT count(*) AS available, CAST(27 AS BIGINT) AS requested,
  count(*) < 27 AS short_of_assets FROM latest WHERE id IN (SELECT coin FROM decimals)""")
def live_shortage(spark, d):
    return A.shortage(_live(spark, d, 15, 12)[0], 15, 12)


BOOK = Q.with_(Q.PREDS, Q.LATEST, Q.UNIVERSE) + ", " + Q.live_targets(NUM_LONG, NUM_SHORT, LEVERAGE, POWER)


def live_book(spark, d, num_long=NUM_LONG, num_short=NUM_SHORT, leverage=LEVERAGE, power=POWER):
    listed, chosen = _live(spark, d, num_long, num_short)
    return W.weights_from_ranks(chosen, listed, [], leverage, power)


@query(BOOK + f""" SELECT count(*) FILTER (WHERE side = 'LONG') AS n_long, count(*) FILTER (WHERE side = 'SHORT') AS n_short,
  round({LEVERAGE} * count(*) FILTER (WHERE side = 'LONG') / count(*), 6) AS gross_long,
  round({LEVERAGE} * count(*) FILTER (WHERE side = 'SHORT') / count(*), 6) AS gross_short FROM sel""")
def side_budgets(spark, d):
    return rounded(W.side_budgets(_live(spark, d, NUM_LONG, NUM_SHORT)[1], [], LEVERAGE), "gross_long", "gross_short")


@query(BOOK + f" SELECT b.id, b.side, i AS rank, {Q.r('weight', 'weight')} FROM book b JOIN raws USING (id, side)")
def rank_weights(spark, d):
    return rounded(live_book(spark, d), "weight").withColumn("rank", F.col("rank").cast("bigint"))


@query(LIVE + f" SELECT id, side, {Q.r('weight', 'weight')} FROM weights")
def rank_weights_overlap(spark, d):
    return rounded(live_book(spark, d, 15, 12, 1.0, 1.0), "weight").select("id", "side", "weight")


@query(Q.with_(Q.PREDS, Q.LATEST) + """, asked AS (
  SELECT p_brand AS id, CASE WHEN min(p_partkey) % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM part GROUP BY 1),
sized AS (SELECT *, count(*) OVER (PARTITION BY side) / count(*) OVER () AS share FROM asked),
scored AS (SELECT s.id, side, share, pred FROM sized s JOIN latest l ON l.id = s.id WHERE s.id NOT LIKE '%3'),
places AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'LONG' THEN -pred ELSE pred END,
                  CASE WHEN side = 'LONG' THEN id END, CASE WHEN side = 'SHORT' THEN id END DESC) AS i,
                  count(*) OVER (PARTITION BY side) AS m FROM scored)
SELECT id, side, round(CASE side WHEN 'LONG' THEN 1 ELSE -1 END * 2.0 * share * pow((m - i + 1.0) / m, 0.5)
       / sum(pow((m - i + 1.0) / m, 0.5)) OVER (PARTITION BY side), 6) + 0.0 AS weight FROM places""")
def weights_without_some_scores(spark, d):
    first = F.min("p_partkey")
    asked = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(
        F.when(first % 2 == 0, "LONG").otherwise("SHORT").alias("side"))
    scores = A.latest_predictions(T.predictions(spark, d)).where(~F.col("id").endswith("3"))
    return rounded(W.weights_from_ranks(asked, scores, [], 2.0, 0.5), "weight").select("id", "side", "weight")


TARGETS = BOOK + f""", targets AS (SELECT c_custkey AS account, w.id, weight * c_acctbal AS target_value
  FROM customer, weights w WHERE c_acctbal > 0)"""


@query(TARGETS + f" SELECT account, id, {Q.r('target_value', 'target_value')} FROM targets")
def target_notionals(spark, d):
    return rounded(W.target_notionals(live_book(spark, d), T.accounts(spark, d), LEVERAGE), "target_value")


@query(TARGETS + f" SELECT account, id, {Q.r('target_value', 'target_value')} FROM targets WHERE abs(target_value) < 150")
def undersized_targets(spark, d):
    targets = W.target_notionals(live_book(spark, d), T.accounts(spark, d), LEVERAGE)
    return rounded(W.undersized(targets, 150.0), "target_value")
