"""Portfolio state, trade planning, orders, fills, stops and schedule."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from quantloom.functions import with_half_even, with_size_up
from quantloom.operators import fills as E
from quantloom.operators import orders as O
from quantloom.operators import portfolio as H
from quantloom.operators import schedule as C
from quantloom.operators import stops as L
from quantloom.operators import trades as X
from quantloom.operators import weights as W

from . import sql as Q
from . import tables as T
from .panel_queries import LEVERAGE, NUM_LONG, NUM_SHORT, POWER, live_book
from .registry import numbered, query, r, rounded

# --- Portfolio state -------------------------------------------------------------------------------------------------


@query(Q.with_(Q.BOOKS) + f"""SELECT account, coin, {Q.r('szi', 'szi')}, {Q.r('entryPx', 'entryPx')},
  {Q.r('CASE WHEN szi > 0 THEN entryPx / 2 END', 'liquidationPx')}, {Q.r('abs(szi)', 'marginUsed')} FROM books WHERE szi <> 0""")
def open_positions(spark, d):
    states = H.parse_state(T.account_states(spark, d))
    return rounded(H.open_positions(states).drop("unreadable"), "szi", "entryPx", "liquidationPx", "marginUsed")


@query(Q.with_(Q.BOOKS) + f"""SELECT account, coin, {Q.r("CASE WHEN coin <> 'Brand#12' THEN szi END", 'szi')}, {Q.r('entryPx', 'entryPx')},
  coin = 'Brand#12' AS unreadable FROM books WHERE coin = 'Brand#12' OR szi <> 0""")
def open_positions_unreadable(spark, d):
    """One coin's size is written with a thousands separator."""
    garbled = F.regexp_replace("state", '("coin":"Brand#12","szi":)"[^"]*"', '$1"1,000"')
    states = H.parse_state(T.account_states(spark, d).withColumn("state", garbled))
    return rounded(H.open_positions(states), "szi", "entryPx").select("account", "coin", "szi", "entryPx", "unreadable")


MARKED = Q.with_(Q.PRICES, Q.BOOKS, Q.MIDS) + """, priced AS (SELECT account, b.coin, szi, entryPx, coalesce(mid, entryPx) AS mark
  FROM books b LEFT JOIN mids USING (coin) WHERE szi <> 0),
marked AS (SELECT *, CASE WHEN szi > 0 THEN 'LONG' ELSE 'SHORT' END AS side, abs(szi * mark) AS value,
  CASE WHEN szi > 0 THEN (mark - entryPx) * szi ELSE (entryPx - mark) * abs(szi) END AS pnl FROM priced)"""
MARKED_COLUMNS = f"""account, coin, side, {Q.r('abs(szi)', 'size')}, entryPx AS entry_price, mark AS mark_price, {Q.r('value', 'value')},
  {Q.r('pnl', 'unrealized_pnl')}, {Q.r('CASE WHEN entryPx > 0 THEN pnl / (abs(szi) * entryPx) * 100 ELSE 0 END', 'return_pct')}"""


def marked(spark, d):
    return H.mark_to_market(T.books(spark, d), T.mids(spark, d))


def marked_rows(df):
    return rounded(df, "size", "value", "unrealized_pnl", "return_pct").select(
        "account", "coin", "side", "size", "entry_price", "mark_price", "value", "unrealized_pnl", "return_pct", "place")


@query(MARKED + f" SELECT {MARKED_COLUMNS}, row_number() OVER (ORDER BY abs(value) DESC, account, coin) AS place FROM marked")
def mark_to_market(spark, d):
    return numbered(H.position_list(marked(spark, d), ["account", "coin"]), marked_rows)


EXPOSED = MARKED + """, exposed AS (SELECT account,
  coalesce(sum(value) FILTER (WHERE side = 'LONG'), 0) AS longs, coalesce(sum(value) FILTER (WHERE side = 'SHORT'), 0) AS shorts,
  sum(pnl) AS pnl, count(*) FILTER (WHERE side = 'LONG') AS n_long, count(*) FILTER (WHERE side = 'SHORT') AS n_short
  FROM marked GROUP BY 1)"""
EXPOSURE_NAMES = ["total_long_value", "total_short_value", "net_exposure", "total_exposure", "total_unrealized_pnl"]
EXPOSURE_SQL = f"""account, {Q.r('longs', 'total_long_value', 4)}, {Q.r('shorts', 'total_short_value', 4)},
  {Q.r('longs - shorts', 'net_exposure', 4)}, {Q.r('longs + shorts', 'total_exposure', 4)},
  {Q.r('pnl', 'total_unrealized_pnl', 4)}, n_long, n_short"""


@query(EXPOSED + f" SELECT {EXPOSURE_SQL} FROM exposed")
def exposure(spark, d):
    return rounded(H.exposure(marked(spark, d), ["account"]), *EXPOSURE_NAMES, places=4)


@query(MARKED + f""" SELECT {Q.r("sum(value) FILTER (WHERE side = 'LONG')", 'total_long_value', 2)},
  {Q.r("sum(value) FILTER (WHERE side = 'SHORT')", 'total_short_value', 2)},
  count(*) FILTER (WHERE side = 'LONG') AS n_long, count(*) FILTER (WHERE side = 'SHORT') AS n_short FROM marked""")
def exposure_of_all(spark, d):
    return rounded(H.exposure(marked(spark, d)), "total_long_value", "total_short_value", places=2).select(
        "total_long_value", "total_short_value", "n_long", "n_short")


@query("""WITH spent AS (SELECT o_custkey AS account, max(o_totalprice) AS most, min(o_totalprice) AS least FROM orders GROUP BY 1),
a AS (SELECT c_custkey AS account, c_acctbal AS v, coalesce(most, 0) AS most, coalesce(least, 0) AS least
      FROM customer LEFT JOIN spent ON account = c_custkey)
SELECT account, v AS account_value, most AS total_position_value, least AS margin_used, round(v - least, 6) + 0.0 AS free_collateral,
  round(v - least, 6) + 0.0 AS cash_balance, round(v / 4, 6) + 0.0 AS withdrawable,
  round(CASE WHEN v > 0 THEN most / v ELSE 0 END, 4) + 0.0 AS current_leverage,
  round(CASE WHEN account % 3 = 0 THEN CASE WHEN v > 0 THEN v / 2 / v ELSE 0 END END, 6) + 0.0 AS cross_leverage,
  round(CASE WHEN account % 3 = 0 THEN least / 2 END, 6) + 0.0 AS cross_margin_used,
  round(CASE WHEN account % 3 = 0 THEN least / 4 END, 6) + 0.0 AS cross_maintenance_margin FROM a""")
def account_metrics(spark, d):
    metrics = H.account_metrics(H.parse_state(T.account_states(spark, d))).drop("unreadable")
    return rounded(rounded(metrics, "free_collateral", "cash_balance", "withdrawable", "cross_leverage",
                           "cross_margin_used", "cross_maintenance_margin"), "current_leverage", places=4)


@query(EXPOSED + """, e AS (SELECT x.*, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 1 END AS v FROM exposed x
  JOIN customer ON c_custkey = account)
SELECT account, round(longs / v * 100, 4) + 0.0 AS long_pct, round(shorts / v * 100, 4) + 0.0 AS short_pct,
  round((longs - shorts) / v * 100, 4) + 0.0 AS net_pct, round(longs / v * 100 + shorts / v * 100, 4) + 0.0 AS gross_pct,
  round(pnl / v * 100, 4) + 0.0 AS pnl_pct FROM e""")
def exposure_percent(spark, d):
    both = H.exposure(marked(spark, d), ["account"]).join(T.accounts(spark, d), "account")
    names = ["long_pct", "short_pct", "net_pct", "gross_pct", "pnl_pct"]
    return rounded(H.exposure_percent(both, F.col("value")), *names, places=4).select("account", *names)


# --- Trade planning --------------------------------------------------------------------------------------------------

MIN_TRADE, TAKER = 10.0, 0.00035
BOOK_SQL = ", ".join([Q.PREDS, Q.PRICES, Q.LATEST, Q.UNIVERSE, Q.MIDS, Q.BOOKS, Q.live_targets(NUM_LONG, NUM_SHORT, LEVERAGE, POWER)])
DELTAS = "WITH " + BOOK_SQL + """,
targets AS (SELECT c_custkey AS account, id AS coin, weight * c_acctbal AS target FROM customer, weights WHERE c_acctbal > 0),
deltas AS (SELECT account, coin, coalesce(target, 0) AS target, coalesce(szi, 0) AS szi, mid, coalesce(szi, 0) * mid AS cur,
                  coalesce(target, 0) - coalesce(szi, 0) * mid AS delta, szd
           FROM targets FULL JOIN books USING (account, coin) LEFT JOIN mids USING (coin) LEFT JOIN decimals USING (coin))"""
CLOSING = "WITH " + ", ".join([Q.PRICES, Q.UNIVERSE, Q.MIDS, Q.BOOKS]) + """,
deltas AS (SELECT account, coin, 0.0::DOUBLE AS target, szi, mid, szi * mid AS cur, -szi * mid AS delta, szd
           FROM books LEFT JOIN mids USING (coin) LEFT JOIN decimals USING (coin) WHERE szi <> 0)"""
PLAN_TAIL = f""",
sized AS (SELECT *, {Q.half_even('abs(delta) / mid', 'szd', range(0, 6))} AS sz FROM deltas),
typed AS (SELECT *, CASE WHEN cur = 0 THEN CASE WHEN target <> 0 THEN 'open' ELSE 'increase' END
                         WHEN target = 0 THEN 'close'
                         WHEN sign(cur) = sign(target) THEN CASE WHEN abs(target) < abs(cur) THEN 'reduce' ELSE 'increase' END
                         ELSE 'flip' END AS type,
                 CASE WHEN mid IS NULL THEN 'No mid price available' WHEN szd IS NULL THEN 'Unknown szDecimals (meta)'
                      WHEN sz = 0 THEN 'Rounded size is 0 at ' || szd || ' dp' END AS early FROM sized),
plan AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN abs(sz * mid) < {MIN_TRADE} THEN 'Below minimum ${MIN_TRADE}' END AS reason
         FROM typed)"""


def _shown(column: str, name: str) -> str:
    return Q.r(f"CASE WHEN early IS NULL THEN {column} END", name)


PLAN_COLUMNS = f"""account, coin, CASE WHEN early IS NULL THEN CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END END AS direction,
  {_shown('sz', 'sz')}, {_shown('mid', 'price')}, {_shown('cur', 'current_value')}, {Q.r('target', 'target_value')},
  {_shown('delta', 'delta_value')}, CASE WHEN early IS NULL THEN type END AS type,
  {Q.r(f'CASE WHEN early IS NULL THEN abs(delta) * {TAKER} END', 'estimated_fee', 10)}, reason IS NOT NULL AS skipped, reason AS skip_reason"""


def targets(spark, d):
    return W.target_notionals(live_book(spark, d), T.accounts(spark, d), LEVERAGE).withColumnRenamed("id", "coin")


def market(spark, d):
    return X.market_table(T.mids(spark, d), T.universe(spark, d))


def plan(spark, d):
    return X.plan_trades(targets(spark, d), T.books(spark, d), T.mids(spark, d), T.universe(spark, d), MIN_TRADE, TAKER,
                         keys=["account", "coin"])


def close_plan(spark, d, force):
    return X.plan_close_all(T.books(spark, d), T.mids(spark, d), T.universe(spark, d), MIN_TRADE, TAKER, force, ["account", "coin"])


def plan_rows(df):
    shown = rounded(rounded(df, "sz", "price", "current_value", "target_value", "delta_value"), "estimated_fee", places=10)
    return shown.withColumn("direction", F.when(F.col("is_buy"), "buy").when(~F.col("is_buy"), "sell")).select(
        "account", "coin", "direction", "sz", "price", "current_value", "target_value", "delta_value", "type", "estimated_fee",
        "skipped", "skip_reason")


@query(DELTAS + f""" SELECT account, coin, {Q.r('target', 'target_value')}, {Q.r('szi', 'szi')}, {Q.r('mid', 'price')},
  {Q.r('cur', 'current_value')}, {Q.r('delta', 'delta_value')}, CASE WHEN delta > 0 THEN 'buy' WHEN mid IS NOT NULL THEN 'sell' END AS direction,
  {Q.r('abs(delta) / mid', 'size', 8)} FROM deltas""")
def trade_deltas(spark, d):
    got = X.trade_deltas(targets(spark, d), T.books(spark, d), market(spark, d), ["account", "coin"]).drop("size_decimals")
    got = got.withColumn("direction", F.when(F.col("is_buy"), "buy").when(~F.col("is_buy"), "sell")).drop("is_buy")
    return rounded(rounded(got, "target_value", "szi", "price", "current_value", "delta_value"), "size", places=8)


@query(DELTAS + PLAN_TAIL + f" SELECT {PLAN_COLUMNS} FROM plan")
def trade_plan(spark, d):
    return plan_rows(plan(spark, d))


@query(DELTAS + PLAN_TAIL + """ SELECT account, coin, reason IS NOT NULL AS skipped,
  row_number() OVER (ORDER BY reason IS NOT NULL, coalesce(CASE WHEN early IS NULL THEN abs(delta) END, 0) DESC, account, coin) AS place FROM plan""")
def plan_rows_order(spark, d):
    return numbered(X.plan_rows(plan(spark, d), ["account", "coin"]), lambda x: x.select("account", "coin", "skipped", "place"))


@query(DELTAS.replace("weight * c_acctbal AS target", "CASE WHEN c_custkey % 10 = 3 THEN 'NaN'::DOUBLE ELSE weight * c_acctbal END AS target")
       + PLAN_TAIL.replace("WHEN sz = 0", "WHEN isnan(delta) THEN 'Target or position is not a number' WHEN sz = 0")
       + f""" SELECT account, coin, isnan(target) AS wrong, {_shown('sz', 'sz')}, CASE WHEN early IS NULL THEN type END AS type,
  reason IS NOT NULL AS skipped, reason AS skip_reason FROM plan""")
def trade_plan_with_nan(spark, d):
    """Some accounts' targets are not numbers: none of their positions may be closed for that."""
    bad = targets(spark, d).withColumn("target_value", F.when(F.col("account") % 10 == 3, float("nan")).otherwise(F.col("target_value")))
    got = X.plan_trades(bad, T.books(spark, d), T.mids(spark, d), T.universe(spark, d), MIN_TRADE, TAKER, keys=["account", "coin"])
    return rounded(got, "sz").select("account", "coin", F.isnan("target_value").alias("wrong"), "sz", "type", "skipped", "skip_reason")


@query(DELTAS + PLAN_TAIL + f" SELECT {PLAN_COLUMNS} FROM plan WHERE reason IS NULL")
def executable_trades(spark, d):
    return plan_rows(X.executable(plan(spark, d)))


@query(DELTAS + PLAN_TAIL + f" SELECT {PLAN_COLUMNS} FROM plan WHERE reason IS NOT NULL")
def skipped_trades(spark, d):
    return plan_rows(X.skipped(plan(spark, d)))


@query(DELTAS + PLAN_TAIL + f""" SELECT account, coin, {Q.r('abs(delta) / mid', 'size', 8)}, {Q.r('sz', 'rounded_size', 8)}
  FROM sized WHERE mid IS NOT NULL""")
def rounded_sizes(spark, d):
    deltas = X.trade_deltas(targets(spark, d), T.books(spark, d), market(spark, d), ["account", "coin"]).drop("size_decimals")
    got = X.round_sizes(deltas.where(F.col("price").isNotNull()), T.universe(spark, d))
    return rounded(got.select("account", "coin", "size", "rounded_size"), "size", "rounded_size", places=8)


@query(CLOSING + PLAN_TAIL + f" SELECT {PLAN_COLUMNS} FROM plan")
def close_all_plan(spark, d):
    return plan_rows(close_plan(spark, d, False))


UP = "round(ceil(({m} / mid) / pow(10.0, -szd)) * pow(10.0, -szd), szd)".replace("{m}", str(MIN_TRADE))
FORCED = CLOSING + PLAN_TAIL + f""",
small AS (SELECT *, {UP} AS up FROM plan WHERE early IS NULL AND abs(sz * mid) < {MIN_TRADE}),
steps AS (SELECT *, abs(cur) + up * mid AS total FROM small),
chained AS (SELECT *, {Q.half_even('total / mid', 'szd', range(0, 6))} AS close_sz FROM steps),
good AS (SELECT * FROM chained WHERE up * mid >= {MIN_TRADE} AND close_sz * mid >= {MIN_TRADE}),
forced AS (
  SELECT account, coin, 0 AS seq, CASE WHEN cur > 0 THEN 'buy' ELSE 'sell' END AS direction, up AS sz, cur AS c,
         cur + sign(cur) * up * mid AS t, sign(cur) * up * mid AS dl, 'increase' AS type FROM good
  UNION ALL
  SELECT account, coin, 1, CASE WHEN cur > 0 THEN 'sell' ELSE 'buy' END, close_sz, cur + sign(cur) * up * mid, 0.0::DOUBLE,
         -sign(cur) * total, 'close' FROM good)"""


@query(FORCED + f""" SELECT account, coin, seq AS force_seq, direction, {Q.r('sz', 'sz')}, {Q.r('c', 'current_value')},
  {Q.r('t', 'target_value')}, {Q.r('dl', 'delta_value')}, type, {Q.r(f'abs(dl) * {TAKER}', 'estimated_fee', 10)},
  'force_close:' || coin AS force_id FROM forced""")
def forced_closes(spark, d):
    chains = close_plan(spark, d, True).where("force")
    shown = rounded(rounded(chains, "sz", "current_value", "target_value", "delta_value"), "estimated_fee", places=10)
    return shown.withColumn("direction", F.when(F.col("is_buy"), "buy").otherwise("sell")).select(
        "account", "coin", "force_seq", "direction", "sz", "current_value", "target_value", "delta_value", "type",
        "estimated_fee", "force_id")


@query(FORCED + f""" SELECT account, coin, {Q.r('up', 'min_size', 8)} FROM small""")
def size_for_minimum(spark, d):
    deltas = X.trade_deltas(T.books(spark, d).where("szi <> 0").select("account", "coin", F.lit(0.0).alias("target_value")),
                            T.books(spark, d).where("szi <> 0"), market(spark, d), ["account", "coin"])
    sized = with_half_even(deltas, "rounded_size", F.col("size"), F.col("size_decimals"))
    small = sized.where((F.col("rounded_size") != 0) & (F.abs(F.col("rounded_size") * F.col("price")) < MIN_TRADE))
    up = with_size_up(small, "min_size", F.lit(MIN_TRADE), F.col("price"), F.col("size_decimals"))
    return rounded(up, "min_size", places=8).select("account", "coin", "min_size")


@query(FORCED + """, everything AS (
  SELECT account, coin, type, 0 AS stage, 0 AS priority, 'force_close:' || coin AS fid, seq FROM forced
  UNION ALL SELECT account, coin, type, 1, CASE type WHEN 'close' THEN 0 WHEN 'reduce' THEN 1 WHEN 'flip' THEN 1
    WHEN 'increase' THEN 2 ELSE 3 END, '', 0 FROM plan WHERE reason IS NULL)
SELECT account, coin, type, row_number() OVER (PARTITION BY account ORDER BY stage, fid, seq, priority, coin) AS place FROM everything""")
def execution_order(spark, d):
    from pyspark.sql import Window
    ordered = X.execution_order(X.executable(close_plan(spark, d, True)), ["account"])
    place = F.row_number().over(Window.partitionBy("account").orderBy(
        "stage", F.coalesce("force_id", F.lit("")), F.coalesce("force_seq", F.lit(0)), "priority", "coin"))
    return ordered.select("account", "coin", "type", place.cast("bigint").alias("place"))


@query(DELTAS + PLAN_TAIL + f""" SELECT account, count(*) FILTER (WHERE reason IS NULL) AS n_trades,
  count(*) FILTER (WHERE reason IS NULL AND type = 'open') AS n_open, count(*) FILTER (WHERE reason IS NULL AND type = 'close') AS n_close,
  count(*) FILTER (WHERE reason IS NULL AND type = 'flip') AS n_flip, count(*) FILTER (WHERE reason IS NULL AND type = 'reduce') AS n_reduce,
  count(*) FILTER (WHERE reason IS NULL AND type = 'increase') AS n_increase,
  count(*) FILTER (WHERE reason IS NULL AND delta > 0) AS n_buy, count(*) FILTER (WHERE reason IS NULL AND delta <= 0) AS n_sell,
  {Q.r('coalesce(sum(abs(delta)) FILTER (WHERE reason IS NULL AND delta > 0), 0)', 'buy_volume', 4)},
  {Q.r('coalesce(sum(abs(delta)) FILTER (WHERE reason IS NULL AND delta <= 0), 0)', 'sell_volume', 4)},
  {Q.r(f'coalesce(sum(abs(delta) * {TAKER}) FILTER (WHERE reason IS NULL), 0)', 'estimated_fees', 9)},
  count(*) FILTER (WHERE reason IS NOT NULL) AS n_skipped FROM plan GROUP BY account""")
def plan_summary(spark, d):
    summary = X.plan_summary(plan(spark, d), ["account"])
    return rounded(rounded(summary, "buy_volume", "sell_volume", places=4), "estimated_fees", places=9)


@query(DELTAS + f""" SELECT account, {Q.r('coalesce(sum(target) FILTER (WHERE target > 0), 0)', 'target_long', 4)},
  {Q.r('abs(coalesce(sum(target) FILTER (WHERE target < 0), 0))', 'target_short', 4)} FROM targets GROUP BY 1""")
def target_totals(spark, d):
    return rounded(X.target_totals(targets(spark, d), ["account"]), "target_long", "target_short", places=4)


@query(Q.with_(Q.UNIVERSE) + f""", raw AS (SELECT l_orderkey, l_linenumber, p_brand AS coin, l_extendedprice AS px
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, {Q.r(Q.perp_price('px', 'szd'), 'rounded_price')} FROM raw LEFT JOIN decimals USING (coin)""")
def rounded_prices(spark, d):
    lines = T.table(spark, d, "lineitem").join(T.brands(spark, d), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.col("id").alias("coin"), F.col("l_extendedprice").alias("price"))
    return rounded(X.rounded_prices(lines, T.universe(spark, d)), "rounded_price").select(
        "l_orderkey", "l_linenumber", "rounded_price")


WIDE = """WITH wide AS (SELECT p_partkey, 'P' || CAST(p_partkey AS VARCHAR) AS coin, p_retailprice * pow(10.0::DOUBLE, p_partkey % 9 - 4) AS px,
  CAST(p_partkey % 13 AS INTEGER) AS szd, (p_size - 25) / 1000.0::DOUBLE AS szi FROM part)"""


def wide(spark, d):
    """An asset for each part, with 0 to 12 size decimals and prices over nine powers of ten."""
    key = F.col("p_partkey")
    return T.table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("P"), key.cast("string")).alias("coin"),
        (F.col("p_retailprice") * F.pow(F.lit(10.0), (key % 9 - 4).cast("double"))).alias("price"),
        (key % 13).cast("int").alias("szDecimals"), ((F.col("p_size") - 25) / F.lit(1000.0)).alias("szi"))


def wide_universe(spark, d):
    return wide(spark, d).select(F.col("coin").alias("name"), "szDecimals", F.lit(False).alias("isDelisted"))


@query(WIDE + f" SELECT p_partkey, szd AS size_decimals, {Q.perp_price('px', 'szd', -6)} AS rounded_price FROM wide")
def rounded_prices_all_decimals(spark, d):
    got = X.rounded_prices(wide(spark, d).select("p_partkey", "coin", "price"), wide_universe(spark, d))
    return got.select("p_partkey", "size_decimals", "rounded_price")


@query(DELTAS + PLAN_TAIL + f""", limits AS (SELECT account, coin, szd, mid * CASE WHEN delta > 0 THEN 1 - 0.001::DOUBLE ELSE 1 + 0.001::DOUBLE END AS px
  FROM plan WHERE reason IS NULL)
SELECT account, coin, {Q.r(Q.perp_price('px', 'szd'), 'limit_px')} FROM limits""")
def passive_limits(spark, d):
    got = X.passive_limits(X.executable(plan(spark, d)), T.mids(spark, d), T.universe(spark, d), 0.001)
    return rounded(got, "limit_px").select("account", "coin", "limit_px")


# --- Orders ----------------------------------------------------------------------------------------------------------

OUTCOMES = """WITH log AS (SELECT l_orderkey AS trade_id, l_linenumber AS line, p_brand AS coin, l_linestatus = 'O' AS buy, l_quantity AS q,
  p_retailprice AS px, l_tax AS tax, l_returnflag <> 'N' AS rests, l_linenumber AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
outcomes AS (SELECT *, CASE WHEN n <= 3 THEN 'filled' WHEN n = 4 AND rests THEN 'resting' ELSE 'failed' END AS status,
  CASE WHEN n = 4 AND NOT rests THEN 'Order rejected or not filled' WHEN n = 5 THEN 'Insufficient margin'
       WHEN n = 6 THEN 'No status returned' WHEN n = 7 THEN 'Price too far' END AS error,
  CASE WHEN n <= 2 THEN px * (1 + tax / 100) WHEN n = 3 THEN px END AS avg_px,
  CASE WHEN n <= 2 THEN px * (1 + tax / 100) WHEN n = 3 THEN 0 END AS filled_px,
  CASE WHEN n <= 3 THEN q END AS total_sz, CASE WHEN n <= 2 THEN tax WHEN n = 3 THEN 0 END AS fee FROM log),
slips AS (SELECT *, CASE WHEN buy THEN avg_px - px ELSE px - avg_px END / px * 100 AS slip FROM outcomes)"""


def outcomes(spark, d):
    return O.classify_responses(T.order_log(spark, d))


@query(OUTCOMES + f""" SELECT trade_id, line, coin, status, error, {Q.r('avg_px', 'avg_px')}, total_sz, fee AS actual_fee,
  {Q.r('slip', 'slippage_pct')} FROM slips""")
def order_outcomes(spark, d):
    return rounded(outcomes(spark, d), "avg_px", "slippage_pct").select(
        "trade_id", "line", "coin", "status", "error", "avg_px", "total_sz", "actual_fee", "slippage_pct")


@query(OUTCOMES + f""" SELECT coin, count(*) FILTER (WHERE status <> 'failed') AS n_success, count(*) FILTER (WHERE status = 'failed') AS n_failed,
  {Q.r("100.0 * count(*) FILTER (WHERE status <> 'failed') / count(*)", 'success_pct')},
  {Q.r("coalesce(avg(coalesce(slip, 0)) FILTER (WHERE status <> 'failed'), 0)", 'avg_slippage')},
  {Q.r("coalesce(max(coalesce(slip, 0)) FILTER (WHERE status <> 'failed'), 0)", 'max_slippage')},
  {Q.r("coalesce(min(coalesce(slip, 0)) FILTER (WHERE status <> 'failed'), 0)", 'min_slippage')},
  {Q.r("coalesce(sum(fee), 0)", 'actual_fees')}, {Q.r("coalesce(sum(total_sz * filled_px), 0)", 'filled_volume', 1)}
  FROM slips GROUP BY coin""")
def execution_summary(spark, d):
    summary = O.execution_summary(outcomes(spark, d), ["coin"])
    return rounded(rounded(summary, "success_pct", "avg_slippage", "max_slippage", "min_slippage", "actual_fees"),
                   "filled_volume", places=1)


EXPOSURE_VALUE = 50_000.0


@query(DELTAS + f""", t AS (SELECT coalesce(sum(target) FILTER (WHERE target > 0), 0) AS l,
  abs(coalesce(sum(target) FILTER (WHERE target < 0), 0)) AS s FROM targets)
SELECT {Q.r('l', 'long_value', 2)}, {Q.r('s', 'short_value', 2)}, {Q.r('l + s', 'total_exposure', 2)}, {Q.r('l - s', 'net_exposure', 2)},
  {Q.r(f'(l + s) / {EXPOSURE_VALUE}', 'leverage')}, {Q.r(f'(l - s) / {EXPOSURE_VALUE} * 100', 'net_pct')} FROM t""")
def target_exposure(spark, d):
    got = O.target_exposure(targets(spark, d), EXPOSURE_VALUE)
    return rounded(rounded(got, "long_value", "short_value", "total_exposure", "net_exposure", places=2), "leverage", "net_pct")


@query(OUTCOMES + """, ids AS (SELECT *, coin || '/' || CAST(l.c AS VARCHAR) AS account_coin FROM slips
  JOIN (SELECT o_orderkey, o_custkey AS c FROM orders) l ON l.o_orderkey = trade_id),
done AS (SELECT DISTINCT account_coin, buy FROM ids WHERE status <> 'failed')
SELECT i.trade_id, i.line, i.account_coin AS coin FROM ids i
WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.account_coin = i.account_coin AND x.buy = i.buy)""")
def failed_trades(spark, d):
    """Books of many accounts: the coin is told apart by its account."""
    owner = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("trade_id"), "o_custkey")
    found = outcomes(spark, d).join(owner, "trade_id").withColumn(
        "coin", F.concat("coin", F.lit("/"), F.col("o_custkey").cast("string")))
    return O.failed_trades(found, found).select("trade_id", "line", "coin")


@query("""SELECT o_orderkey AS oid, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS coin,
  CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side, CAST(o_custkey % 10 + 1 AS DOUBLE) AS size,
  o_totalprice AS limit_px, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed_at FROM orders WHERE o_custkey % 25 + 1 = 7""")
def open_orders_of_coin(spark, d):
    return O.open_orders(T.resting_orders(spark, d), "Brand#7").withColumn(
        "placed_at", F.date_format("placed_at", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT o_orderkey AS oid, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS coin FROM orders
  WHERE substr(o_orderpriority, 1, 1) IN ('1', '2')""")
def trigger_orders(spark, d):
    return O.trigger_orders(T.resting_orders(spark, d)).select("oid", "coin")


@query(OUTCOMES.replace("THEN 'filled' WHEN", "AND NOT (trade_id % 10 = 3 AND n <= 2) THEN 'filled' WHEN") + """ SELECT trade_id, line, status,
  CASE WHEN trade_id % 10 = 3 AND n <= 2 THEN 'Unreadable fill' ELSE error END AS error,
  CASE WHEN status = 'filled' THEN total_sz END AS total_sz, CASE WHEN status = 'filled' THEN fee END AS actual_fee FROM outcomes""")
def order_outcomes_unreadable(spark, d):
    """Some fills have a price that is no number: they are failures, not fills at the expected price."""
    garbled = F.when(F.col("trade_id") % 10 == 3, F.regexp_replace("response", '"avgPx":"[^"]*"', '"avgPx":"abc"')).otherwise(F.col("response"))
    got = O.classify_responses(T.order_log(spark, d).withColumn("response", garbled))
    return got.select("trade_id", "line", "status", "error", "total_sz", "actual_fee")


@query(OUTCOMES + """ SELECT trade_id, line, CASE WHEN trade_id % 10 = 4 THEN 'failed' ELSE status END AS status,
  CASE WHEN trade_id % 10 = 4 THEN 'Unexpected response format: {try "later"}' ELSE error END AS error FROM outcomes""")
def order_outcomes_no_document(spark, d):
    """Some responses are a text where a document belongs; it looks like one, but is none."""
    text = F.when(F.col("trade_id") % 10 == 4, r'{"status":"ok","response":"{try \"later\"}"}').otherwise(F.col("response"))
    got = O.classify_responses(T.order_log(spark, d).withColumn("response", text))
    return got.select("trade_id", "line", "status", "error")


# --- Fills and PnL ---------------------------------------------------------------------------------------------------

FILL_SQL = "time, coin, side, oid, CAST(sz AS DOUBLE) AS size, px AS price"


def fill_rows(df):
    return E.parse_fills(df).select("time", "coin", "side", "oid", "size", "price")


@query(Q.with_(Q.FILLS) + f"SELECT {FILL_SQL} FROM fills WHERE ts BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1998-02-15'")
def fills_between(spark, d):
    return fill_rows(E.fills_between(T.fills(spark, d), date(1997, 3, 1), date(1998, 2, 15)))


@query(Q.with_(Q.FILLS) + f"SELECT {FILL_SQL} FROM fills WHERE ts BETWEEN TIMESTAMP '1999-06-01 12:00:00' - INTERVAL 90 DAY AND TIMESTAMP '1999-06-01 12:00:00'")
def fills_last_days(spark, d):
    return fill_rows(E.fills_last_days(T.fills(spark, d), 90, datetime(1999, 6, 1, 12)))


@query(Q.with_(Q.FILLS) + f"SELECT {FILL_SQL} FROM fills WHERE coin = 'Brand#12'")
def fills_of_coin(spark, d):
    return fill_rows(E.fills_of_coin(T.fills(spark, d), "bRAND#12"))


@query(Q.with_(Q.FILLS) + f"""SELECT {FILL_SQL} FROM fills
  ORDER BY time DESC, oid, coin, side, CAST(sz AS VARCHAR), CAST(px AS VARCHAR) LIMIT 50""")
def newest_fills(spark, d):
    return fill_rows(E.newest_fills(T.fills(spark, d), 50))


@query(Q.with_(Q.FILLS) + f"""SELECT count(*) AS n_fills, {Q.r('sum(sz * px)', 'volume', 1)}, {Q.r('sum(coalesce(fee, 0))', 'actual_fees', 4)},
  {Q.r('sum(sz * px * 0.00035)', 'estimated_fees', 2)}, count(*) FILTER (WHERE fee IS NULL) AS n_missing_fee,
  {Q.r('abs(sum(coalesce(fee, 0)) - sum(sz * px * 0.00035)) / sum(coalesce(fee, 0)) * 100', 'fee_diff_pct', 4)} FROM fills""")
def fee_summary(spark, d):
    return fee_rows(E.fee_summary(T.fills(spark, d))).drop("n_unreadable")


def fee_rows(got):
    return got.withColumns({"volume": r("volume", 1), "actual_fees": r("actual_fees", 4), "estimated_fees": r("estimated_fees", 2),
                            "fee_diff_pct": r("fee_diff_pct", 4)})


@query(Q.with_(Q.FILLS) + f"""SELECT count(*) AS n_fills, {Q.r('sum(sz * px) FILTER (WHERE oid % 10 <> 3)', 'volume', 1)},
  {Q.r('sum(coalesce(fee, 0))', 'actual_fees', 4)}, count(*) FILTER (WHERE oid % 10 = 3) AS n_unreadable FROM fills""")
def fee_summary_unreadable(spark, d):
    """Some sizes are no numbers: they are counted, not left out without a word."""
    bad = T.fills(spark, d).withColumn("sz", F.when(F.col("oid") % 10 == 3, "1,000").otherwise(F.col("sz")))
    return fee_rows(E.fee_summary(bad)).select("n_fills", "volume", "actual_fees", "n_unreadable")


PNL = Q.with_(Q.PRICES, Q.FILLS, Q.POSITIONS, Q.MIDS) + """, unreal AS (
  SELECT p.coin, CASE WHEN szi > 0 THEN (mark - entryPx) * szi ELSE (entryPx - mark) * abs(szi) END AS u
  FROM (SELECT p.*, coalesce(mid, entryPx) AS mark FROM positions p LEFT JOIN mids USING (coin) WHERE szi <> 0) p),
real AS (SELECT coin, sum(pnl) AS re, sum(coalesce(fee, 0)) AS fees, sum(sz * px) AS volume FROM fills GROUP BY 1),
pnl AS (SELECT coin, coalesce(re, 0) AS re, coalesce(u, 0) AS u, coalesce(fees, 0) AS fees, coalesce(volume, 0) AS volume
        FROM real FULL JOIN unreal USING (coin))"""
PNL_SQL = f"""coin, {Q.r('re', 'realized_pnl', 4)}, {Q.r('u', 'unrealized_pnl', 4)}, {Q.r('fees', 'fees', 4)}, {Q.r('volume', 'volume', 1)}"""


def pnl(spark, d):
    marks = H.mark_to_market(T.positions(spark, d), T.mids(spark, d))
    return E.pnl_by_coin(T.fills(spark, d), marks)


@query(PNL + f""" SELECT coin, coin = 'Brand#12' AS wrong, {Q.r("CASE WHEN coin <> 'Brand#12' THEN re END", 'realized_pnl', 4)},
  {Q.r('fees', 'fees', 4)} FROM pnl""")
def pnl_with_nan(spark, d):
    """A coin with a PnL of NaN shows NaN, not 0."""
    bad = T.fills(spark, d).withColumn("closedPnl", F.when(F.col("coin") == "Brand#12", "NaN").otherwise(F.col("closedPnl")))
    got = E.pnl_by_coin(bad, H.mark_to_market(T.positions(spark, d), T.mids(spark, d)))
    wrong = F.isnan("realized_pnl")
    got = got.select("coin", wrong.alias("wrong"), F.when(~wrong, F.col("realized_pnl")).alias("realized_pnl"), "fees")
    return rounded(got, "realized_pnl", "fees", places=4)


@query(PNL + f" SELECT {PNL_SQL} FROM pnl")
def pnl_by_coin(spark, d):
    return rounded(rounded(pnl(spark, d).drop("n_unreadable"), "realized_pnl", "unrealized_pnl", "fees", places=4), "volume", places=1)


@query(PNL + f""", totals AS (SELECT coin, re, u, fees, volume FROM pnl UNION ALL SELECT 'TOTAL', sum(re), sum(u), sum(fees), sum(volume) FROM pnl)
SELECT {PNL_SQL}, {Q.r('re + u', 'total_pnl', 4)} FROM totals""")
def pnl_totals(spark, d):
    names = ["realized_pnl", "unrealized_pnl", "fees", "total_pnl"]
    return rounded(rounded(E.pnl_totals(pnl(spark, d)).drop("n_unreadable"), *names, places=4), "volume", places=1)


# --- Stops -----------------------------------------------------------------------------------------------------------

STOPS = Q.with_(Q.BOOKS, Q.UNIVERSE) + """, lv AS (SELECT b.account, b.coin, szi, entryPx, szd, szi > 0 AS long,
  entryPx * CASE WHEN szi > 0 THEN 1 - 0.17::DOUBLE ELSE 1 + 0.17::DOUBLE END AS tpx FROM books b LEFT JOIN decimals USING (coin) WHERE szi <> 0),
lx AS (SELECT *, tpx * CASE WHEN long THEN 1 - 0.05::DOUBLE ELSE 1 + 0.05::DOUBLE END AS lpx FROM lv)"""


def stops(spark, d, setting):
    return L.stop_levels(T.books(spark, d), T.universe(spark, d), setting, 0.17, 0.05)


@query(STOPS + f""" SELECT account, coin, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS side, CASE WHEN long THEN 'sell' ELSE 'buy' END AS direction,
  {Q.r(Q.perp_price('tpx', 'szd'), 'trigger_px')}, {Q.r(Q.perp_price('lpx', 'szd'), 'limit_px')},
  {Q.r(Q.half_even('abs(szi)', 'szd', range(0, 6)), 'sz')} FROM lx WHERE szd IS NOT NULL AND entryPx > 0""")
def stop_levels(spark, d):
    placed = stops(spark, d, "both").where(F.col("skip_reason").isNull())
    return rounded(placed, "trigger_px", "limit_px", "sz").select(
        "account", "coin", "side", F.when(F.col("is_buy"), "buy").otherwise("sell").alias("direction"), "trigger_px", "limit_px", "sz")


@query(WIDE + f""", lv AS (SELECT *, szi > 0 AS long, px * CASE WHEN szi > 0 THEN 1 - 0.17::DOUBLE ELSE 1 + 0.17::DOUBLE END AS tpx FROM wide WHERE szi <> 0),
lx AS (SELECT *, tpx * CASE WHEN long THEN 1 - 0.05::DOUBLE ELSE 1 + 0.05::DOUBLE END AS lpx FROM lv),
done AS (SELECT *, {Q.perp_price('tpx', 'szd', -6)} AS t, {Q.perp_price('lpx', 'szd', -6)} AS l, {Q.half_even('abs(szi)', 'szd', range(0, 13))} AS sz FROM lx)
SELECT coin, CASE WHEN NOT (t > 0 AND l > 0) THEN 'No price after rounding' END AS skip_reason, CASE WHEN t > 0 AND l > 0 THEN t END AS trigger_px,
  CASE WHEN t > 0 AND l > 0 THEN l END AS limit_px, CASE WHEN t > 0 AND l > 0 THEN sz END AS sz FROM done""")
def stop_levels_wide_decimals(spark, d):
    held = wide(spark, d).select("coin", "szi", F.col("price").alias("entryPx"))
    got = L.stop_levels(held, wide_universe(spark, d), "both", 0.17, 0.05)
    empty = F.col("skip_reason").isNotNull()
    return got.select("coin", "skip_reason", *[F.when(~empty, F.col(c)).alias(c) for c in ("trigger_px", "limit_px", "sz")])


@query(STOPS + """ SELECT account, coin FROM lx WHERE long""")
def stop_eligible_longs(spark, d):
    held = T.books(spark, d).where("szi <> 0").withColumn("side", F.when(F.col("szi") > 0, "LONG").otherwise("SHORT"))
    return held.where(L.stop_eligible(F.col("side"), "long_only")).select("account", "coin")


@query(STOPS + """ SELECT CASE WHEN long THEN 'Side LONG not configured' WHEN entryPx <= 0 THEN 'Invalid entry price'
  WHEN szd IS NULL THEN 'Unknown szDecimals' ELSE 'applied' END AS outcome, count(*) AS n, bool_or(long) AS side_skip FROM lx GROUP BY 1""")
def stop_report(spark, d):
    return L.stop_report(stops(spark, d, "short_only"))


# --- Schedule --------------------------------------------------------------------------------------------------------

NOW = datetime(2024, 1, 25, 17, 0, 30)
SCHEDULE = """WITH a AS (SELECT c_custkey AS account, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01 09:30:00' +
  CAST(c_custkey % 20 AS INTEGER) * INTERVAL 1 DAY END AS last, TIMESTAMP '2024-01-25 17:00:30' AS now FROM customer),
s AS (SELECT *, CASE WHEN last IS NULL THEN CASE WHEN now < TIMESTAMP '2024-01-25 18:15:00' THEN TIMESTAMP '2024-01-25 18:15:00' ELSE now END
  ELSE CAST(last AS DATE) + INTERVAL 10 DAY + INTERVAL 18 HOUR + INTERVAL 15 MINUTE END AS next FROM a)"""


def scheduled(spark, d):
    return C.next_rebalance(T.accounts(spark, d), 10, "18:15", NOW)


@query(SCHEDULE + " SELECT account, strftime(next, '%Y-%m-%d %H:%M:%S') AS next_rebalance FROM s")
def next_rebalance(spark, d):
    return scheduled(spark, d).select("account", F.date_format("next_rebalance", "yyyy-MM-dd HH:mm:ss").alias("next_rebalance"))


@query(SCHEDULE + " SELECT account FROM s WHERE now >= next")
def due_accounts(spark, d):
    return C.due_accounts(scheduled(spark, d), NOW).select("account")


@query(SCHEDULE + """ SELECT account, now >= next AS due, CAST(greatest(date_diff('second', now, next), 0) AS BIGINT) AS seconds_until,
  coalesce(date_diff('second', last, now), -1) AS seconds_since FROM s""")
def rebalance_countdown(spark, d):
    return C.countdown(scheduled(spark, d), NOW).select("account", "due", "seconds_until",
                                                       F.coalesce("seconds_since", F.lit(-1)).alias("seconds_since"))
