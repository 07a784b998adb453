"""SQL pieces shared by the twins. Written from the definitions, not from the Spark plans."""

from __future__ import annotations

PRICES = """prices AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS id, 1000 + max(l_quantity) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
PREDS = """preds AS (
  SELECT CAST(o_orderdate AS DATE) AS pred_date, p_brand AS id, max(o_totalprice) AS pred
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
RET = """ret AS (
  SELECT date, id, close / lag(close) OVER (PARTITION BY id ORDER BY date) - 1 AS ret FROM prices)"""
VALID = """valid AS (
  SELECT DISTINCT date FROM prices WHERE date >= (SELECT min(pred_date) + 1 FROM preds)),
bounds AS (SELECT min(date) AS first, max(date) AS last FROM valid)"""
UNIVERSE = """universe AS (
  SELECT p_brand AS name, CAST(min(p_partkey) % 6 AS INTEGER) AS szd, min(p_partkey) % 10 = 9 AS delisted
  FROM part GROUP BY 1),
decimals AS (SELECT name AS coin, szd FROM universe WHERE NOT delisted)"""
LATEST = """latest AS (SELECT id, max(pred_date) AS pred_date, arg_max(pred, pred_date) AS pred FROM preds GROUP BY id)"""
MIDS = """mids AS (
  SELECT id AS coin, arg_max(close, date) AS mid FROM prices WHERE id <> 'Brand#1' GROUP BY id)"""
POSITIONS = """positions AS (
  SELECT p_brand AS coin,
         sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) / 1000 AS szi,
         min(p_retailprice) AS entryPx
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
BOOKS = """books AS (
  SELECT o_custkey AS account, p_brand AS coin,
         sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) / 1000 AS szi,
         min(p_retailprice) AS entryPx
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
FILLS = """fills AS (
  SELECT epoch_ms(l_shipdate) AS time, l_shipdate AS ts, p_brand AS coin,
         CASE l_linestatus WHEN 'O' THEN 'B' ELSE 'A' END AS side,
         l_quantity AS sz, p_retailprice AS px, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS fee,
         CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE l_discount - 0.05 END AS pnl, l_orderkey AS oid
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def live_targets(num_long: int, num_short: int, leverage: float, power: float) -> str:
    """Targets of every account with money: top and bottom of the tradeable list, shorts winning an overlap."""
    return f"""tradeable AS (SELECT l.* FROM latest l JOIN decimals d ON d.coin = l.id),
ordered AS (SELECT id, pred, row_number() OVER (ORDER BY pred DESC, id) AS rn, count(*) OVER () AS n FROM tradeable),
sel AS (SELECT id, 'LONG' AS side, rn AS i FROM ordered WHERE rn <= {num_long}
        UNION ALL SELECT id, 'SHORT', n - rn + 1 FROM ordered WHERE n - rn + 1 <= {num_short}),
chosen AS (SELECT *, count(*) OVER (PARTITION BY side) AS m, count(*) OVER () AS total FROM sel),
raws AS (SELECT *, pow((m - i + 1.0) / m, greatest({power}, 1e-6)) AS raw FROM chosen),
book AS (SELECT id, side, CASE side WHEN 'LONG' THEN 1 ELSE -1 END * {leverage} * m / total * raw
           / sum(raw) OVER (PARTITION BY side) AS weight FROM raws),
weights AS (SELECT * FROM book b WHERE side = 'SHORT' OR NOT EXISTS
            (SELECT 1 FROM book s WHERE s.id = b.id AND s.side = 'SHORT'))"""


def backtest(params: str, start: str | None = None, end: str | None = None, cost: float = 0.0054,
             capital: float = 100000.0) -> str:
    """Everything from prices to daily rows and statistics for ``params(run, nl, ns, lev, days, power)``."""
    bounds = (f" AND date >= DATE '{start}'" if start else "") + (f" AND date <= DATE '{end}'" if end else "")
    valid = VALID.replace("FROM preds)),", f"FROM preds){bounds}),")
    return with_(f"params(run, nl, ns, lev, days, power) AS ({params})", PRICES, PREDS, RET, valid) + f""",
sched AS (SELECT DISTINCT days FROM params),
rebal AS (SELECT days, date, lag(date) OVER (PARTITION BY days ORDER BY date) AS prev_date
          FROM sched, valid, bounds WHERE date_diff('day', first, date) % days = 0),
known AS (SELECT r.days, r.date, p.id, arg_max(p.pred, p.pred_date) AS pred
         FROM rebal r JOIN preds p ON p.pred_date <= r.date - 1 GROUP BY 1, 2, 3),
eligible AS (SELECT a.* FROM known a JOIN ret ON ret.date = a.date AND ret.id = a.id AND ret.ret IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY days, date ORDER BY pred DESC, id) AS rn,
                  count(*) OVER (PARTITION BY days, date) AS n FROM eligible),
placed AS (SELECT run, lev, power, date, id, rn, n, least(nl, n) AS ml, least(ns, n - least(nl, n)) AS ms
           FROM ranked JOIN params USING (days)),
sided AS (SELECT *, CASE WHEN rn <= ml THEN 'LONG' WHEN n - rn + 1 <= ms THEN 'SHORT' END AS side FROM placed),
raws AS (SELECT *, pow(CASE side WHEN 'LONG' THEN (ml - rn + 1.0) / ml ELSE (ms - (n - rn + 1) + 1.0) / ms END,
                       greatest(power, 1e-6)) AS raw FROM sided WHERE side IS NOT NULL),
w AS (SELECT run, date, id, CASE side WHEN 'LONG' THEN ml ELSE -ms END * lev / (ml + ms) * raw
             / sum(raw) OVER (PARTITION BY run, date, side) AS weight FROM raws),
steps AS (SELECT run, date, prev_date FROM rebal JOIN params USING (days)),
moves AS (SELECT run, date, id, weight FROM w
          UNION ALL SELECT s.run, s.date, w.id, -w.weight FROM steps s JOIN w ON w.run = s.run AND w.date = s.prev_date),
turn AS (SELECT run, date, sum(abs(m)) AS turnover
         FROM (SELECT run, date, id, sum(weight) AS m FROM moves GROUP BY 1, 2, 3) GROUP BY 1, 2),
held AS (SELECT s.days, v.date, max(r.date) AS held_date FROM sched s CROSS JOIN valid v
         JOIN rebal r ON r.days = s.days AND r.date < v.date GROUP BY 1, 2),
gross AS (SELECT w.run, h.date, sum(w.weight * ret.ret) AS g
          FROM params p JOIN held h USING (days) JOIN w ON w.run = p.run AND w.date = h.held_date
          JOIN ret ON ret.date = h.date AND ret.id = w.id AND ret.ret IS NOT NULL GROUP BY 1, 2),
flows AS (SELECT p.run, v.date, coalesce(g, 0) AS returns, coalesce(turnover, 0) AS turnover
          FROM params p CROSS JOIN valid v LEFT JOIN gross g ON g.run = p.run AND g.date = v.date
          LEFT JOIN turn t ON t.run = p.run AND t.date = v.date),
curve AS (SELECT *, {capital} * product((1 + returns) * (1 - turnover * {cost}))
                    OVER (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM flows),
pre AS (SELECT *, lag(equity, 1, {capital}) OVER (PARTITION BY run ORDER BY date) * (1 + returns) AS pre FROM curve),
peaks AS (SELECT *, greatest({capital}, max(pre) OVER (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak
          FROM pre),
daily AS (SELECT run, date, returns, equity, (pre - peak) / peak AS drawdown, turnover FROM peaks),
sums AS (SELECT run, count(*) AS days, arg_max(equity, date) AS final_equity,
                coalesce(stddev_samp(returns), 0) * sqrt(365.0) AS vol, avg(returns) * 365 AS mean,
                min(drawdown) AS mdd, avg(CASE WHEN returns > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
                coalesce(avg(turnover) FILTER (WHERE turnover > 0), 0) AS avg_turnover,
                coalesce(stddev_samp(returns) FILTER (WHERE returns < 0), 0) * sqrt(365.0) AS down,
                count(*) FILTER (WHERE returns < 0) AS losses FROM daily GROUP BY run),
rated AS (SELECT *, final_equity / {capital} - 1 AS total_return,
                 CASE WHEN final_equity > 0 THEN pow(final_equity / {capital}, 365.0 / days) - 1
                      ELSE final_equity / {capital} - 1 END AS cagr FROM sums),
stats AS (SELECT run, days, total_return, cagr, vol AS annual_volatility,
                 CASE WHEN vol > 0 THEN mean / vol ELSE 0 END AS sharpe_ratio,
                 CASE WHEN down > 0 THEN mean / down WHEN losses = 0 AND mean > 0 THEN 'inf'::DOUBLE ELSE 0 END
                   AS sortino_ratio, mdd AS max_drawdown,
                 CASE WHEN mdd < 0 THEN cagr / abs(mdd) ELSE 0 END AS calmar_ratio, win_rate, avg_turnover, final_equity
          FROM rated)
"""


def half_even(expression: str, decimals: str, scales: range) -> str:
    """Exact rounding through printf, which looks at the binary value; below zero decimals through the exact remainder."""
    def one(i: int) -> str:
        if i >= 0:
            return f"CAST(printf('%.{i}f', {expression}) AS DOUBLE)"
        x, m = f"({expression})", f"{10 ** -i}::DOUBLE"
        return (f"{x} - {x} % {m} + CASE WHEN {x} % {m} > {m} / 2 OR ({x} % {m} = {m} / 2 AND (({x} - {x} % {m}) / {m}) % 2 = 1) "
                f"THEN {m} ELSE 0 END")
    return f"CASE {decimals} " + " ".join(f"WHEN {i} THEN {one(i)}" for i in scales) + " END"


def perp_price(px: str, decimals: str, lowest: int = 0) -> str:
    five = f"CAST(printf('%.4e', {px}) AS DOUBLE)"
    return (f"CASE WHEN {px} > 100000 THEN CAST(printf('%.0f', {px}) AS DOUBLE) WHEN {decimals} IS NULL THEN {five} "
            f"ELSE {half_even(five, f'6 - {decimals}', range(lowest, 7))} END")


def r(expression: str, name: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0 AS {name}"
