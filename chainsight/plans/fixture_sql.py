"""DuckDB restatement of the fixture views, used only by the oracle SQL.

Each oracle query is ``WITH <needed views> SELECT ...`` over the driver's
pre-registered tables; ``with_views`` pulls in the dependencies of a view.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "px": ((), """
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS quote_date,
       400 + max_by(o_totalprice, o_orderkey) / 40000 AS close
FROM orders GROUP BY 1, 2"""),
    "und": (("px",), """
SELECT symbol, CAST(date_trunc('week', quote_date) AS DATE) AS trade_date,
       max_by(close, quote_date) AS und_price FROM px GROUP BY 1, 2"""),
    "legs": ((), """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS seq,
       CASE WHEN l_suppkey % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END AS symbol,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
       CAST(date_trunc('week', l_shipdate) AS DATE) + CAST(4 + 28 * (l_linenumber - 1) AS INT) AS expiry,
       400 + ((l_partkey % 41) - 20) * 5 AS k,
       CASE WHEN l_linestatus = 'F' THEN 'CALL' WHEN l_linestatus = 'O' THEN 'PUT' END AS right_code,
       CAST(floor(l_extendedprice / 1000) AS BIGINT) AS bid_i, CAST(round(l_tax * 100) AS BIGINT) AS spread_i,
       CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) AS disc_i,
       l_returnflag AS flag, l_linenumber AS ln
FROM lineitem"""),
    "iv_feed": (("legs", "und"), """
SELECT l.seq, l.symbol, l.trade_date, CAST(l.expiry AS STRING) AS expiration, CAST(l.k AS STRING) AS strike,
       l.right_code AS right_,
       CASE WHEN flag = 'N' AND ln = 7 THEN '' ELSE CAST(bid_i AS STRING) END AS bid,
       CAST(bid_i + spread_i AS STRING) AS ask, CONCAT('0.', CAST(10 + 2 * disc_i AS STRING)) AS implied_vol,
       u.und_price AS underlying_price
FROM legs l LEFT JOIN und u ON l.symbol = u.symbol AND l.trade_date = u.trade_date"""),
    "oi_feed": (("legs",), """
SELECT seq, symbol, trade_date, CAST(expiry AS STRING) AS expiration, CAST(k AS STRING) AS strike,
       right_code AS right_, CAST(qty * 10 AS STRING) AS open_interest FROM legs WHERE flag <> 'R'"""),
    "ohlc_feed": (("legs",), """
SELECT seq, symbol, trade_date, CAST(expiry AS STRING) AS expiration, CAST(k AS STRING) AS strike,
       right_code AS right_, CASE WHEN ln = 6 THEN '' ELSE CAST(bid_i AS STRING) END AS close,
       CAST(qty AS STRING) AS volume FROM legs WHERE flag <> 'N'"""),
    "chain": (("legs",), """
SELECT symbol, trade_date, expiry, CAST(k AS DOUBLE) AS strike,
       CASE WHEN right_code = 'CALL' THEN 'C' ELSE 'P' END AS right_,
       CAST(sum(qty) * 10 AS DOUBLE) AS oi, round(avg(10 + 2 * disc_i) / 100, 6) AS iv
FROM legs GROUP BY 1, 2, 3, 4, 5"""),
    "ticks": ((), """
SELECT event_id AS seq, ts, user_id AS req_id,
       CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 9 ELSE 99 END AS tick_type,
       value FROM events"""),
    "tick_feed": ((), """
SELECT event_id AS seq, ts, user_id AS req_id,
       CASE WHEN event_type IN ('view', 'purchase') THEN 'price' WHEN event_type = 'signup' THEN 'option' ELSE 'size' END AS kind,
       CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 5 = 0 THEN 8 ELSE 1 END WHEN event_type = 'purchase' THEN 4
            WHEN event_type = 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 10 ELSE 13 END
            WHEN event_id % 3 = 0 THEN 27 WHEN event_id % 3 = 1 THEN 28 WHEN event_id % 2 = 0 THEN 1 ELSE 8 END AS code,
       CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE value END AS value, event_id, value AS v FROM events"""),
    "tick_rows": (("tick_feed",), """
SELECT seq, ts, req_id, value, CASE WHEN kind = 'size' THEN
         CASE code WHEN 8 THEN 'Volume' WHEN 27 THEN 'CallOpenInterest' WHEN 28 THEN 'PutOpenInterest' WHEN 78 THEN 'OpenInterest' ELSE 'T' || code END
       ELSE CASE code WHEN 1 THEN 'Bid' WHEN 2 THEN 'Ask' WHEN 4 THEN 'Last' WHEN 6 THEN 'High' WHEN 7 THEN 'Low' WHEN 9 THEN 'Close' WHEN 14 THEN 'Open'
         ELSE 'T' || code END END AS field FROM tick_feed WHERE kind <> 'option'
UNION ALL SELECT seq, ts, req_id, x.val, CASE code WHEN 10 THEN 'Bid' WHEN 11 THEN 'Ask' WHEN 12 THEN 'Last' WHEN 13 THEN 'Model' ELSE 'T' || code END || '_' || x.f
FROM (SELECT *, unnest([{'f': 'IV', 'val': v / 1000}, {'f': 'Delta', 'val': v / 500 - 0.5}, {'f': 'Gamma', 'val': v / 10000}, {'f': 'Theta', 'val': -v / 100},
        {'f': 'Vega', 'val': v / 50}, {'f': 'OptPrice', 'val': CASE WHEN event_id % 11 = 0 THEN -1.0 ELSE v / 10 END}, {'f': 'UndPrice', 'val': v + 400}]) AS x
      FROM tick_feed WHERE kind = 'option')"""),
    "contracts": ((), """
SELECT DISTINCT user_id AS req_id, CASE WHEN user_id % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END AS symbol, '2024-06-21' AS expiry,
       CAST(400 + 5 * (user_id % 41) AS DOUBLE) AS strike, CASE WHEN user_id % 3 = 0 THEN 'P' ELSE 'C' END AS right_ FROM events"""),
    "abc": (("px",), """
SELECT symbol, quote_date, close, EXTRACT(DAY FROM quote_date) AS d,
       CAST(1 + EXTRACT(DAY FROM quote_date) % 7 AS DOUBLE) AS a,
       CAST(1 + EXTRACT(MONTH FROM quote_date) % 3 AS DOUBLE) AS b,
       CAST(1 + EXTRACT(DOY FROM quote_date) % 5 AS DOUBLE) AS c FROM px"""),
    "proba": (("abc",), """
SELECT symbol, quote_date, close, a / (a + b + c) AS proba_up_ens, b / (a + b + c) AS proba_flat_ens,
       c / (a + b + c) AS proba_down_ens,
       CASE WHEN d = 31 THEN NULL WHEN d % 4 = 0 THEN 0 ELSE 1 END AS above_sma200,
       CASE WHEN d % 9 = 0 THEN 0 ELSE 1 END AS vol_regime
FROM abc"""),
    "members": (("abc",), """
SELECT symbol, quote_date, fold_id, (a + fold_id) / (a + b + c + fold_id) AS p_up,
       b / (a + b + c + fold_id) AS p_flat, c / (a + b + c + fold_id) AS p_down
FROM abc CROSS JOIN (SELECT 0 AS fold_id UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 4) f"""),
    "price_feed": ((), """
SELECT o_orderkey AS seq, o_orderpriority AS symbol,
       CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 51 = 0 THEN 'junk-date-'
            ELSE CONCAT(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T16:00:00') END AS created,
       CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN 'bad'
            ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS close
FROM orders"""),
    "stored": (("px",), """
SELECT symbol, quote_date, close FROM px WHERE quote_date < DATE '2000-01-01' AND symbol <> '5-LOW'"""),
    "expirations": ((), """
SELECT DISTINCT o_orderpriority AS symbol, CAST(CAST(o_orderdate AS DATE) AS STRING) AS expiration FROM orders"""),
    "bars": ((), """
SELECT o_orderkey AS seq, o_orderpriority AS symbol,
       CASE WHEN o_orderkey % 3 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || ' 16:00:00'
            ELSE strftime(CAST(o_orderdate AS DATE), '%Y%m%d') END AS time,
       o_totalprice / 1000 AS close, CAST(o_custkey AS DOUBLE) AS volume
FROM orders"""),
}


def _collect(names, out):
    for n in names:
        deps, _ = VIEWS[n]
        _collect(deps, out)
        if n not in out:
            out.append(n)
    return out


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named fixture views and their dependencies (+ extra CTEs)."""
    order = _collect(names, [])
    parts = [f"{n} AS ({VIEWS[n][1].strip()})" for n in order]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
