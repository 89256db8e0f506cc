"""Registered queries: one per checkable operator, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the library operator over
the fixture views (built from the full driver tables); ``ORACLE[name]`` is an
independent SQL restatement over the same tables. Doubles are rounded to
6 dp on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import labels, quality
from ..sources import fixtures as fx
from .fixture_sql import with_views
from .output import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _w(part: str = "symbol", order: str = "quote_date", frame: str = "") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} {frame})"


# ---------------------------------------------------------------- labels, quality

_LAB_CTES = f"""
t AS (SELECT symbol, quote_date, close,
        lead(close, 1) {_w()} / close - 1 AS fwd_ret_1d,
        max(close) {_w(frame='ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING')} / close - 1 AS path_fwd_ret_max,
        min(close) {_w(frame='ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING')} / close - 1 AS path_fwd_ret_min
      FROM px),
lab AS (SELECT *, CASE WHEN path_fwd_ret_max >= 0.015 THEN 1 WHEN path_fwd_ret_min <= -0.015 THEN -1 ELSE 0 END AS label
        FROM t WHERE path_fwd_ret_max IS NOT NULL AND path_fwd_ret_min IS NOT NULL)"""
_LABEL_SQL = with_views("px", extra=_LAB_CTES)


@register("w4_path_labels", _LABEL_SQL + """
SELECT symbol, quote_date, close, round(fwd_ret_1d, 6) AS fwd_ret_1d,
       round(path_fwd_ret_max, 6) AS path_fwd_ret_max, round(path_fwd_ret_min, 6) AS path_fwd_ret_min, label
FROM lab""")
def q_path_labels(spark, sf):
    lab = labels.path_labels(fx.px(spark, sf), price_col="close")
    return round_doubles(lab.select("symbol", "quote_date", "close", "fwd_ret_1d",
                                    "path_fwd_ret_max", "path_fwd_ret_min", "label"))


@register("w2_forward_multipliers", with_views("px") + f"""
SELECT symbol, quote_date, round(lead(close, 1) {_w()} / close - 1, 6) AS fwd_ret_1d,
       round(lead(close, 1) {_w()} / close, 6) AS fwd_mult_1d, round(lead(close, 2) {_w()} / close, 6) AS fwd_mult_2d,
       round(lead(close, 3) {_w()} / close, 6) AS fwd_mult_3d, round(lead(close, 4) {_w()} / close, 6) AS fwd_mult_4d,
       round(lead(close, 5) {_w()} / close, 6) AS fwd_mult_5d
FROM px""")
def q_forward_multipliers(spark, sf):
    out = labels.forward_returns(fx.px(spark, sf), price_col="close", multipliers=True)
    return round_doubles(out.drop("close"))


@register("a5_label_distribution", _LABEL_SQL + """
SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM lab GROUP BY label""")
def q_label_distribution(spark, sf):
    from ..operators.signals import class_distribution
    lab = labels.path_labels(fx.px(spark, sf), price_col="close")
    return round_doubles(class_distribution(lab, "label"))


@register("a1_profile_table", with_views("px") + """
SELECT count(*) AS row_count, min(quote_date) AS min_date, max(quote_date) AS max_date,
       count(DISTINCT symbol) AS n_symbols FROM px""")
def q_profile(spark, sf):
    return quality.profile_table(fx.px(spark, sf))


@register("a2_null_profile", with_views("iv_feed") + """
, c AS (SELECT count(*) AS n, CAST(count_if(underlying_price IS NULL) AS BIGINT) AS u, CAST(count_if(right_ IS NULL) AS BIGINT) AS r FROM iv_feed)
SELECT column_name, null_count, round(null_count * 100.0 / n, 6) AS null_pct FROM (
  SELECT 'underlying_price' AS column_name, u AS null_count, n FROM c
  UNION ALL SELECT 'right_', r, n FROM c) WHERE null_count > 0""")
def q_null_profile(spark, sf):
    return round_doubles(quality.null_profile(fx.iv_feed(spark, sf)))


@register("p22_large_gaps", with_views("px") + f"""
SELECT * FROM (SELECT symbol, quote_date, lag(quote_date) {_w()} AS prev_date,
       CAST(quote_date - lag(quote_date) {_w()} AS BIGINT) AS gap_days FROM px) WHERE gap_days > 5""")
def q_large_gaps(spark, sf):
    out = quality.large_gaps(fx.px(spark, sf)).select("symbol", "quote_date", "prev_date", "gap_days")
    return out.withColumn("gap_days", F.col("gap_days").cast("bigint"))


@register("w6_pct_change", with_views("px") + f"""
SELECT symbol, quote_date, round(close / lag(close) {_w()} - 1, 6) AS ret_1d FROM px""")
def q_pct_change(spark, sf):
    return round_doubles(quality.pct_change(fx.px(spark, sf)).select("symbol", "quote_date", "ret_1d"))


# fixture closes move less than 5 % a day, so the check uses 1 %
@register("p21_return_outliers", with_views("px") + f"""
SELECT * FROM (SELECT symbol, quote_date, round(close / lag(close) {_w()} - 1, 6) AS ret_1d FROM px)
WHERE abs(ret_1d) > 0.01""")
def q_return_outliers(spark, sf):
    out = quality.return_outliers(fx.px(spark, sf), threshold=0.01)
    return round_doubles(out.select("symbol", "quote_date", "ret_1d"))


@register("s2_latest_rows", with_views("px") + """
SELECT symbol, max(quote_date) AS quote_date, max_by(close, quote_date) AS close FROM px GROUP BY symbol""")
def q_latest_rows(spark, sf):
    return round_doubles(quality.latest_rows(fx.px(spark, sf)))


@register("a3_last_stored_date", with_views("stored") + """
SELECT symbol, max(quote_date) AS last_date FROM stored GROUP BY symbol""")
def q_last_stored(spark, sf):
    return quality.last_stored_date(fx.stored(spark, sf))


@register("s6_price_history", with_views("px") + """
SELECT quote_date AS date, symbol, close FROM px WHERE symbol = '3-MEDIUM'""")
def q_price_history(spark, sf):
    from ..sources.tables import price_history
    return round_doubles(price_history(fx.px(spark, sf), "3-MEDIUM"))


# ---------------------------------------------------------------- signals and backtest

def _results(spark, sf) -> DataFrame:
    """Backtest input from the ``proba`` fixture: W1 return, M6 class, M7 gate, W9 position."""
    from ..operators import signals
    r = labels.forward_returns(fx.proba(spark, sf), price_col="close")
    r = signals.ensemble_class(r)
    return signals.add_signal_columns(r)


def _bt(spark, sf) -> DataFrame:
    from ..operators import backtest
    return backtest.daily_pnl(_results(spark, sf))


_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_RES_CTES = f"""
bt0 AS (SELECT *, lead(close, 1) {_w()} / close - 1 AS fwd_ret_1d FROM proba),
res AS (SELECT *,
   CASE WHEN proba_down_ens >= proba_flat_ens AND proba_down_ens >= proba_up_ens THEN 0
        WHEN proba_flat_ens >= proba_up_ens THEN 1 ELSE 2 END AS pred_raw_ens,
   CASE WHEN proba_down_ens >= proba_flat_ens AND proba_down_ens >= proba_up_ens THEN -1
        WHEN proba_flat_ens >= proba_up_ens THEN 0 ELSE 1 END AS pred_dir_ens,
   CASE WHEN proba_flat_ens >= proba_up_ens AND proba_flat_ens >= proba_down_ens THEN 0
        WHEN above_sma200 IS DISTINCT FROM 1 THEN 0
        WHEN vol_regime = 0 THEN 0
        WHEN proba_up_ens >= 0.45 AND proba_up_ens >= proba_down_ens THEN 1
        WHEN proba_down_ens >= 0.45 AND proba_down_ens >= proba_up_ens THEN -1
        ELSE 0 END AS signal_dir,
   CASE WHEN proba_flat_ens >= proba_up_ens AND proba_flat_ens >= proba_down_ens THEN 0
        WHEN proba_up_ens >= 0.45 AND proba_up_ens >= proba_down_ens
             THEN CASE WHEN above_sma200 IS NOT NULL AND above_sma200 <> 1 THEN 0
                       WHEN vol_regime = 0 THEN 0 ELSE 1 END
        WHEN proba_down_ens >= 0.45 AND proba_down_ens >= proba_up_ens
             THEN CASE WHEN vol_regime = 0 THEN 0 ELSE -1 END
        ELSE 0 END AS live_signal_dir
   FROM bt0),
pos AS (SELECT *, coalesce(lag(signal_dir, 1) {_w()}, 0) AS position_dir FROM res),
bt AS (SELECT *, position_dir * fwd_ret_1d AS strat_ret FROM pos WHERE fwd_ret_1d IS NOT NULL)"""
_RES_SQL = with_views("proba", extra=_RES_CTES)


def _metrics_sql(src: str, keys: str, win=True, pf=True, dim=True) -> str:
    part = f"PARTITION BY {keys} ORDER BY quote_date {_RUN}"
    cols = [f"{keys}", "count(*) AS n_days",
            "round(arg_max(eq, quote_date) - 1, 6) AS total_return",
            "round(pow(arg_max(eq, quote_date), 252.0 / count(*)) - 1, 6) AS ann_return",
            "round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 6) AS sharpe",
            "round(min(dd), 6) AS max_drawdown"]
    if win:
        cols.append("round(count_if(r > 0) / nullif(count_if(r <> 0), 0), 6) AS win_rate")
    if pf:
        cols.append("round(coalesce(sum(r) FILTER (WHERE r > 0), 0) / "
                    "nullif(abs(coalesce(sum(r) FILTER (WHERE r < 0), 0)), 0), 6) AS profit_factor")
    if dim:
        cols.append("round(avg(CASE WHEN in_market THEN 1.0 ELSE 0.0 END), 6) AS days_in_market")
    return f"""(SELECT {', '.join(cols)} FROM (
  SELECT *, (eq - max(eq) OVER ({part})) / max(eq) OVER ({part}) AS dd FROM (
    SELECT *, product(1 + r) OVER ({part}) AS eq FROM {src}) e1) e2 GROUP BY {keys})"""


@register("m6_ensemble_class", _RES_SQL + "SELECT symbol, quote_date, pred_raw_ens, pred_dir_ens FROM res")
def q_ensemble_class(spark, sf):
    from ..operators import signals
    return signals.ensemble_class(fx.proba(spark, sf)).select("symbol", "quote_date", "pred_raw_ens", "pred_dir_ens")


@register("m7_batch_gate", _RES_SQL + "SELECT symbol, quote_date, signal_dir FROM res")
def q_batch_gate(spark, sf):
    from ..operators import signals
    return signals.signal_gate(fx.proba(spark, sf), mode="batch").select("symbol", "quote_date", "signal_dir")


@register("m8_live_gate", _RES_SQL + "SELECT symbol, quote_date, live_signal_dir AS signal_dir FROM res")
def q_live_gate(spark, sf):
    from ..operators import signals
    return signals.signal_gate(fx.proba(spark, sf), mode="live").select("symbol", "quote_date", "signal_dir")


@register("w9_positions", _RES_SQL + "SELECT symbol, quote_date, signal_dir, position_dir FROM pos")
def q_positions(spark, sf):
    return _results(spark, sf).select("symbol", "quote_date", "signal_dir", "position_dir")


@register("b1_daily_pnl", _RES_SQL + f"""
SELECT symbol, quote_date, round(strat_ret, 6) AS strat_ret,
       round(product(1 + strat_ret) OVER (PARTITION BY symbol ORDER BY quote_date {_RUN}), 6) AS strat_equity,
       round(product(1 + fwd_ret_1d) OVER (PARTITION BY symbol ORDER BY quote_date {_RUN}), 6) AS benchmark_equity
FROM bt""")
def q_daily_pnl(spark, sf):
    return round_doubles(_bt(spark, sf).select("symbol", "quote_date", "strat_ret", "strat_equity", "benchmark_equity"))


@register("b2_performance", _RES_SQL + """,
long AS (SELECT symbol, 'strategy' AS series, quote_date, strat_ret AS r, position_dir <> 0 AS in_market FROM bt
         UNION ALL SELECT symbol, 'benchmark', quote_date, fwd_ret_1d, true FROM bt)
SELECT * FROM """ + _metrics_sql("long", "symbol, series"))
def q_performance(spark, sf):
    from ..operators import backtest
    return round_doubles(backtest.performance(_bt(spark, sf)))


@register("b3_drawdown", _RES_SQL + f""",
e AS (SELECT symbol, quote_date, product(1 + strat_ret) OVER (PARTITION BY symbol ORDER BY quote_date {_RUN}) AS strat_equity FROM bt)
SELECT symbol, quote_date, round(strat_equity, 6) AS strat_equity,
       round(max(strat_equity) OVER (PARTITION BY symbol ORDER BY quote_date {_RUN}), 6) AS running_max,
       round((strat_equity - max(strat_equity) OVER (PARTITION BY symbol ORDER BY quote_date {_RUN}))
             / max(strat_equity) OVER (PARTITION BY symbol ORDER BY quote_date {_RUN}), 6) AS drawdown
FROM e""")
def q_drawdown(spark, sf):
    from ..operators import backtest
    d = backtest.drawdown(_bt(spark, sf), "strat_equity")
    return round_doubles(d.select("symbol", "quote_date", "strat_equity", "running_max", "drawdown"))


_B3_SQL = ORACLE["b3_drawdown"]


@register("b3_drawdown_two_level", _B3_SQL)
def q_drawdown_two_level(spark, sf):
    """Same result from the two-level (per-month buckets) equity and drawdown scans."""
    from ..operators import backtest
    bt = backtest.daily_pnl(_results(spark, sf), bucket="month")
    d = backtest.drawdown(bt, "strat_equity", bucket="month")
    return round_doubles(d.select("symbol", "quote_date", "strat_equity", "running_max", "drawdown"))


@register("b4_filter_impact", _RES_SQL + f""",
raw0 AS (SELECT symbol, quote_date, pred_dir_ens, lag(pred_dir_ens, 1) {_w()} * fwd_ret_1d AS r FROM res),
raw1 AS (SELECT * FROM raw0 WHERE r IS NOT NULL),
long AS (SELECT symbol, 'raw' AS scenario, quote_date, r,
                coalesce(lag(pred_dir_ens, 1) {_w()} <> 0, true) AS in_market FROM raw1
         UNION ALL SELECT symbol, 'filtered', quote_date, strat_ret, position_dir <> 0 FROM bt)
SELECT symbol, scenario, ann_return, sharpe, max_drawdown, days_in_market FROM """
          + _metrics_sql("long", "symbol, scenario", win=False, pf=False))
def q_filter_impact(spark, sf):
    from ..operators import backtest
    res = _results(spark, sf)
    return round_doubles(backtest.filter_impact(res, backtest.daily_pnl(res)))


@register("b5_threshold_sensitivity", _RES_SQL + f""",
thr AS (SELECT CAST(round((6 + i) * 0.05, 2) AS DOUBLE) AS threshold FROM range(10) t(i)),
g AS (SELECT symbol, quote_date, fwd_ret_1d, threshold,
             CASE WHEN greatest(proba_up_ens, proba_down_ens) < threshold THEN 0 ELSE pred_dir_ens END AS gs
      FROM res, thr),
gl AS (SELECT *, lag(gs, 1) OVER (PARTITION BY symbol, threshold ORDER BY quote_date) AS lg FROM g),
cov AS (SELECT symbol, threshold, avg(CASE WHEN coalesce(lg <> 0, true) THEN 1.0 ELSE 0.0 END) AS coverage
        FROM gl GROUP BY symbol, threshold),
long AS (SELECT symbol, threshold, quote_date, lg * fwd_ret_1d AS r FROM gl WHERE lg * fwd_ret_1d IS NOT NULL),
m AS """ + _metrics_sql("long", "symbol, threshold", win=False, pf=False, dim=False) + """
SELECT m.symbol, m.threshold, ann_return, sharpe, max_drawdown, round(coverage, 6) AS coverage
FROM m JOIN cov ON m.symbol = cov.symbol AND m.threshold = cov.threshold""")
def q_threshold_sensitivity(spark, sf):
    from ..operators import backtest
    return round_doubles(backtest.threshold_sensitivity(_results(spark, sf)))


@register("b2_performance_two_level", ORACLE["b2_performance"])
def q_performance_two_level(spark, sf):
    """B2 with per-month windows: no task holds a whole series."""
    from ..operators import backtest
    bt = backtest.daily_pnl(_results(spark, sf), bucket="month")
    return round_doubles(backtest.performance(bt, bucket="month"))


@register("b4_filter_impact_two_level", ORACLE["b4_filter_impact"])
def q_filter_impact_two_level(spark, sf):
    """B4 with per-month windows, the lags too."""
    from ..operators import backtest
    res = _results(spark, sf)
    return round_doubles(backtest.filter_impact(res, backtest.daily_pnl(res, bucket="month"), bucket="month"))


@register("b5_threshold_two_level", ORACLE["b5_threshold_sensitivity"])
def q_threshold_two_level(spark, sf):
    """B5 with per-month windows, the lag too."""
    from ..operators import backtest
    return round_doubles(backtest.threshold_sensitivity(_results(spark, sf), bucket="month"))


# Fixed sub-periods of the fixture calendar (half-open, overlapping like the reference's).
FIXTURE_PERIODS = [
    ("before 1997", None, "1997-01-01"),
    ("1997", "1997-01-01", "1998-01-01"),
    ("1998 to mid 1999", "1998-01-01", "1999-06-01"),
    ("1999", "1999-01-01", "2000-01-01"),
    ("2000 on", "2000-01-01", None),
]


def _periods_sql():
    rows = []
    for n, s, e in FIXTURE_PERIODS:
        sd = f"DATE '{s}'" if s else "CAST(NULL AS DATE)"
        ed = f"DATE '{e}'" if e else "CAST(NULL AS DATE)"
        rows.append(f"SELECT '{n}' AS period, {sd} AS p_start, {ed} AS p_end")
    return " UNION ALL ".join(rows)


@register("b6_sub_periods", _RES_SQL + f""",
per AS ({_periods_sql()}),
long AS (SELECT symbol, period, quote_date, strat_ret AS r FROM bt JOIN per
         ON quote_date >= coalesce(p_start, quote_date) AND (p_end IS NULL OR quote_date < p_end)),
m AS """ + _metrics_sql("long", "symbol, period", win=True, pf=False, dim=False) + """
SELECT symbol, period, n_days, ann_return, sharpe, max_drawdown, win_rate FROM m WHERE n_days >= 20""")
def q_sub_periods(spark, sf):
    from ..operators import backtest
    return round_doubles(backtest.sub_periods(_bt(spark, sf), FIXTURE_PERIODS))


_MONTHLY_SQL = _RES_SQL + """,
mr AS (SELECT symbol, last_day(quote_date) AS month_end, product(1 + strat_ret) - 1 AS ret FROM bt GROUP BY 1, 2),
rng AS (SELECT symbol, min(date_trunc('month', quote_date)) AS lo, max(date_trunc('month', quote_date)) AS hi FROM bt GROUP BY 1),
months AS (SELECT symbol, last_day(CAST(m AS DATE)) AS month_end FROM rng, generate_series(lo, hi, INTERVAL 1 MONTH) g(m)),
monthly AS (SELECT months.symbol, months.month_end, coalesce(mr.ret, 0.0) AS ret
            FROM months LEFT JOIN mr ON months.symbol = mr.symbol AND months.month_end = mr.month_end)
"""


@register("a15_monthly_returns", _MONTHLY_SQL + "SELECT symbol, month_end, round(ret, 6) AS ret FROM monthly")
def q_monthly_returns(spark, sf):
    from ..operators import backtest
    return round_doubles(backtest.monthly_returns(_bt(spark, sf)))


_MN = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@register("a16_monthly_pivot", _MONTHLY_SQL + "SELECT symbol, CAST(year(month_end) AS INTEGER) AS year, "
          + ", ".join(f"round(max(ret) FILTER (WHERE month(month_end) = {i + 1}), 6) AS {m}" for i, m in enumerate(_MN))
          + " FROM monthly GROUP BY 1, 2")
def q_monthly_pivot(spark, sf):
    from ..operators import backtest
    return round_doubles(backtest.monthly_pivot(backtest.monthly_returns(_bt(spark, sf))))


@register("b8_signal_distribution", _RES_SQL + """
SELECT symbol, signal_dir, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol), 6) AS pct
FROM res GROUP BY 1, 2""")
def q_signal_distribution(spark, sf):
    from ..operators import signals
    return round_doubles(signals.class_distribution(_results(spark, sf), "signal_dir", by=["symbol"]))


@register("a6_signal_counts", _RES_SQL + """
SELECT quote_date, CAST(count_if(signal_dir = 1) AS BIGINT) AS buys, CAST(count_if(signal_dir = -1) AS BIGINT) AS sells,
       CAST(count_if(signal_dir = 0) AS BIGINT) AS flats FROM res GROUP BY quote_date""")
def q_signal_counts(spark, sf):
    from ..operators import signals
    return signals.signal_counts(_results(spark, sf), by=["quote_date"])


@register("b9_transaction_costs", _RES_SQL + f"""
SELECT symbol, quote_date, round(strat_ret - abs(position_dir - coalesce(lag(position_dir, 1) {_w()}, 0)) * 0.0005, 6) AS net_ret
FROM bt""")
def q_transaction_costs(spark, sf):
    from ..operators import backtest
    return round_doubles(backtest.transaction_costs(_bt(spark, sf), 0.0005).select("symbol", "quote_date", "net_ret"))


@register("b10_hold_for_horizon", _RES_SQL + f"""
SELECT symbol, quote_date, round(avg(position_dir) {_w(frame='ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')}, 6) AS position_h,
       round(avg(position_dir) {_w(frame='ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} * fwd_ret_1d, 6) AS hold_ret
FROM pos""")
def q_hold_for_horizon(spark, sf):
    from ..operators import backtest
    return round_doubles(backtest.hold_for_horizon(_results(spark, sf)).select("symbol", "quote_date", "position_h", "hold_ret"))


@register("k6_signal_report", _RES_SQL + """
SELECT quote_date AS "Date", symbol AS "Symbol",
       CASE signal_dir WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'FLAT' END AS "Signal",
       round(proba_up_ens, 4) AS "P(Up)", round(proba_flat_ens, 4) AS "P(Flat)", round(proba_down_ens, 4) AS "P(Down)",
       above_sma200 AS "Above SMA200", vol_regime AS "Vol Regime"
FROM res""")
def q_signal_report(spark, sf):
    from ..operators import signals
    r = _results(spark, sf).select("quote_date", "symbol", "signal_dir", "proba_up_ens", "proba_flat_ens",
                                   "proba_down_ens", "above_sma200", "vol_regime")
    return signals.signal_report(r)


@register("p19_day_signals", _RES_SQL + """
SELECT symbol, quote_date, signal_dir, round(proba_up_ens, 6) AS proba_up_ens FROM res WHERE quote_date = DATE '1998-03-02'""")
def q_day_signals(spark, sf):
    from ..operators import signals
    d = signals.day_signals(_results(spark, sf), "1998-03-02")
    return round_doubles(d.select("symbol", "quote_date", "signal_dir", "proba_up_ens"))


@register("a24_ensemble_average", with_views("members", extra="""
wt AS (SELECT fold_id, pow(0.7, count(*) OVER () - row_number() OVER (ORDER BY fold_id)) AS raw
       FROM (SELECT DISTINCT fold_id FROM members) f),
w AS (SELECT fold_id, raw / sum(raw) OVER () AS weight FROM wt)""") + """
SELECT symbol, quote_date,
       round(sum(weight * p_down) / sum(weight), 6) AS proba_down_ens,
       round(sum(weight * p_flat) / sum(weight), 6) AS proba_flat_ens,
       round(sum(weight * p_up) / sum(weight), 6) AS proba_up_ens
FROM members JOIN w USING (fold_id) GROUP BY symbol, quote_date""")
def q_ensemble_average(spark, sf):
    from ..operators import signals
    m = fx.members(spark, sf)
    w = signals.fold_weights(m.select("fold_id").distinct())
    return round_doubles(signals.ensemble_average(m, w, ["symbol", "quote_date"]))


@register("w11_fold_weights", with_views("members", extra="""
wt AS (SELECT fold_id, pow(0.7, count(*) OVER () - row_number() OVER (ORDER BY fold_id)) AS raw
       FROM (SELECT DISTINCT fold_id FROM members) f)""") + """
SELECT fold_id, round(raw / sum(raw) OVER (), 6) AS weight FROM wt""")
def q_fold_weights(spark, sf):
    from ..operators import signals
    return round_doubles(signals.fold_weights(fx.members(spark, sf).select("fold_id").distinct()))


# ---------------------------------------------------------------- chain ingest

def _merged(spark, sf) -> DataFrame:
    from ..operators import chain
    lg = fx.legs(spark, sf)
    return chain.merge_feeds(fx.iv_feed(spark, sf, lg), fx.oi_feed(spark, sf, lg), fx.ohlc_feed(spark, sf, lg))


_KEYS_ND = " AND ".join(f"i.{k} IS NOT DISTINCT FROM {{a}}.{k}" for k in
                        ("symbol", "trade_date", "expiration", "strike", "right_"))
_MERGE_SQL = with_views("iv_feed", "oi_feed", "ohlc_feed", extra=f"""
oi_d AS (SELECT * EXCLUDE (rn) FROM (SELECT symbol, trade_date, expiration, strike, right_, open_interest,
           row_number() OVER (PARTITION BY symbol, trade_date, expiration, strike, right_
                              ORDER BY seq DESC, open_interest DESC) AS rn FROM oi_feed) WHERE rn = 1),
oh_d AS (SELECT * EXCLUDE (rn) FROM (SELECT symbol, trade_date, expiration, strike, right_, close, volume,
           row_number() OVER (PARTITION BY symbol, trade_date, expiration, strike, right_
                              ORDER BY seq DESC, close DESC, volume DESC) AS rn FROM ohlc_feed) WHERE rn = 1),
merged AS (SELECT i.*, o.open_interest, h.close, h.volume FROM iv_feed i
           LEFT JOIN oi_d o ON {_KEYS_ND.format(a='o')}
           LEFT JOIN oh_d h ON {_KEYS_ND.format(a='h')}),
spot AS (SELECT symbol, trade_date, expiration, arg_min(underlying_price, seq) AS und_price FROM iv_feed
         WHERE underlying_price IS NOT NULL AND underlying_price <> 0 GROUP BY 1, 2, 3),
banded AS (SELECT m.*, s.und_price FROM merged m LEFT JOIN spot s USING (symbol, trade_date, expiration)
           WHERE s.und_price IS NULL OR TRY_CAST(m.strike AS DOUBLE) BETWEEN s.und_price * 0.8 AND s.und_price * 1.2),
parsed AS (SELECT *, TRY_CAST(NULLIF(bid, '') AS DOUBLE) AS b_, TRY_CAST(NULLIF(ask, '') AS DOUBLE) AS a_ FROM banded),
rows_ AS (SELECT trade_date, CAST(NULL AS VARCHAR) AS "Timestamp", symbol AS "Symbol",
        CAST(TRY_CAST(expiration AS DATE) AS VARCHAR) AS "Expiry", TRY_CAST(strike AS DOUBLE) AS "Strike",
        CASE WHEN right_ = 'CALL' THEN 'C' WHEN right_ = 'PUT' THEN 'P' ELSE right_ END AS righttype,
        round((b_ + a_) / 2, 4) AS "Price", TRY_CAST(NULLIF(close, '') AS DOUBLE) AS "Last",
        TRY_CAST(NULLIF(close, '') AS DOUBLE) AS "Close", b_ AS "Bid", a_ AS "Ask",
        TRY_CAST(NULLIF(volume, '') AS DOUBLE) AS "Volume", TRY_CAST(NULLIF(open_interest, '') AS DOUBLE) AS "OpenInterest",
        TRY_CAST(NULLIF(implied_vol, '') AS DOUBLE) AS "IV", CAST(NULL AS DOUBLE) AS "Delta", CAST(NULL AS DOUBLE) AS "Gamma",
        CAST(NULL AS DOUBLE) AS "Theta", CAST(NULL AS DOUBLE) AS "Vega", underlying_price AS "UndPrice"
      FROM parsed WHERE b_ IS NOT NULL AND a_ IS NOT NULL AND round((b_ + a_) / 2, 4) > 0)""")


@register("j1_chain_merge", _MERGE_SQL + "SELECT * FROM merged")
def q_chain_merge(spark, sf):
    return _merged(spark, sf)


@register("d1_keep_last_open_interest", _MERGE_SQL + "SELECT * FROM oi_d")
def q_keep_last(spark, sf):
    from ..operators import chain
    oi = fx.oi_feed(spark, sf)
    keys = ["symbol", "trade_date", "expiration", "strike", "right_"]
    return chain.dedupe_last(oi, keys).drop("seq")


@register("d3_first_underlying", _MERGE_SQL + "SELECT * FROM spot")
def q_first_underlying(spark, sf):
    from ..operators import chain
    return chain.first_underlying(fx.iv_feed(spark, sf))


def _snapshot(spark, sf) -> DataFrame:
    from ..operators import chain
    lg = fx.legs(spark, sf)
    return chain.chain_snapshot(fx.iv_feed(spark, sf, lg), fx.oi_feed(spark, sf, lg), fx.ohlc_feed(spark, sf, lg))


@register("p2_chain_rows", _MERGE_SQL + "SELECT * FROM rows_")
def q_chain_rows(spark, sf):
    return _snapshot(spark, sf)


@register("p4_band_after_merge", _MERGE_SQL + "SELECT * FROM rows_")
def q_band_after_merge(spark, sf):
    """Same rows when the band is applied to the merged frame (the reference's order)."""
    from ..operators import chain
    return chain.build_chain_rows(_merged(spark, sf))


@register("a4_daily_open_interest", _MERGE_SQL + """
SELECT CAST(trade_date AS DATE) AS snap_date, round(sum("OpenInterest"), 6) AS total_oi FROM rows_
WHERE "Symbol" = '1-URGENT' GROUP BY 1""")
def q_daily_open_interest(spark, sf):
    from ..operators import chain
    return round_doubles(chain.daily_open_interest(_snapshot(spark, sf), "1-URGENT"))


@register("p1_conform", _MERGE_SQL + """
SELECT trade_date, "Timestamp", "Symbol", "Expiry", "Strike", righttype, "Price", "Last", "Close", "Bid", "Ask",
       "Volume", "OpenInterest", "IV", "Delta", "Gamma", "Theta", "Vega", "UndPrice" FROM rows_""")
def q_conform(spark, sf):
    from ..operators import chain
    rows = _snapshot(spark, sf)
    # shuffle the column order and drop two columns: conform restores the fixed schema
    return chain.conform(rows.select(*reversed([c for c in rows.columns if c not in ("Theta", "Vega")])))


_TF = "(CAST(date_trunc('month', {d}) AS DATE) + CAST((5 - isodow(date_trunc('month', {d})) + 7) % 7 + 14 AS INTEGER))"


@register("t1_monthly_expiries", with_views("expirations") + f"""
, e AS (SELECT symbol, TRY_CAST(expiration AS DATE) AS expiry FROM expirations WHERE expiration >= '1998-01-15'),
e2 AS (SELECT *, datediff('month', DATE '1998-01-01', date_trunc('month', expiry)) AS mo,
              abs(datediff('day', CAST({_TF.format(d='expiry')} AS DATE), expiry)) AS dist FROM e WHERE expiry IS NOT NULL),
best AS (SELECT symbol, mo, expiry, row_number() OVER (PARTITION BY symbol, mo ORDER BY dist, expiry) AS rk
         FROM e2 WHERE mo >= 0 AND mo < 18),
sel AS (SELECT symbol, expiry, row_number() OVER (PARTITION BY symbol ORDER BY expiry) AS rk2 FROM best WHERE rk = 1)
SELECT symbol, expiry FROM sel WHERE rk2 <= 10""")
def q_monthly_expiries(spark, sf):
    from ..operators import chain
    return chain.monthly_expiries(fx.expirations(spark, sf), "1998-01-15")


@register("p5_third_friday", with_views("expirations") + f"""
SELECT DISTINCT CAST(date_trunc('month', TRY_CAST(expiration AS DATE)) AS DATE) AS month_start,
       CAST({_TF.format(d='TRY_CAST(expiration AS DATE)')} AS DATE) AS third_friday FROM expirations""")
def q_third_friday(spark, sf):
    from ..functions.columns import third_friday
    e = fx.expirations(spark, sf).select(F.to_date("expiration").alias("d"))
    return e.select(F.trunc("d", "MM").alias("month_start"), third_friday("d").alias("third_friday")).distinct()


@register("t2_expiry_calendar", with_views("und") + f"""
, d AS (SELECT DISTINCT trade_date AS as_of FROM und),
m AS (SELECT as_of, CAST(date_trunc('month', as_of) + INTERVAL (i) MONTH AS DATE) AS mstart FROM d, range(12) t(i)),
f AS (SELECT as_of, CAST({_TF.format(d='mstart')} AS DATE) AS tf FROM m)
SELECT as_of, strftime(tf, '%Y%m%d') AS expiry FROM f WHERE tf > as_of""")
def q_expiry_calendar(spark, sf):
    from ..operators import chain
    d = fx.und(spark, sf).select(F.col("trade_date").alias("as_of")).distinct()
    return chain.expiry_calendar(d)


@register("t6_band_strikes", with_views("chain", "und") + """
SELECT DISTINCT c.symbol, c.trade_date, c.expiry, c.right_, c.strike FROM chain c JOIN und u
  ON c.symbol = u.symbol AND c.trade_date = u.trade_date
WHERE c.strike BETWEEN u.und_price * 0.5 AND u.und_price * 1.5""")
def q_band_strikes(spark, sf):
    from ..operators import chain
    return chain.band_strikes(fx.chain(spark, sf), fx.und(spark, sf))


_TICK_FIELDS = ["Bid", "Ask", "Last", "Close", "T99"]
_TICKS_SQL = with_views("ticks", extra="""
named AS (SELECT *, CASE tick_type WHEN 1 THEN 'Bid' WHEN 2 THEN 'Ask' WHEN 4 THEN 'Last' WHEN 6 THEN 'High'
                  WHEN 7 THEN 'Low' WHEN 9 THEN 'Close' WHEN 14 THEN 'Open' WHEN 8 THEN 'Volume'
                  WHEN 27 THEN 'CallOpenInterest' WHEN 28 THEN 'PutOpenInterest' WHEN 78 THEN 'OpenInterest'
                  ELSE 'T' || CAST(tick_type AS VARCHAR) END AS field FROM ticks),
lastv AS (SELECT req_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY req_id, field
          ORDER BY ts DESC, seq DESC) AS rn FROM named) WHERE rn = 1),
wide AS (SELECT req_id, max(value) FILTER (WHERE field = 'Bid') AS "Bid", max(value) FILTER (WHERE field = 'Ask') AS "Ask",
                max(value) FILTER (WHERE field = 'Last') AS "Last", max(value) FILTER (WHERE field = 'Close') AS "Close",
                max(value) FILTER (WHERE field = 'T99') AS "T99" FROM lastv GROUP BY req_id)""")


@register("d4_latest_ticks", _TICKS_SQL + "SELECT * FROM wide")
def q_latest_ticks(spark, sf):
    from ..operators import chain
    return chain.latest_ticks(fx.ticks(spark, sf), _TICK_FIELDS)


@register("s8_tick_names", _TICKS_SQL + "SELECT field, count(*) AS n FROM named GROUP BY field")
def q_tick_names(spark, sf):
    from ..operators import chain
    return chain.tick_names(fx.ticks(spark, sf)).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


_TICK_WIDE = ["Last", "Close", "Bid", "Ask", "Volume", "CallOpenInterest", "PutOpenInterest", "Model_OptPrice",
              "Model_IV", "Model_Delta", "Model_Gamma", "Model_Theta", "Model_Vega", "Model_UndPrice"]
_FEED_WIDE_SQL = with_views("tick_rows", "contracts", extra="""
lastv AS (SELECT req_id, field, arg_max(value, (ts, seq)) AS value FROM tick_rows GROUP BY 1, 2),
wide AS (SELECT req_id, """ + ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS \"{f}\"" for f in _TICK_WIDE) + """ FROM lastv GROUP BY req_id),
priced AS (SELECT *, coalesce(CASE WHEN "Last" > 0 THEN "Last" END, CASE WHEN "Close" > 0 THEN "Close" END,
                             CASE WHEN "Model_OptPrice" > 0 THEN "Model_OptPrice" END) AS price,
                  coalesce(nullif("Last", 0), nullif("Close", 0), nullif("Bid", 0), nullif("Ask", 0)) AS s FROM wide)""")


def _feed_wide(spark, sf):
    from ..operators import chain
    return chain.latest_ticks(chain.tick_fields(fx.tick_feed(spark, sf)), _TICK_WIDE)


@register("p10_contract_prices", _FEED_WIDE_SQL + """
SELECT req_id, price, CASE WHEN s > 0 THEN s END AS spot FROM priced WHERE price IS NOT NULL""")
def q_contract_prices(spark, sf):
    from ..operators import chain
    return chain.contract_prices(_feed_wide(spark, sf)).select("req_id", "price", "spot")


@register("s8_tick_fields_by_kind", with_views("tick_rows") + """
SELECT field, count(*) AS n, count(value) AS n_values, round(sum(value), 4) AS total FROM tick_rows GROUP BY field""")
def q_tick_fields(spark, sf):
    from ..operators import chain
    f = chain.tick_fields(fx.tick_feed(spark, sf)).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"))
    return round_doubles(f, 4)


@register("p12_tick_chain_rows", _FEED_WIDE_SQL + """
SELECT DATE '2024-06-03' AS trade_date, CAST(NULL AS VARCHAR) AS "Timestamp", symbol AS "Symbol", expiry AS "Expiry", strike AS "Strike", right_ AS righttype,
       price AS "Price", "Last", "Close", "Bid", "Ask", "Volume", CASE WHEN right_ = 'C' THEN "CallOpenInterest" ELSE "PutOpenInterest" END AS "OpenInterest",
       "Model_IV" AS "IV", "Model_Delta" AS "Delta", "Model_Gamma" AS "Gamma", "Model_Theta" AS "Theta", "Model_Vega" AS "Vega", "Model_UndPrice" AS "UndPrice"
FROM contracts JOIN priced USING (req_id) WHERE price IS NOT NULL""")
def q_tick_chain_rows(spark, sf):
    from ..operators import chain
    return chain.tick_chain_rows(fx.contracts(spark, sf), _feed_wide(spark, sf), "2024-06-03")


@register("p6_trade_date_cutoff", with_views("ticks") + """
SELECT seq, CAST(ts - INTERVAL 7 HOUR AS DATE) AS trade_date FROM ticks""")
def q_trade_date_cutoff(spark, sf):
    from ..functions.columns import trade_date_by_cutoff
    return fx.ticks(spark, sf).select("seq", trade_date_by_cutoff("ts", 7).alias("trade_date"))


@register("p8_d2_daily_bars", with_views("bars") + """
, p AS (SELECT *, TRY_STRPTIME(split_part(time, ' ', 1), '%Y%m%d')::DATE AS quote_date FROM bars)
SELECT symbol, quote_date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, quote_date
       ORDER BY seq, time, close, volume) AS rn FROM p WHERE quote_date IS NOT NULL) WHERE rn = 1""")
def q_daily_bars(spark, sf):
    from ..operators import chain
    return chain.daily_bars(fx.bars(spark, sf))


_FEED_SQL = with_views("price_feed", "stored", extra="""
parsed AS (SELECT seq, symbol, TRY_CAST(substr(created, 1, 10) AS DATE) AS quote_date,
                  TRY_CAST(NULLIF(close, '') AS DOUBLE) AS close FROM price_feed),
ok AS (SELECT * FROM parsed WHERE quote_date IS NOT NULL AND close IS NOT NULL),
last AS (SELECT symbol, max(quote_date) AS last_date FROM stored GROUP BY symbol),
slice AS (SELECT ok.* FROM ok LEFT JOIN last USING (symbol)
          WHERE quote_date > coalesce(last_date, DATE '2001-06-30' - 1096) AND quote_date <= DATE '2001-06-30'),
dedup AS (SELECT symbol, quote_date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, quote_date
          ORDER BY seq DESC, close DESC) AS rn FROM slice) WHERE rn = 1)""")


@register("p7_parse_price_feed", _FEED_SQL + "SELECT seq, symbol, quote_date, close FROM ok WHERE quote_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def q_parse_price_feed(spark, sf):
    from ..sources import sinks
    p = sinks.parse_price_feed(fx.price_feed(spark, sf), "1996-01-01", "1999-12-31")
    return p.select("seq", "symbol", "quote_date", "close")


@register("j6_incremental_slice", _FEED_SQL + "SELECT seq, symbol, quote_date, close FROM slice")
def q_incremental_slice(spark, sf):
    from ..sources import sinks
    p = sinks.parse_price_feed(fx.price_feed(spark, sf))
    return sinks.incremental_slice(p, fx.stored(spark, sf), "2001-06-30").select("seq", "symbol", "quote_date", "close")


@register("k2_upsert", _FEED_SQL + """
SELECT s.symbol, s.quote_date, s.close FROM stored s ANTI JOIN dedup d ON s.symbol = d.symbol AND s.quote_date = d.quote_date
UNION ALL SELECT symbol, quote_date, close FROM dedup""")
def q_upsert(spark, sf):
    from ..sources import sinks
    p = sinks.parse_price_feed(fx.price_feed(spark, sf))
    batch = sinks.incremental_slice(p, fx.stored(spark, sf), "2001-06-30").select("seq", "symbol", "quote_date", "close")
    return sinks.upsert(fx.stored(spark, sf), batch, ["symbol", "quote_date"])


@register("k3_replace_range", with_views("stored", "bars", extra="""
p AS (SELECT *, TRY_STRPTIME(split_part(time, ' ', 1), '%Y%m%d')::DATE AS quote_date FROM bars),
b AS (SELECT symbol, quote_date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, quote_date
       ORDER BY seq, time, close, volume) AS rn FROM p WHERE quote_date IS NOT NULL) WHERE rn = 1
       AND symbol IN ('1-URGENT', '4-NOT SPECIFIED') AND quote_date BETWEEN DATE '1998-06-01' AND DATE '1998-09-30'
       AND day(quote_date) % 3 <> 0)""") + """
SELECT symbol, quote_date, close FROM stored
WHERE NOT (quote_date BETWEEN (SELECT min(quote_date) FROM b) AND (SELECT max(quote_date) FROM b)
           AND symbol IN (SELECT symbol FROM b))
UNION ALL SELECT symbol, quote_date, close FROM b""")
def q_replace_range(spark, sf):
    from ..operators import chain
    from ..sources import sinks
    b = chain.daily_bars(fx.bars(spark, sf))
    b = b.filter(F.col("symbol").isin("1-URGENT", "4-NOT SPECIFIED")
                 & F.col("quote_date").between(F.lit("1998-06-01").cast("date"), F.lit("1998-09-30").cast("date"))
                 & (F.dayofmonth("quote_date") % 3 != 0))
    return sinks.replace_range(fx.stored(spark, sf), b)


# ---------------------------------------------------------------- features

def _sql_greeks() -> str:
    t = "(CAST(dte AS DOUBLE) / 365)"
    d1 = f"((ln(und_price / strike) + 0.5 * iv * iv * {t}) / (iv * sqrt({t})))"
    pdf = "(exp(-0.5 * d1 * d1) / sqrt(2 * pi()))"
    tt = "(1.0 / (1.0 + 0.2316419 * abs(d1)))"
    poly = (f"({tt} * (0.319381530 + {tt} * (-0.356563782 + {tt} * (1.781477937 + {tt} * "
            f"(-1.821255978 + {tt} * 1.330274429)))))")
    up = f"(1.0 - exp(-0.5 * abs(d1) * abs(d1)) / sqrt(2 * pi()) * {poly})"
    cdf = f"(CASE WHEN d1 >= 0 THEN {up} ELSE 1.0 - {up} END)"
    ok = "und_price > 0 AND strike > 0 AND iv > 0 AND dte > 0"
    return f"""g0 AS (SELECT *, {d1} AS d1 FROM c),
g AS (SELECT *, CASE WHEN {ok} THEN {pdf} / (und_price * iv * sqrt({t})) END AS gamma,
             CASE WHEN {ok} THEN (CASE WHEN right_ = 'C' THEN {cdf} ELSE {cdf} - 1.0 END) END AS delta FROM g0)"""


_FEAT_SQL = with_views("chain", "und", extra=f"""
ex AS (SELECT DISTINCT symbol, trade_date, expiry FROM chain),
ex2 AS (SELECT *, CAST(expiry - trade_date AS INTEGER) AS dte,
               dense_rank() OVER (PARTITION BY symbol, trade_date ORDER BY expiry) AS exp_rank
        FROM ex WHERE expiry - trade_date >= 0),
c AS (SELECT ch.*, e.dte, e.exp_rank, u.und_price FROM chain ch JOIN ex2 e USING (symbol, trade_date, expiry)
      JOIN und u USING (symbol, trade_date) WHERE e.exp_rank <= 2),
{_sql_greeks()},
base AS (SELECT symbol, trade_date, any_value(und_price) AS S,
   sum(oi) FILTER (WHERE exp_rank = 1 AND right_ = 'P') / sum(oi) FILTER (WHERE exp_rank = 1 AND right_ = 'C') AS pc_ratio_front,
   sum(oi) FILTER (WHERE exp_rank = 2 AND right_ = 'P') / sum(oi) FILTER (WHERE exp_rank = 2 AND right_ = 'C') AS pc_ratio_back,
   sum(gamma * oi * 100 * und_price * CASE WHEN right_ = 'C' THEN 1.0 ELSE -1.0 END) FILTER (WHERE exp_rank = 1) AS net_gex,
   sum(gamma * oi * 100 * und_price * CASE WHEN right_ = 'C' THEN 1.0 ELSE -1.0 END) FILTER (WHERE exp_rank = 2) AS net_gex_back,
   min(dte) FILTER (WHERE exp_rank = 1) AS dte_front
   FROM g GROUP BY 1, 2),
wall AS (SELECT symbol, trade_date, right_, strike FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, right_
           ORDER BY oi DESC, abs(strike - und_price), strike) AS rn FROM g WHERE exp_rank = 1) WHERE rn = 1),
skew AS (SELECT symbol, trade_date, right_, iv FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, right_
           ORDER BY abs(abs(delta) - 0.25), strike) AS rn FROM g WHERE exp_rank = 1 AND delta IS NOT NULL) WHERE rn = 1),
st AS (SELECT symbol, trade_date, strike, any_value(und_price) AS S,
         sum(oi) FILTER (WHERE right_ = 'C') AS call_oi, sum(oi) FILTER (WHERE right_ = 'P') AS put_oi,
         sum(oi) AS oi, sum(iv) AS iv_sum, count(iv) AS iv_n FROM g WHERE exp_rank = 1 GROUP BY 1, 2, 3),
conc AS (SELECT symbol, trade_date, sum(oi * oi) / pow(sum(oi), 2) AS oi_concentration FROM st GROUP BY 1, 2),
atm AS (SELECT symbol, trade_date, iv_sum / iv_n AS atm_iv FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date
           ORDER BY abs(strike - S), strike) AS rn FROM st) WHERE rn = 1),
pain AS (SELECT a.symbol, a.trade_date, a.strike AS k,
           sum(coalesce(b.call_oi, 0) * greatest(a.strike - b.strike, 0) + coalesce(b.put_oi, 0) * greatest(b.strike - a.strike, 0)) AS pain
         FROM st a JOIN st b ON a.symbol = b.symbol AND a.trade_date = b.trade_date GROUP BY 1, 2, 3),
mp AS (SELECT symbol, trade_date, k AS mp_k FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY pain, k) AS rn
       FROM pain) WHERE rn = 1),
feat AS (SELECT b.symbol, b.trade_date, b.pc_ratio_front, b.pc_ratio_back,
   (wc.strike - b.S) / b.S AS call_wall_dist_pct, (wp.strike - b.S) / b.S AS put_wall_dist_pct,
   (wc.strike - b.S) / b.S - (wp.strike - b.S) / b.S AS wall_spread_pct,
   b.net_gex, b.net_gex_back, CASE WHEN b.net_gex IS NULL THEN NULL WHEN b.net_gex < 0 THEN 1 ELSE 0 END AS gex_flip,
   (mp.mp_k - b.S) / b.S AS max_pain_dist_pct, atm.atm_iv, sp.iv - sc.iv AS iv_skew, conc.oi_concentration, b.dte_front
 FROM base b
 LEFT JOIN wall wc ON wc.symbol = b.symbol AND wc.trade_date = b.trade_date AND wc.right_ = 'C'
 LEFT JOIN wall wp ON wp.symbol = b.symbol AND wp.trade_date = b.trade_date AND wp.right_ = 'P'
 LEFT JOIN skew sc ON sc.symbol = b.symbol AND sc.trade_date = b.trade_date AND sc.right_ = 'C'
 LEFT JOIN skew sp ON sp.symbol = b.symbol AND sp.trade_date = b.trade_date AND sp.right_ = 'P'
 LEFT JOIN conc ON conc.symbol = b.symbol AND conc.trade_date = b.trade_date
 LEFT JOIN atm ON atm.symbol = b.symbol AND atm.trade_date = b.trade_date
 LEFT JOIN mp ON mp.symbol = b.symbol AND mp.trade_date = b.trade_date)""")

_CF = ["pc_ratio_front", "pc_ratio_back", "call_wall_dist_pct", "put_wall_dist_pct", "wall_spread_pct",
       "net_gex", "net_gex_back", "gex_flip", "max_pain_dist_pct", "atm_iv", "iv_skew", "oi_concentration",
       "dte_front"]
_GEX2 = {"net_gex": 2, "net_gex_back": 2}


def _feat_select(cols):
    out = []
    for c in cols:
        if c in ("gex_flip", "dte_front", "symbol", "trade_date"):
            out.append(c)
        else:
            out.append(f"round({c}, {_GEX2.get(c, 6)}) AS {c}")
    return ", ".join(out)


@register("f1_f13_chain_features", _FEAT_SQL + f"SELECT {_feat_select(['symbol', 'trade_date'] + _CF)} FROM feat")
def q_chain_features(spark, sf):
    from ..operators import features
    out = features.chain_features(fx.chain(spark, sf), fx.und(spark, sf))
    return round_doubles(out, overrides=_GEX2)


@register("f7_max_pain", _FEAT_SQL + "SELECT symbol, trade_date, mp_k AS max_pain_strike FROM mp")
def q_max_pain(spark, sf):
    from ..operators import features
    c = features.prepared_chain(fx.chain(spark, sf), fx.und(spark, sf)).filter(F.col("exp_rank") == 1)
    return features.max_pain(features._strike_table(c))


@register("f0_expiry_rank", _FEAT_SQL + "SELECT symbol, trade_date, expiry, dte, CAST(exp_rank AS INTEGER) AS exp_rank FROM ex2")
def q_expiry_rank(spark, sf):
    from ..operators import features
    return features.expiry_ranks(fx.chain(spark, sf))


@register("f23_greeks", _FEAT_SQL + """
SELECT symbol, trade_date, expiry, strike, right_, round(gamma, 6) AS gamma, round(delta, 6) AS delta FROM g""")
def q_greeks(spark, sf):
    from ..operators import features
    g = features.prepared_chain(fx.chain(spark, sf), fx.und(spark, sf))
    return round_doubles(g.select("symbol", "trade_date", "expiry", "strike", "right_", "gamma", "delta"))


def _price_feat_sql(src: str, price: str) -> str:
    def ov(frame=""):
        return f"OVER (PARTITION BY symbol ORDER BY quote_date {frame})"
    return f"""pf0 AS (SELECT symbol, quote_date, {price} AS p, row_number() {ov()} AS rn,
     {price} / lag({price}, 1) {ov()} - 1 AS daily_ret, {price} / lag({price}, 20) {ov()} - 1 AS ret_20d,
     {price} / lag({price}, 60) {ov()} - 1 AS ret_60d, avg({price}) {ov('ROWS BETWEEN 199 PRECEDING AND CURRENT ROW')} AS sma
   FROM {src}),
pf1 AS (SELECT *, CASE WHEN rn >= 200 THEN sma END AS sma_200,
     CASE WHEN count(daily_ret) {ov('ROWS BETWEEN 19 PRECEDING AND CURRENT ROW')} = 20
          THEN stddev_samp(daily_ret) {ov('ROWS BETWEEN 19 PRECEDING AND CURRENT ROW')} END AS vol_20d,
     CASE WHEN count(daily_ret) {ov('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} = 5
          THEN stddev_samp(daily_ret) {ov('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} END AS vol_5d FROM pf0),
pf AS (SELECT symbol, quote_date, sma_200,
     CASE WHEN sma_200 IS NULL THEN NULL WHEN p > sma_200 THEN 1 ELSE 0 END AS above_sma200,
     ret_20d, ret_60d, vol_20d, daily_ret, vol_5d,
     CASE WHEN vol_20d IS NULL THEN NULL
          WHEN vol_20d > 2 * avg(vol_20d) {ov('ROWS BETWEEN 251 PRECEDING AND CURRENT ROW')} THEN 0 ELSE 1 END AS vol_regime
   FROM pf1)"""


_PF = ["sma_200", "above_sma200", "ret_20d", "ret_60d", "vol_20d", "daily_ret", "vol_5d", "vol_regime"]


# sma_200 averages 200 seven-decimal closes: exact decimal ties at 6 dp are common and the engines
# round ties differently, so it is compared at 4 dp on both sides
_SMA4 = {"sma_200": 4}


def _pf_select(prefix=""):
    return ", ".join(c if c in ("above_sma200", "vol_regime") else
                     f"round({prefix}{c}, {_SMA4.get(c, 6)}) AS {c}" for c in _PF)


@register("f14_f21_price_features", with_views("px", extra=_price_feat_sql("px", "close"))
          + f"SELECT symbol, quote_date, {_pf_select()} FROM pf")
def q_price_features(spark, sf):
    from ..operators import features
    out = features.price_features(fx.px(spark, sf))
    return round_doubles(out.select("symbol", "quote_date", *_PF), overrides=_SMA4)


@register("f22_history_gate", with_views("stored") + """
SELECT symbol, quote_date FROM stored WHERE symbol IN (SELECT symbol FROM stored GROUP BY symbol HAVING count(*) >= 270)""")
def q_history_gate(spark, sf):
    from ..operators import features
    return features.history_gate(fx.stored(spark, sf)).select("symbol", "quote_date")


_FT_SQL = _FEAT_SQL.rstrip() + ",\nusrc AS (SELECT symbol, trade_date AS quote_date, und_price FROM und),\n" + \
    _price_feat_sql("usrc", "und_price") + "\n"


@register("s1_feature_table", _FT_SQL + f"""
SELECT f.symbol, f.trade_date AS quote_date, u.und_price, {_feat_select(_CF).replace('round(', 'round(f.')},
       {_pf_select('pf.')}
FROM feat f JOIN und u ON f.symbol = u.symbol AND f.trade_date = u.trade_date
JOIN pf ON pf.symbol = f.symbol AND pf.quote_date = f.trade_date""")
def q_feature_table(spark, sf):
    from ..operators import features
    return round_doubles(features.feature_table(fx.chain(spark, sf), fx.und(spark, sf)), overrides={**_GEX2, **_SMA4},
                         skip=("und_price",))


# ---------------------------------------------------------------- walk-forward preparation

_ALLF = _CF + _PF
_ROUND_ML = {**_GEX2, **_SMA4}


def _r(c, prefix=""):
    return f"round({prefix}{c}, {_ROUND_ML.get(c, 6)})"


_ML_SQL = _FT_SQL.rstrip() + ",\n" + f"""ftab AS (SELECT f.symbol, f.trade_date AS quote_date, u.und_price,
   {', '.join(f'CAST(f.{c} AS DOUBLE) AS {c}' for c in _CF)}, {', '.join(f'CAST(pf.{c} AS DOUBLE) AS {c}' for c in _PF)}
   FROM feat f JOIN und u ON f.symbol = u.symbol AND f.trade_date = u.trade_date
   JOIN pf ON pf.symbol = f.symbol AND pf.quote_date = f.trade_date),
flab AS (SELECT *, lead(und_price, 1) {_w()} / und_price - 1 AS fwd_ret_1d,
   max(und_price) {_w(frame='ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING')} / und_price - 1 AS pmax,
   min(und_price) {_w(frame='ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING')} / und_price - 1 AS pmin FROM ftab),
flab2 AS (SELECT *, CASE WHEN pmax >= 0.015 THEN 1 WHEN pmin <= -0.015 THEN -1 ELSE 0 END AS label
          FROM flab WHERE pmax IS NOT NULL AND pmin IS NOT NULL),
ml AS (SELECT symbol, quote_date, {', '.join(f'coalesce({c}, median({c}) OVER (PARTITION BY symbol)) AS {c}' for c in _ALLF)},
   label, fwd_ret_1d, label + 1 AS y FROM flab2),
mi AS (SELECT symbol, ym, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ym) - 1 AS INTEGER) AS m_idx
       FROM (SELECT DISTINCT symbol, CAST(date_trunc('month', quote_date) AS DATE) AS ym FROM ml)),
mc AS (SELECT symbol, count(*) AS n_months FROM mi GROUP BY 1),
fp AS (SELECT symbol, unnest(range(0, CAST(floor((n_months - 36) / 3) AS BIGINT))) AS fold_id FROM mc WHERE n_months >= 39),
mlm AS (SELECT ml.*, mi.m_idx FROM ml JOIN mi ON ml.symbol = mi.symbol AND CAST(date_trunc('month', ml.quote_date) AS DATE) = mi.ym),
asg AS (SELECT m.*, CAST(f.fold_id AS INTEGER) AS fold_id, 'train' AS role FROM mlm m JOIN fp f
          ON m.symbol = f.symbol AND m.m_idx >= f.fold_id * 3 AND m.m_idx < f.fold_id * 3 + 36
        UNION ALL
        SELECT m.*, CAST(f.fold_id AS INTEGER) AS fold_id, 'test' AS role FROM mlm m JOIN fp f
          ON m.symbol = f.symbol AND m.m_idx >= f.fold_id * 3 + 36 AND m.m_idx < f.fold_id * 3 + 39)
"""


def _ml(spark, sf):
    from ..operators import features, walkforward as wf
    ft = labels.path_labels(features.feature_table(fx.chain(spark, sf), fx.und(spark, sf)), price_col="und_price")
    return wf.ml_table(ft)


def _assigned(spark, sf):
    from ..operators import walkforward as wf
    ml, cols = _ml(spark, sf)
    idx = wf.month_index(ml)
    return wf.assign_folds(idx, wf.fold_counts(idx)), cols


@register("p15_null_shares", _ML_SQL + "SELECT " + ", ".join(
    f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in _ALLF) + " FROM flab2")
def q_null_shares(spark, sf):
    from ..operators import features, walkforward as wf
    ft = labels.path_labels(features.feature_table(fx.chain(spark, sf), fx.und(spark, sf)), price_col="und_price")
    return round_doubles(wf.sparse_feature_shares(ft, _ALLF))


@register("m1_ml_table", _ML_SQL + f"""SELECT symbol, quote_date, {', '.join(f'{_r(c)} AS {c}' for c in _ALLF)},
    label, round(fwd_ret_1d, 6) AS fwd_ret_1d, y FROM ml""")
def q_ml_table(spark, sf):
    ml, _ = _ml(spark, sf)
    return round_doubles(ml, overrides=_ROUND_ML)


@register("w10_month_index", _ML_SQL + "SELECT symbol, ym, m_idx FROM mi")
def q_month_index(spark, sf):
    from ..operators import walkforward as wf
    ml, _ = _ml(spark, sf)
    return wf.month_index(ml).select("symbol", "ym", F.col("m_idx").cast("int").alias("m_idx")).distinct()


@register("m2_fold_plan", _ML_SQL + """
SELECT fp.symbol, CAST(fp.fold_id AS INTEGER) AS fold_id, a.ym AS train_start, b.ym AS train_end, c.ym AS test_start,
       d.ym AS test_end FROM fp
JOIN mi a ON a.symbol = fp.symbol AND a.m_idx = fp.fold_id * 3 JOIN mi b ON b.symbol = fp.symbol AND b.m_idx = fp.fold_id * 3 + 35
JOIN mi c ON c.symbol = fp.symbol AND c.m_idx = fp.fold_id * 3 + 36 JOIN mi d ON d.symbol = fp.symbol AND d.m_idx = fp.fold_id * 3 + 38""")
def q_fold_plan(spark, sf):
    from ..operators import walkforward as wf
    ml, _ = _ml(spark, sf)
    return wf.fold_plan(wf.month_index(ml))


@register("j2_fold_assignment", _ML_SQL + "SELECT symbol, quote_date, fold_id, role FROM asg")
def q_fold_assignment(spark, sf):
    a, _ = _assigned(spark, sf)
    return a.select("symbol", "quote_date", "fold_id", "role")


@register("a22_fold_sizes", _ML_SQL + """
SELECT symbol, fold_id, CAST(count_if(role = 'train') AS BIGINT) AS n_train, CAST(count_if(role = 'test') AS BIGINT) AS n_test,
       count_if(role = 'train') >= 50 AND count_if(role = 'test') >= 5 AS trained FROM asg GROUP BY 1, 2""")
def q_fold_sizes(spark, sf):
    from ..operators import walkforward as wf
    a, _ = _assigned(spark, sf)
    return wf.fold_sizes(a)


def _scaler_sql():
    cols = []
    for c in _ALLF:
        sc = 2 if c in _GEX2 else 6
        cols.append(f"round(avg({c}), {sc}) AS mean_{c}")
        cols.append(f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, {sc}) AS scale_{c}")
    return "SELECT symbol, fold_id, " + ", ".join(cols) + " FROM asg WHERE role = 'train' GROUP BY 1, 2"


@register("a23_scaler_stats", _ML_SQL + _scaler_sql())
def q_scaler_stats(spark, sf):
    from ..operators import walkforward as wf
    a, cols = _assigned(spark, sf)
    st = wf.scaler_stats(a, cols)
    return round_doubles(st, overrides={f"{p}_{c}": 2 for c in _GEX2 for p in ("mean", "scale")})


@register("a26_date_range", _ML_SQL + "SELECT symbol, min(quote_date) AS date_min, max(quote_date) AS date_max FROM ml GROUP BY 1")
def q_date_range(spark, sf):
    from ..operators import walkforward as wf
    ml, _ = _ml(spark, sf)
    return wf.date_range(ml, by=["symbol"])


@register("p18_class_codes", _ML_SQL + "SELECT label, y, y - 1 AS back FROM ml")
def q_class_codes(spark, sf):
    from ..operators import signals
    ml, _ = _ml(spark, sf)
    return ml.select("label", signals.encode_class("label").cast("int").alias("y"), signals.decode_class("y").alias("back"))


# ---------------------------------------------------------------- evaluation

_EVAL_SQL = with_views("proba", extra=_RES_CTES + ",\n" + _LAB_CTES + ",\n" + """
ev0 AS (SELECT r.symbol, r.quote_date, l.label, r.pred_dir_ens AS pred_dir, r.signal_dir AS pred_dir_ens,
               r.proba_up_ens, r.proba_down_ens FROM res r JOIN lab l ON r.symbol = l.symbol AND r.quote_date = l.quote_date),
emi AS (SELECT symbol, ym, row_number() OVER (PARTITION BY symbol ORDER BY ym) - 1 AS m_idx
        FROM (SELECT DISTINCT symbol, CAST(date_trunc('month', quote_date) AS DATE) AS ym FROM ev0)),
emc AS (SELECT symbol, count(*) AS n_months FROM emi GROUP BY 1),
efp AS (SELECT symbol, unnest(range(0, CAST(floor((n_months - 36) / 3) AS BIGINT))) AS fold_id FROM emc WHERE n_months >= 39),
ev AS (SELECT e.*, CAST(f.fold_id AS INTEGER) AS fold_id, a.ym AS train_start, c.ym AS test_start, d.ym AS test_end
       FROM ev0 e JOIN emi m ON e.symbol = m.symbol AND CAST(date_trunc('month', e.quote_date) AS DATE) = m.ym
       JOIN efp f ON f.symbol = e.symbol AND m.m_idx >= f.fold_id * 3 + 36 AND m.m_idx < f.fold_id * 3 + 39
       JOIN emi a ON a.symbol = f.symbol AND a.m_idx = f.fold_id * 3
       JOIN emi c ON c.symbol = f.symbol AND c.m_idx = f.fold_id * 3 + 36
       JOIN emi d ON d.symbol = f.symbol AND d.m_idx = f.fold_id * 3 + 38)""")


def _eval(spark, sf):
    from ..operators import walkforward as wf
    lab = labels.path_labels(fx.px(spark, sf), price_col="close").select("symbol", "quote_date", "label")
    res = _results(spark, sf).select("symbol", "quote_date", F.col("pred_dir_ens").alias("pred_dir"),
                                     F.col("signal_dir").alias("pred_dir_ens"), "proba_up_ens", "proba_down_ens")
    ev = res.join(lab, ["symbol", "quote_date"], "inner")
    idx = wf.month_index(ev)
    a = wf.assign_folds(idx, wf.fold_counts(idx)).filter(F.col("role") == "test")
    plan = wf.fold_plan(idx).select("symbol", "fold_id", "train_start", "test_start", "test_end")
    return a.join(plan, ["symbol", "fold_id"], "inner")


def _f1_sql(p):
    parts, pres = [], []
    for c in (-1, 0, 1):
        tp = f"count_if(label = {c} AND {p} = {c})"
        fp = f"count_if(label <> {c} AND {p} = {c})"
        fn = f"count_if(label = {c} AND {p} <> {c})"
        den = f"(2 * {tp} + {fp} + {fn})"
        parts.append(f"CASE WHEN {den} > 0 THEN 2.0 * {tp} / {den} ELSE 0.0 END")
        pres.append(f"CASE WHEN {den} > 0 THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) / ({' + '.join(pres)}))"


@register("a7_fold_metrics", _EVAL_SQL + f"""
SELECT symbol, fold_id, count(*) AS rows, min(train_start) AS train_start, min(test_start) AS test_start,
       min(test_end) AS test_end, round(avg(CASE WHEN label = pred_dir THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round({_f1_sql('pred_dir')}, 6) AS macro_f1,
       round(avg(CASE WHEN label = pred_dir_ens THEN 1.0 ELSE 0.0 END), 6) AS acc_ens,
       round({_f1_sql('pred_dir_ens')}, 6) AS f1_ens
FROM ev GROUP BY 1, 2""")
def q_fold_metrics(spark, sf):
    from ..operators import evaluate
    return round_doubles(evaluate.fold_metrics(_eval(spark, sf), by=["symbol"]))


@register("a27_mean_fold_accuracy", _EVAL_SQL + """
, fm AS (SELECT symbol, fold_id, avg(CASE WHEN label = pred_dir THEN 1.0 ELSE 0.0 END) AS acc,
                avg(CASE WHEN label = pred_dir_ens THEN 1.0 ELSE 0.0 END) AS acc_e FROM ev GROUP BY 1, 2)
SELECT symbol, round(avg(acc), 6) AS mean_accuracy, round(avg(acc_e), 6) AS mean_acc_ens FROM fm GROUP BY 1""")
def q_mean_fold_accuracy(spark, sf):
    from ..operators import evaluate
    return round_doubles(evaluate.mean_fold_accuracy(evaluate.fold_metrics(_eval(spark, sf), by=["symbol"]), by=["symbol"]))


@register("a8_confusion_matrix", _EVAL_SQL + """
SELECT l.label, CAST(count_if(pred_dir_ens = -1) AS BIGINT) AS pred_down, CAST(count_if(pred_dir_ens = 0) AS BIGINT) AS pred_flat,
       CAST(count_if(pred_dir_ens = 1) AS BIGINT) AS pred_up
FROM (SELECT -1 AS label UNION ALL SELECT 0 UNION ALL SELECT 1) l LEFT JOIN ev ON ev.label = l.label GROUP BY l.label""")
def q_confusion_matrix(spark, sf):
    from ..operators import evaluate
    return evaluate.confusion_matrix(_eval(spark, sf))


def _report_sql():
    rows = []
    for c, name in ((-1, "Down"), (0, "Flat"), (1, "Up")):
        tp = f"count_if(label = {c} AND pred_dir_ens = {c})"
        fp = f"count_if(label <> {c} AND pred_dir_ens = {c})"
        fn = f"count_if(label = {c} AND pred_dir_ens <> {c})"
        rows.append(f"""SELECT '{name}' AS class,
  CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END AS precision,
  CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END AS recall,
  CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END AS f1,
  CAST({tp} + {fn} AS BIGINT) AS support FROM ev""")
    return ",\ncls AS (" + " UNION ALL ".join(rows) + ")\n" + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cls
UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT avg(CASE WHEN label = pred_dir_ens THEN 1.0 ELSE 0.0 END) FROM ev), 6),
       (SELECT count(*) FROM ev)
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), (SELECT count(*) FROM ev) FROM cls
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), (SELECT count(*) FROM ev) FROM cls"""


@register("a9_classification_report", _EVAL_SQL + _report_sql())
def q_classification_report(spark, sf):
    from ..operators import evaluate
    return round_doubles(evaluate.classification_report(_eval(spark, sf)))


@register("a10_threshold_sweep", _EVAL_SQL + """,
thr AS (SELECT CAST(round((6 + i) * 0.05, 2) AS DOUBLE) AS threshold FROM range(10) t(i))
SELECT threshold,
  round(avg(CASE WHEN proba_up_ens >= threshold THEN CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END END), 6) AS up_precision,
  round(avg(CASE WHEN proba_down_ens >= threshold THEN CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END END), 6) AS down_precision,
  round(avg(CASE WHEN proba_up_ens >= threshold THEN 1.0 ELSE 0.0 END), 6) AS up_coverage,
  round(avg(CASE WHEN proba_down_ens >= threshold THEN 1.0 ELSE 0.0 END), 6) AS down_coverage
FROM ev, thr GROUP BY threshold""")
def q_threshold_sweep(spark, sf):
    from ..operators import evaluate
    return round_doubles(evaluate.threshold_sweep(_eval(spark, sf)))


# ---------------------------------------------------------------- feature statistics

def _flab(spark, sf):
    """Labelled feature table, written once to the checkpoint dir (a stored feature table)."""
    from ..operators import features
    from ..session import cut_lineage
    ft = features.feature_table(fx.chain(spark, sf), fx.und(spark, sf))
    return cut_lineage(labels.path_labels(ft, price_col="und_price"))


_PAIRS = [(a, b) for i, a in enumerate(_ALLF) for b in _ALLF[i + 1:]]
_CORR_SQL = _ML_SQL.rstrip() + ",\n" + "cw AS (SELECT " + ", ".join(
    f'corr({a}, {b}) AS "{a}|{b}"' for a, b in _PAIRS) + " FROM flab2),\n" + """
cl AS (UNPIVOT cw ON COLUMNS(*) INTO NAME k VALUE r),
corr_long AS (SELECT split_part(k, '|', 1) AS feature_a, split_part(k, '|', 2) AS feature_b,
                     CASE WHEN isnan(r) THEN NULL ELSE r END AS r FROM cl)
"""


@register("a11_corr_matrix", _CORR_SQL + "SELECT feature_a, feature_b, round(r, 6) AS r FROM corr_long")
def q_corr_matrix(spark, sf):
    from ..operators import stats
    return round_doubles(stats.corr_matrix(_flab(spark, sf), _ALLF))


@register("a12_correlated_pairs", _CORR_SQL + """
SELECT feature_a, feature_b, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM corr_long WHERE abs(r) >= 0.7""")
def q_correlated_pairs(spark, sf):
    from ..operators import stats
    return round_doubles(stats.correlated_pairs(stats.corr_matrix(_flab(spark, sf), _ALLF)))


_UNPIV = f"UNPIVOT (SELECT {', '.join(_ALLF)} FROM flab2) ON {', '.join(_ALLF)} INTO NAME feature VALUE value"


@register("a14_histogram", _ML_SQL.rstrip() + f""",
hl AS ({_UNPIV}),
rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM hl GROUP BY 1),
hb AS (SELECT hl.feature, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((value - lo) / (hi - lo) * 50), 49) AS INTEGER) END AS bin,
              lo, hi FROM hl JOIN rg USING (feature))
SELECT feature, bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 50), 6) AS bin_lo,
       round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 50), 6) AS bin_hi, count(*) AS n
FROM hb GROUP BY 1, 2""")
def q_histogram(spark, sf):
    from ..operators import stats
    return round_doubles(stats.histogram(_flab(spark, sf), _ALLF), overrides={"bin_lo": 6, "bin_hi": 6})


@register("a13_mutual_information", _ML_SQL.rstrip() + f""",
mc0 AS (SELECT * FROM flab2 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _ALLF)}),
ml0 AS (UNPIVOT (SELECT label, {', '.join(_ALLF)} FROM mc0) ON {', '.join(_ALLF)} INTO NAME feature VALUE value),
mrg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM ml0 GROUP BY 1),
mb AS (SELECT ml0.feature, label, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS INTEGER) END AS bin
       FROM ml0 JOIN mrg USING (feature)),
jt AS (SELECT feature, bin, label, count(*) AS n FROM mb GROUP BY 1, 2, 3),
jt2 AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, bin) AS nb,
               sum(n) OVER (PARTITION BY feature, label) AS nl FROM jt)
SELECT feature, round(sum((n / nn) * ln((n * nn) / (nb * nl))), 6) AS mi_score FROM jt2 GROUP BY 1""")
def q_mutual_information(spark, sf):
    from ..operators import stats
    return round_doubles(stats.mutual_information(_flab(spark, sf), _ALLF))


# ---------------------------------------------------------------- model (rows-only checks)

@register("m3_m5_walkforward_ensemble")
def q_walkforward_ensemble(spark, sf):
    from ..operators import model
    ml, cols = _ml(spark, sf)
    res = model.train_walkforward(ml, cols)
    return res.results.select("symbol", "quote_date", "fold_id", "model_id", "label", "pred_dir", "proba_down",
                              "proba_flat", "proba_up", "proba_down_ens", "proba_flat_ens", "proba_up_ens",
                              "pred_dir_ens", "train_start", "test_start")


@register("j8_causal_ensemble", with_views("members", "px", extra="""
mi AS (SELECT symbol, ym, row_number() OVER (PARTITION BY symbol ORDER BY ym) - 1 AS m_idx
       FROM (SELECT DISTINCT symbol, CAST(date_trunc('month', quote_date) AS DATE) AS ym FROM px)),
wt AS (SELECT fold_id, pow(0.7, count(*) OVER () - row_number() OVER (ORDER BY fold_id)) AS raw
       FROM (SELECT DISTINCT fold_id FROM members) f),
w AS (SELECT fold_id, raw / sum(raw) OVER () AS weight FROM wt),
m AS (SELECT mb.*, CASE WHEN te.ym < CAST(date_trunc('month', mb.quote_date) AS DATE) THEN w.weight ELSE 0 END AS wgt
      FROM members mb JOIN w USING (fold_id) JOIN mi te ON te.symbol = mb.symbol AND te.m_idx = mb.fold_id * 3 + 35)""") + """
SELECT symbol, quote_date,
  round(coalesce(sum(wgt * p_down) FILTER (WHERE wgt > 0) / sum(wgt) FILTER (WHERE wgt > 0), 1.0 / 3), 6) AS proba_down_ens,
  round(coalesce(sum(wgt * p_flat) FILTER (WHERE wgt > 0) / sum(wgt) FILTER (WHERE wgt > 0), 1.0 / 3), 6) AS proba_flat_ens,
  round(coalesce(sum(wgt * p_up) FILTER (WHERE wgt > 0) / sum(wgt) FILTER (WHERE wgt > 0), 1.0 / 3), 6) AS proba_up_ens
FROM m GROUP BY 1, 2""")
def q_causal_ensemble(spark, sf):
    from ..operators import model, signals, walkforward as wf
    m = fx.members(spark, sf)
    w = signals.fold_weights(m.select("fold_id").distinct())
    plan = wf.fold_plan(wf.month_index(fx.px(spark, sf)))
    return round_doubles(model.causal_ensemble(m, w, plan, weight_keys=()))


# ---------------------------------------------------------------- streaming

@register("r5_trade_day_buckets", with_views("ticks") + """
SELECT CAST(ts - INTERVAL 7 HOUR AS DATE) AS trade_date, count(*) AS n_ticks, round(sum(value), 6) AS value_sum
FROM ticks GROUP BY 1""")
def q_trade_day_buckets(spark, sf):
    from ..streaming import jobs
    return round_doubles(jobs.trade_day_buckets(fx.ticks(spark, sf)))


@register("r2_tick_window_snapshots", with_views("ticks", extra="""
named AS (SELECT *, CASE tick_type WHEN 1 THEN 'Bid' WHEN 2 THEN 'Ask' WHEN 4 THEN 'Last' WHEN 9 THEN 'Close'
                  ELSE 'T' || CAST(tick_type AS VARCHAR) END AS field, date_trunc('minute', ts) AS ws FROM ticks),
lastv AS (SELECT ws, req_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY ws, req_id, field
          ORDER BY ts DESC, seq DESC) AS rn FROM named) WHERE rn = 1)""") + """
SELECT ws AS window_start, ws + INTERVAL 1 MINUTE AS window_end, req_id,
       max(value) FILTER (WHERE field = 'Bid') AS "Bid", max(value) FILTER (WHERE field = 'Ask') AS "Ask",
       max(value) FILTER (WHERE field = 'Last') AS "Last", max(value) FILTER (WHERE field = 'Close') AS "Close",
       max(value) FILTER (WHERE field = 'T99') AS "T99"
FROM lastv GROUP BY 1, 2, 3""")
def q_tick_window_snapshots(spark, sf):
    from ..streaming import jobs
    out = jobs.tick_snapshot_stream(fx.ticks(spark, sf), _TICK_FIELDS)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      "req_id", *_TICK_FIELDS)


_R2_FEED_FIELDS = ["Bid", "Last", "Volume", "CallOpenInterest", "PutOpenInterest", "Model_IV", "Model_OptPrice", "Bid_Delta", "T1"]


@register("r2_tick_window_snapshots_by_kind", with_views("tick_rows", extra="""
lastv AS (SELECT date_trunc('minute', ts) AS ws, req_id, field, arg_max(value, (ts, seq)) AS value FROM tick_rows GROUP BY 1, 2, 3)""") + """
SELECT ws AS window_start, ws + INTERVAL 1 MINUTE AS window_end, req_id, """ + ", ".join(
    f"round(max(value) FILTER (WHERE field = '{f}'), 6) AS \"{f}\"" for f in _R2_FEED_FIELDS) + """
FROM lastv GROUP BY 1, 2, 3""")
def q_tick_window_snapshots_by_kind(spark, sf):
    from ..streaming import jobs
    out = jobs.tick_snapshot_stream(fx.tick_feed(spark, sf), _R2_FEED_FIELDS)
    return round_doubles(out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                                    "req_id", *_R2_FEED_FIELDS))


def _scratch(spark, name):
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/work/{name}-{uuid.uuid4().hex[:10]}"


def _land(df, path, fmt="csv", files=4, **options):
    """Land rows as several files that each hold parts of every day and symbol."""
    df.repartition(files, "seq" if "seq" in df.columns else df.columns[0]).write.mode("append").options(header=True, **options).format(fmt).save(path)


@register("r1_chain_snapshot_stream", _MERGE_SQL + "SELECT * FROM rows_")
def q_chain_snapshot_stream(spark, sf):
    """End-to-end stream in two runs on one checkpoint; every file and every batch holds parts of all days. The second
    run's files have another column order, and its row of the day 1990-01-02 leaves no row of that day in the band."""
    from ..operators.chain import CHAIN_SCHEMA
    from ..streaming import jobs
    root = _scratch(spark, "r1")
    lg = fx.legs(spark, sf)
    oi, ohlc = fx.oi_feed(spark, sf, lg), fx.ohlc_feed(spark, sf, lg)
    feed = fx.iv_feed(spark, sf, lg)
    files = 4 * max(1, math.ceil(lg.count() / 2_000_000))  # one batch a run; a compressed file is read by one task
    day = "'none', DATE '1990-01-02', '1990-02-16', '100', 'CALL'"
    gone = [spark.sql(f"SELECT {s}L AS seq, {day}, {bid} AS bid, {bid} AS ask, '0.2' AS implied_vol, {u}D AS underlying_price").toDF(*feed.columns)
            for s, bid, u in ((5, "'1'", 100), (1, "CAST(NULL AS STRING)", 1000))]
    for part, more, order in ((F.col("seq") % 3 == 0, gone[0], feed.columns), (F.col("seq") % 3 != 0, gone[1], feed.columns[::-1])):
        _land(feed.filter(part).unionByName(more).select(*order), f"{root}/landing", files=files, compression="gzip")
        jobs.chain_snapshot_stream(spark, f"{root}/landing", oi, ohlc, f"{root}/out", checkpoint=f"{root}/ckpt",
                                   max_files=files).awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*[c for c, _ in CHAIN_SCHEMA])


@register("r3_price_topup_stream", _FEED_SQL + """,
newest AS (SELECT symbol, quote_date, arg_max(close, (seq, close)) AS close FROM ok GROUP BY 1, 2)
SELECT s.symbol, s.quote_date, s.close FROM stored s ANTI JOIN newest d ON s.symbol = d.symbol AND s.quote_date = d.quote_date
UNION ALL SELECT * FROM newest""")
def q_price_topup_stream(spark, sf):
    """End-to-end stream: EOD files, the newest first, in two runs of several batches each."""
    from ..sources import sinks
    from ..streaming import jobs
    root = _scratch(spark, "r3")
    sinks.write_keyed(fx.stored(spark, sf).select(F.lit(None).cast("bigint").alias("seq"), "symbol", "quote_date", "close"), f"{root}/prices")
    feed = fx.price_feed(spark, sf)
    for part in (F.col("created") >= "1996", F.coalesce(F.col("created") < "1996", F.lit(True))):
        _land(feed.filter(part), f"{root}/landing")
        jobs.price_topup_stream(spark, f"{root}/landing", f"{root}/prices", checkpoint=f"{root}/ckpt", max_files=3).awaitTermination()
    return sinks.read_keyed(spark, f"{root}/prices").select("symbol", "quote_date", "close")


_SOFTMAX_SQL = with_views("proba", extra="""
feats AS (SELECT symbol, quote_date, CAST(day(quote_date) % 7 AS DOUBLE) AS f1,
                 CASE WHEN day(quote_date) <> 13 THEN CAST(month(quote_date) % 3 AS DOUBLE) ELSE 0 END AS f2, above_sma200, vol_regime FROM proba),
logit AS (SELECT symbol, quote_date, f AS fold_id, """ + ", ".join(
    f"({0.1 * k} - 0.05 * f) + {0.9 * (k - 1)} * ((f1 - 3) / 2) + 0.4 * (f + 1) * {1 - k} * ((f2 - 1) / (1.0 + f)) AS l{k}" for k in range(3)) + """
          FROM feats, (SELECT unnest([0, 1, 2]) AS f)),
probs AS (SELECT symbol, quote_date, fold_id, exp(l0) / (exp(l0) + exp(l1) + exp(l2)) AS p_down, exp(l1) / (exp(l0) + exp(l1) + exp(l2)) AS p_flat,
                 exp(l2) / (exp(l0) + exp(l1) + exp(l2)) AS p_up FROM logit),
ens AS (SELECT symbol, quote_date, sum(w * p_down) / sum(w) AS pd, sum(w * p_flat) / sum(w) AS pf, sum(w * p_up) / sum(w) AS pu
        FROM probs JOIN (VALUES (1, 0.4::DOUBLE), (2, 0.6::DOUBLE)) t(fold_id, w) USING (fold_id) GROUP BY 1, 2)""")


def _symbols(spark, sf):
    return [r[0] for r in fx.px(spark, sf).select("symbol").distinct().collect()]


@register("j3_member_probabilities", _SOFTMAX_SQL + """
SELECT symbol, quote_date, CAST(fold_id AS INT) AS fold_id, round(p_down, 6) AS p_down, round(p_flat, 6) AS p_flat, round(p_up, 6) AS p_up FROM probs""")
def q_member_probabilities(spark, sf):
    """J3 with stated coefficients and scalers: every row by every fold of its symbol."""
    from ..operators import model, walkforward as wf
    cols, coefs, scalers, _ = fx.fixed_ensemble(spark, _symbols(spark, sf))
    rows = wf.zero_fill(fx.signal_features(spark, sf), cols)
    return round_doubles(model.member_probabilities(rows, coefs, scalers, cols))


@register("r4_daily_signal_stream", _SOFTMAX_SQL + f"""
SELECT symbol, quote_date, round(pu, 6) AS proba_up_ens, round(pf, 6) AS proba_flat_ens, round(pd, 6) AS proba_down_ens,
       CASE WHEN pf >= pu AND pf >= pd THEN 0 WHEN vol_regime = 0 THEN 0
            WHEN pu >= {DEFAULTS.conf_threshold_up} AND pu >= pd THEN CASE WHEN above_sma200 <> 1 THEN 0 ELSE 1 END
            WHEN pd >= {DEFAULTS.conf_threshold_down} AND pd >= pu THEN -1 ELSE 0 END AS signal_dir
FROM ens JOIN feats USING (symbol, quote_date)""")
def q_daily_signal_stream(spark, sf):
    """Every (symbol, day) scored by a stated ensemble, in two runs of several batches each."""
    from ..sources import sinks
    from ..streaming import jobs
    root = _scratch(spark, "r4")
    feats = fx.signal_features(spark, sf)
    ens = fx.fixed_ensemble(spark, _symbols(spark, sf))
    for part in (F.year("quote_date") % 2 == 0, F.year("quote_date") % 2 == 1):
        _land(feats.filter(part).select("quote_date", *[c for c in feats.columns if c != "quote_date"]), f"{root}/landing", "parquet")
        jobs.signal_stream(spark, f"{root}/landing", feats.schema, ens, f"{root}/signals", checkpoint=f"{root}/ckpt", max_files=3).awaitTermination()
    out = sinks.read_keyed(spark, f"{root}/signals").select("symbol", "quote_date", "proba_up_ens", "proba_flat_ens", "proba_down_ens", "signal_dir")
    return round_doubles(out)


# ---------------------------------------------------------------- scans, sinks, top-k

@register("s5_expiration_scan", with_views("expirations") + """
SELECT symbol, expiration, CAST(expiration AS DATE) AS expiry FROM expirations WHERE expiration >= '2000-06-01'""")
def q_expiration_scan(spark, sf):
    from ..operators import chain
    return chain.read_expirations(fx.expirations(spark, sf), "2000-06-01")


@register("t3_latest_row", with_views("px") + """
SELECT * FROM px ORDER BY quote_date DESC, symbol DESC LIMIT 1""")
def q_latest_row(spark, sf):
    return fx.px(spark, sf).orderBy(F.col("quote_date").desc(), F.col("symbol").desc()).limit(1)


@register("t5_head", with_views("px") + """
SELECT * FROM px ORDER BY quote_date, symbol LIMIT 5""")
def q_head(spark, sf):
    return fx.px(spark, sf).orderBy("quote_date", "symbol").limit(5)


@register("s1_stored_feature_scan", with_views("proba") + "SELECT * FROM proba")
def q_stored_feature_scan(spark, sf):
    """A stored feature table scanned back, NaN as NULL, by date."""
    from ..sources.tables import read_feature_table
    root = _scratch(spark, "s1")
    p = fx.proba(spark, sf)
    p.withColumns({"quote_date": F.col("quote_date").cast("string"),
                   "proba_up_ens": F.col("proba_up_ens")}).write.parquet(f"{root}/features")
    return read_feature_table(spark, f"{root}/features").select(*p.columns)


@register("u2_union_all", with_views("px", "stored") + """
SELECT symbol, quote_date, close, 'px' AS src FROM px UNION ALL SELECT symbol, quote_date, close, NULL FROM stored""")
def q_union_all(spark, sf):
    from ..sources import sinks
    return sinks.union_all([fx.px(spark, sf).select("symbol", "quote_date", "close", F.lit("px").alias("src")),
                            fx.stored(spark, sf).select("close", "quote_date", "symbol")], allow_missing=True)


@register("k4_replace_signal_rows", _RES_SQL + """,
new AS (SELECT quote_date, symbol, -signal_dir AS signal_dir FROM res WHERE day(quote_date) = 15)
SELECT r.quote_date, r.symbol, r.signal_dir FROM res r ANTI JOIN new n ON r.quote_date = n.quote_date AND r.symbol = n.symbol
UNION ALL SELECT * FROM new""")
def q_replace_signal_rows(spark, sf):
    from ..sources import sinks
    base = _results(spark, sf).select("quote_date", "symbol", "signal_dir")
    new = base.filter(F.dayofmonth("quote_date") == 15).withColumn("signal_dir", -F.col("signal_dir"))
    return sinks.upsert(base, new, ["quote_date", "symbol"], seq_col=None)


def _appended(spark, sf) -> str:
    from ..sources import sinks
    from ..operators import chain
    path = f"{_scratch(spark, 'k1')}/option_chains"
    sinks.append_chain(chain.conform(_snapshot(spark, sf)), path)
    return path


@register("k1_chain_append", _MERGE_SQL + "SELECT * FROM rows_")
def q_chain_append(spark, sf):
    """K1: the whole append read back."""
    from ..operators.chain import CHAIN_SCHEMA
    return spark.read.parquet(_appended(spark, sf)).select(*[c for c, _ in CHAIN_SCHEMA])


@register("k1_s9_chain_partitions", _MERGE_SQL + """
SELECT trade_date, "Symbol", "Strike", righttype, "OpenInterest" FROM rows_ WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'""")
def q_chain_partitions(spark, sf):
    """K1 append partitioned by trade_date, then S9 reads one quarter back (partition pruning)."""
    from ..sources.tables import chain_scan
    return chain_scan(spark, _appended(spark, sf), start="1996-01-01", end="1996-03-31",
                      columns=["trade_date", "Symbol", "Strike", "righttype", "OpenInterest"])


def _feed_text(view: str, cols: list[str]) -> str:
    """The CSV round trip: every value text, the empty text NULL."""
    return with_views(view) + "SELECT " + ", ".join(f"NULLIF(CAST({c} AS VARCHAR), '') AS {c}" for c in cols) + f" FROM {view}"


def _feed_scan(name, feed, cols):
    def run(spark, sf):
        from ..operators import chain
        path = f"{_scratch(spark, name)}/feed"
        rows = feed(spark, sf).select(*cols)
        rows.filter("seq % 2 = 0").write.option("header", True).csv(path)
        # files of another column order, with a column more
        rows.filter("seq % 2 <> 0").select(F.lit("x").alias("venue"), *reversed(cols)).write.mode("append").option("header", True).csv(path)
        return chain.read_feed_csv(spark, path, cols)
    run.__doc__ = f"S3/S4: the {name} feed landed as CSV files of two layouts and scanned back by their headers, every value text."
    return run


for _name, _feed, _cols in (
        ("s3_feed_csv_scan", fx.oi_feed, ["seq", "symbol", "trade_date", "expiration", "strike", "right_", "open_interest"]),
        ("s4_iv_feed_csv_scan", fx.iv_feed, ["seq", "symbol", "trade_date", "expiration", "strike", "right_", "bid", "ask", "implied_vol"]),
        ("s4_ohlc_feed_csv_scan", fx.ohlc_feed, ["seq", "symbol", "trade_date", "expiration", "strike", "right_", "close", "volume"])):
    register(_name, _feed_text(_feed.__name__, _cols))(_feed_scan(_name, _feed, _cols))


@register("m9_daily_signal")
def q_daily_signal(spark, sf):
    """K7 -> K8 -> M9: train, export the ensemble, load it back, score the latest row per symbol."""
    from ..operators import model
    ml, cols = _ml(spark, sf)
    res = model.train_walkforward(ml, cols)
    root = _scratch(spark, "ens")
    model.export_ensemble(res, root)
    fc, models, scalers, weights = model.load_ensemble(spark, root)
    return model.run_inference(ml.drop("label", "fwd_ret_1d", "y"), fc, models, scalers, weights)


@register("a25_feature_importance")
def q_feature_importance(spark, sf):
    from ..operators import model
    ml, cols = _ml(spark, sf)
    res = model.train_walkforward(ml, cols)
    return model.feature_importance(res)


# ---------------------------------------------------------------- P9, P20

@register("p9_expiry_formats", with_views("expirations") + """
SELECT symbol, expiration, replace(expiration, '-', '') AS legacy,
       TRY_CAST(expiration AS DATE) AS expiry_iso, TRY_STRPTIME(replace(expiration, '-', ''), '%Y%m%d')::DATE AS expiry_legacy
FROM expirations""")
def q_expiry_formats(spark, sf):
    from ..functions.columns import expiry_date
    e = fx.expirations(spark, sf).withColumn("legacy", F.regexp_replace("expiration", "-", ""))
    return e.select("symbol", "expiration", "legacy", expiry_date("expiration").alias("expiry_iso"),
                    expiry_date("legacy").alias("expiry_legacy"))


@register("p20_context_columns", with_views("proba") + """
SELECT symbol, quote_date, CAST(above_sma200 AS DOUBLE) AS above_sma200, CAST(vol_regime AS DOUBLE) AS vol_regime,
       CAST(NULL AS DOUBLE) AS sma_200, CAST(NULL AS DOUBLE) AS ret_20d, CAST(NULL AS DOUBLE) AS ret_60d,
       CAST(NULL AS DOUBLE) AS vol_20d, CAST(NULL AS DOUBLE) AS vol_5d, CAST(NULL AS DOUBLE) AS daily_ret
FROM proba""")
def q_context_columns(spark, sf):
    from ..operators import signals
    from ..config import DEFAULTS
    c = signals.context_columns(fx.proba(spark, sf))
    return c.select("symbol", "quote_date", *DEFAULTS.context_cols)


# ---------------------------------------------------------------- checks on inputs that hit the rarer branches

@register("p21_return_outliers_default", with_views("px") + f"""
SELECT symbol, quote_date, round(ret, 6) AS ret_1d FROM (SELECT symbol, quote_date, c / lag(c) {_w()} - 1 AS ret
  FROM (SELECT symbol, quote_date, CASE WHEN day(quote_date) = 15 THEN close * 1.1 ELSE close END AS c FROM px)) WHERE abs(ret) > 0.05""")
def q_return_outliers_default(spark, sf):
    """P21 at the default 5 %, on closes raised by a tenth on every 15th."""
    p = fx.px(spark, sf)
    p = p.withColumn("close", F.when(F.dayofmonth("quote_date") == 15, F.col("close") * 1.1).otherwise(F.col("close")))
    return round_doubles(quality.return_outliers(p).select("symbol", "quote_date", "ret_1d"))


@register("f22_history_gate_short", with_views("px", extra="""
short AS (SELECT * FROM px WHERE symbol <> '3-MEDIUM' OR quote_date < DATE '1992-06-01')""") + """
SELECT symbol, quote_date FROM short WHERE symbol IN (SELECT symbol FROM short GROUP BY symbol HAVING count(*) >= 270)""")
def q_history_gate_short(spark, sf):
    """F22 with one symbol whose history is too short."""
    from ..operators import features
    p = fx.px(spark, sf).filter((F.col("symbol") != "3-MEDIUM") | (F.col("quote_date") < "1992-06-01"))
    return features.history_gate(p).select("symbol", "quote_date")


_CONTEXT = ("sma_200", "ret_20d", "ret_60d", "vol_20d", "vol_5d", "daily_ret")


def _with_context(df):
    """All context columns, made of the close and the probabilities."""
    return df.withColumns({"sma_200": F.col("close") * 0.98, "ret_20d": F.col("proba_up_ens") / 10, "ret_60d": F.col("proba_down_ens") / 5,
                           "vol_20d": F.col("proba_flat_ens") / 3, "vol_5d": F.col("proba_flat_ens") / 7,
                           "daily_ret": F.when(F.dayofmonth("quote_date") != 3, F.col("proba_up_ens") / 100)})


_CONTEXT_SQL = ("close * 0.98 AS sma_200, proba_up_ens / 10 AS ret_20d, proba_down_ens / 5 AS ret_60d, proba_flat_ens / 3 AS vol_20d, "
                "proba_flat_ens / 7 AS vol_5d, CASE WHEN day(quote_date) <> 3 THEN proba_up_ens / 100 END AS daily_ret")


@register("p20_context_columns_all", with_views("proba", extra=f"""
full_ AS (SELECT *, {_CONTEXT_SQL} FROM proba)""") + "SELECT symbol, quote_date, CAST(above_sma200 AS DOUBLE) AS above_sma200, CAST(vol_regime AS DOUBLE) AS vol_regime, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in _CONTEXT) + " FROM full_")
def q_context_columns_all(spark, sf):
    """P20 with every context column present."""
    from ..operators import signals
    from ..config import DEFAULTS
    c = signals.context_columns(_with_context(fx.proba(spark, sf)))
    return round_doubles(c.select("symbol", "quote_date", *DEFAULTS.context_cols))


@register("a8_confusion_matrix_first_last", _EVAL_SQL + """,
scoped AS (SELECT *, CASE WHEN fold_id = (SELECT min(fold_id) FROM ev) THEN 'first' ELSE 'last' END AS scope FROM ev
           WHERE fold_id IN ((SELECT min(fold_id) FROM ev), (SELECT max(fold_id) FROM ev)))
SELECT s.scope, l.label, CAST(count_if(pred_dir_ens = -1) AS BIGINT) AS pred_down, CAST(count_if(pred_dir_ens = 0) AS BIGINT) AS pred_flat,
       CAST(count_if(pred_dir_ens = 1) AS BIGINT) AS pred_up
FROM (SELECT DISTINCT scope FROM scoped) s CROSS JOIN (SELECT -1 AS label UNION ALL SELECT 0 UNION ALL SELECT 1) l
LEFT JOIN scoped e ON e.scope = s.scope AND e.label = l.label GROUP BY 1, 2""")
def q_confusion_matrix_first_last(spark, sf):
    """A8 for the first and the last fold."""
    from ..operators import evaluate
    ev = _eval(spark, sf)
    ends = ev.agg(F.min("fold_id").alias("a"), F.max("fold_id").alias("b"))
    lo, hi = ends.select("a").scalar(), ends.select("b").scalar()
    scope = F.when(F.col("fold_id") == lo, "first").when(F.col("fold_id") == hi, "last")
    return evaluate.confusion_matrix(ev.withColumn("scope", scope).filter("scope is not null"), scope_col="scope")


@register("j4_weights_zero_and_missing", with_views("members") + """
SELECT symbol, quote_date, round(sum(w * p_down) / sum(w), 6) AS proba_down_ens, round(sum(w * p_flat) / sum(w), 6) AS proba_flat_ens,
       round(sum(w * p_up) / sum(w), 6) AS proba_up_ens
FROM members JOIN (VALUES (1, 0.5::DOUBLE), (4, 0.3::DOUBLE)) t(fold_id, w) USING (fold_id) GROUP BY 1, 2""")
def q_weights_zero_and_missing(spark, sf):
    """Fold 0 has weight zero, fold 2 has none, the others are renormalised."""
    from ..operators import signals
    w = spark.createDataFrame([(0, 0.0), (1, 0.5), (4, 0.3)], "fold_id int, weight double")
    return round_doubles(signals.ensemble_average(fx.members(spark, sf), w, ["symbol", "quote_date"]))


@register("p17_zero_fill", with_views("proba") + """
SELECT symbol, quote_date, CAST(day(quote_date) % 7 AS DOUBLE) AS f1, CASE WHEN day(quote_date) <> 13 THEN CAST(month(quote_date) % 3 AS DOUBLE) ELSE 0.0 END AS f2,
       CAST(above_sma200 AS DOUBLE) AS above_sma200 FROM proba""")
def q_zero_fill(spark, sf):
    """Features are zero-filled, context columns keep their NULLs."""
    from ..operators import walkforward as wf
    return wf.zero_fill(fx.signal_features(spark, sf), ["f1", "f2"]).select("symbol", "quote_date", "f1", "f2", "above_sma200")


@register("k6_signal_report_all", _RES_SQL + f""",
full_ AS (SELECT r.*, c.* EXCLUDE (symbol, quote_date) FROM res r JOIN (SELECT symbol, quote_date, {_CONTEXT_SQL} FROM proba) c
          ON c.symbol = r.symbol AND c.quote_date = r.quote_date)
SELECT quote_date AS "Date", symbol AS "Symbol", CASE signal_dir WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'FLAT' END AS "Signal",
       round(proba_up_ens, 4) AS "P(Up)", round(proba_flat_ens, 4) AS "P(Flat)", round(proba_down_ens, 4) AS "P(Down)",
       above_sma200 AS "Above SMA200", vol_regime AS "Vol Regime", round(ret_20d, 4) AS "Ret 20D", round(ret_60d, 4) AS "Ret 60D",
       round(vol_20d, 4) AS "Vol 20D", round(vol_5d, 4) AS "Vol 5D", round(daily_ret, 4) AS "Daily Ret", round(sma_200, 6) AS "SMA 200"
FROM full_""")
def q_signal_report_all(spark, sf):
    """K6 with all 14 columns."""
    from ..operators import signals
    r = _with_context(_results(spark, sf)).select("quote_date", "symbol", "signal_dir", "proba_up_ens", "proba_flat_ens",
                                                  "proba_down_ens", "above_sma200", "vol_regime", *_CONTEXT)
    return round_doubles(signals.signal_report(r))


from . import checks_more, checks_trees  # noqa: E402,F401 - they register their queries
