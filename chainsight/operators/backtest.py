"""Vectorised backtest: windows and aggregations over a signal/return table.

There is no event-driven simulator. Each series is one (symbol[, scenario])
window partition ordered by date; a daily series has one row per trading
day, so a partition is bounded by the calendar. Scenario fan-out
(thresholds, sub-periods, strategy vs benchmark) is an ``explode`` of a
bounded literal array, never a cross join, and all metrics of all series
come from ONE ``groupBy``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, sweep_thresholds

# Month column names of the monthly return pivot.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _series_window(by: list[str], date_col: str = "quote_date"):
    return Window.partitionBy(*by).orderBy(date_col)


def _running(by, date_col="quote_date"):
    return _series_window(by, date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lagged(df: DataFrame, value: Column, out_col: str, by: list[str], date_col: str = "quote_date",
           bucket: str | None = None) -> DataFrame:
    """The previous row's ``value`` in date order. With ``bucket`` (a ``date_trunc`` unit) a window holds one
    (series, bucket); the first row of a bucket takes the last value of the bucket before it."""
    if bucket is None:
        return df.withColumn(out_col, F.lag(value, 1).over(_series_window(by, date_col)))
    b = df.withColumns({"_b": _bucket(date_col, bucket), "_v": value})
    w = _series_window(by + ["_b"], date_col)
    b = b.withColumns({"_first": F.row_number().over(w) == 1, "_own": F.lag("_v", 1).over(w)})
    last = b.groupBy(*by, "_b").agg(F.max_by(F.struct("_v"), date_col)["_v"].alias("_end"))
    # one row per (series, bucket), bounded by the calendar
    prev = last.withColumn("_prev", F.lag("_end", 1).over(Window.partitionBy(*by).orderBy("_b")))
    return (b.join(prev.select(*by, "_b", "_prev"), by + ["_b"], "inner")
            .withColumn(out_col, F.when(F.col("_first"), F.col("_prev")).otherwise(F.col("_own")))
            .drop("_b", "_v", "_first", "_own", "_prev"))


# ---------------------------------------------------------------- metric expressions

def sharpe_expr(r: Column, periods: int | None = None) -> Column:
    """Mean / sample std * sqrt(periods); NULL when std is 0 or undefined."""
    p = DEFAULTS.periods_per_year if periods is None else periods
    return F.try_divide(F.avg(r), F.nullif(F.stddev_samp(r), F.lit(0.0))) * F.sqrt(F.lit(float(p)))


def win_rate_expr(r: Column) -> Column:
    """Share of r > 0 among r != 0; NULL when every r is 0."""
    return F.try_divide(F.count_if(r > 0).cast("double"), F.nullif(F.count_if(r != 0), F.lit(0)).cast("double"))


def profit_factor_expr(r: Column) -> Column:
    """Gross gains / abs(gross losses); NULL without a loss."""
    gains = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0))
    losses = F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)))
    return F.try_divide(gains, F.nullif(losses, F.lit(0.0)))


def annualised_expr(final_equity: Column, n: Column, periods: int | None = None) -> Column:
    p = DEFAULTS.periods_per_year if periods is None else periods
    return F.pow(final_equity, F.lit(float(p)) / n) - 1


# ---------------------------------------------------------------- curves

def _bucket(date_col: str, bucket: str):
    return F.date_trunc(bucket, F.col(date_col))


def equity_curve(df: DataFrame, ret_col: str, out_col: str, by: list[str] | None = None,
                 date_col: str = "quote_date", bucket: str | None = None) -> DataFrame:
    """Cumulative product of (1 + r) in date order.

    ``bucket`` (a ``date_trunc`` unit such as "month" or "day") selects the
    two-level form for very long single series (intraday data): running
    products inside each (series, bucket) window, a running product over the
    small per-bucket table, joined back. No task then holds a whole series.
    """
    by = by or ["symbol"]
    if bucket is None:
        return df.withColumn(out_col, F.product(1 + F.col(ret_col)).over(_running(by, date_col)))
    b = df.withColumn("_b", _bucket(date_col, bucket))
    b = b.withColumn("_in", F.product(1 + F.col(ret_col)).over(_running(by + ["_b"], date_col)))
    tot = b.groupBy(*by, "_b").agg(F.product(1 + F.col(ret_col)).alias("_t"))
    # per-bucket table: one row per (series, bucket), bounded by the calendar
    prev = tot.withColumn("_prev", F.coalesce(F.product("_t").over(
        Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return (b.join(prev.select(*by, "_b", "_prev"), by + ["_b"], "inner")
            .withColumn(out_col, F.col("_prev") * F.col("_in")).drop("_b", "_in", "_prev"))


def drawdown(df: DataFrame, equity_col: str, by: list[str] | None = None, date_col: str = "quote_date",
             peak_col: str = "running_max", dd_col: str = "drawdown", bucket: str | None = None) -> DataFrame:
    """Running max of the equity and (equity - peak) / peak (the 1.0 start is not part of the curve).

    ``bucket`` selects the two-level form, as in ``equity_curve``: running max
    inside each bucket combined with the max of all earlier buckets.
    """
    by = by or ["symbol"]
    if bucket is None:
        peak = F.max(equity_col).over(_running(by, date_col))
        out = df.withColumn(peak_col, peak)
    else:
        b = df.withColumn("_b", _bucket(date_col, bucket))
        b = b.withColumn("_in", F.max(equity_col).over(_running(by + ["_b"], date_col)))
        tops = b.groupBy(*by, "_b").agg(F.max(equity_col).alias("_t"))
        prev = tops.withColumn("_prev", F.max("_t").over(
            Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
        out = (b.join(prev.select(*by, "_b", "_prev"), by + ["_b"], "inner")
               .withColumn(peak_col, F.greatest(F.col("_in"), F.coalesce(F.col("_prev"), F.col("_in"))))
               .drop("_b", "_in", "_prev"))
    return out.withColumn(dd_col, (F.col(equity_col) - F.col(peak_col)) / F.col(peak_col))


def daily_pnl(df: DataFrame, by: list[str] | None = None, date_col: str = "quote_date",
              position_col: str = "position_dir", ret_col: str = "fwd_ret_1d",
              bucket: str | None = None) -> DataFrame:
    """B1: strat_ret = position * forward 1-day return, NULL returns dropped, both equity curves.

    The position is already lagged and the return is forward, so the trade
    lands one day after the signal (kept as the reference does).
    """
    by = by or ["symbol"]
    out = (df.withColumn("strat_ret", F.col(position_col) * F.col(ret_col))
           .dropna(subset=["strat_ret", ret_col]))
    out = equity_curve(out, "strat_ret", "strat_equity", by, date_col, bucket)
    return equity_curve(out, ret_col, "benchmark_equity", by, date_col, bucket)


# ---------------------------------------------------------------- performance

def _series_metrics(long: DataFrame, keys: list[str], date_col: str, with_win: bool = True,
                    with_pf: bool = True, dim_col: str | None = "in_market", bucket: str | None = None) -> DataFrame:
    """Metrics of many series in one pass: windows for equity and drawdown, then one groupBy.

    ``long`` has keys..., date, r (return) and optionally ``dim_col`` (bool).
    ``bucket`` selects the two-level windows of ``equity_curve`` and ``drawdown``.
    """
    eq = equity_curve(long, "r", "_eq", keys, date_col, bucket)
    eq = drawdown(eq, "_eq", keys, date_col, "_peak", "_dd", bucket)
    r = F.col("r")
    final = F.max_by("_eq", date_col)
    n = F.count(F.lit(1))
    aggs = [n.alias("n_days"),
            (final - 1).alias("total_return"),
            annualised_expr(final, n).alias("ann_return"),
            sharpe_expr(r).alias("sharpe"),
            F.min("_dd").alias("max_drawdown")]
    if with_win:
        aggs.append(win_rate_expr(r).alias("win_rate"))
    if with_pf:
        aggs.append(profit_factor_expr(r).alias("profit_factor"))
    if dim_col:
        aggs.append(F.avg(F.col(dim_col).cast("double")).alias("days_in_market"))
    return eq.groupBy(*keys).agg(*aggs)


def performance(bt: DataFrame, by: list[str] | None = None, date_col: str = "quote_date",
                position_col: str = "position_dir", ret_col: str = "fwd_ret_1d",
                bucket: str | None = None) -> DataFrame:
    """Strategy and benchmark metrics per symbol, as a long (symbol, series) table.

    Input is the output of ``daily_pnl``. Metrics: total return, annualised
    return final^(252/n) - 1, Sharpe, max drawdown, win rate, profit factor,
    days in market (benchmark 1.0). ``bucket``: two-level windows, for very
    long series (see ``equity_curve``).
    """
    by = by or ["symbol"]
    s = F.explode(F.array(
        F.struct(F.lit("strategy").alias("series"), F.col("strat_ret").alias("r"),
                 (F.col(position_col) != 0).alias("in_market")),
        F.struct(F.lit("benchmark").alias("series"), F.col(ret_col).alias("r"),
                 F.lit(True).alias("in_market"))))
    long = bt.select(*by, date_col, s.alias("_s")).select(*by, date_col, "_s.*")
    return _series_metrics(long, by + ["series"], date_col, bucket=bucket)


def filter_impact(results: DataFrame, bt: DataFrame, by: list[str] | None = None,
                  date_col: str = "quote_date", raw_dir_col: str = "pred_dir_ens",
                  position_col: str = "position_dir", ret_col: str = "fwd_ret_1d",
                  bucket: str | None = None) -> DataFrame:
    """Filtered strategy (``bt`` from daily_pnl) versus the raw ensemble direction.

    raw_ret = lag(pred_dir_ens) * fwd_ret_1d over the results, NULLs dropped.
    Quirk kept: the raw days-in-market lags pred_dir_ens again inside the
    dropped frame and its leading NULL counts as in market.
    """
    by = by or ["symbol"]
    raw = lagged(results, F.col(raw_dir_col), "_lag", by, date_col, bucket)
    raw = raw.withColumn("r", F.col("_lag") * F.col(ret_col)).dropna(subset=["r"])
    raw = lagged(raw, F.col(raw_dir_col), "_lag", by, date_col, bucket)
    raw = raw.withColumn("in_market", F.coalesce(F.col("_lag") != 0, F.lit(True)))
    raw = raw.select(*by, date_col, F.lit("raw").alias("scenario"), "r", "in_market")
    filt = bt.select(*by, date_col, F.lit("filtered").alias("scenario"),
                     F.col("strat_ret").alias("r"), (F.col(position_col) != 0).alias("in_market"))
    m = _series_metrics(filt.unionByName(raw), by + ["scenario"], date_col, with_win=False, with_pf=False, bucket=bucket)
    return m.select(*by, "scenario", "ann_return", "sharpe", "max_drawdown", "days_in_market")


def threshold_sensitivity(results: DataFrame, thresholds: list[float] | None = None,
                          by: list[str] | None = None, date_col: str = "quote_date",
                          dir_col: str = "pred_dir_ens", up="proba_up_ens", down="proba_down_ens",
                          ret_col: str = "fwd_ret_1d", bucket: str | None = None) -> DataFrame:
    """Per threshold, direction zeroed when max(p_up, p_down) < thr, lagged, times return.

    The threshold fan-out is an ``explode`` of the (bounded) threshold list;
    windows partition by (symbol, threshold). Coverage counts the leading
    NULL lag as covered and is taken over all rows.
    """
    by = by or ["symbol"]
    thr = thresholds or sweep_thresholds()
    t = results.select(*by, date_col, dir_col, up, down, ret_col).withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(x)) for x in thr])))
    gated = F.when(F.greatest(F.col(up), F.col(down)) < F.col("threshold"), 0).otherwise(F.col(dir_col))
    keys = by + ["threshold"]
    t = lagged(t, gated, "_lag", keys, date_col, bucket)
    cov = t.groupBy(*keys).agg(F.avg(F.coalesce(F.col("_lag") != 0, F.lit(True)).cast("double")).alias("coverage"))
    long = t.withColumn("r", F.col("_lag") * F.col(ret_col)).dropna(subset=["r"]).select(*keys, date_col, "r")
    m = _series_metrics(long, keys, date_col, with_win=False, with_pf=False, dim_col=None, bucket=bucket)
    return (m.join(cov, keys, "inner")
            .select(*keys, "ann_return", "sharpe", "max_drawdown", "coverage"))


def _d(x):
    return None if x is None else (x if isinstance(x, _dt.date) else _dt.date.fromisoformat(str(x)))


def sub_periods(bt: DataFrame, periods: list[tuple[str, object, object]], min_rows: int = 20,
                by: list[str] | None = None, date_col: str = "quote_date",
                bucket: str | None = None) -> DataFrame:
    """B6 + J7: metrics per half-open [start, end) period (open ends allowed, periods may overlap).

    Period assignment explodes the small literal periods array and filters
    (a theta join without a join); equity restarts inside each period;
    periods with fewer than ``min_rows`` rows are skipped.
    """
    by = by or ["symbol"]
    arr = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(_d(s)).cast("date").alias("p_start"),
                             F.lit(_d(e)).cast("date").alias("p_end")) for n, s, e in periods])
    d = F.col(date_col)
    x = (bt.select(*by, date_col, F.col("strat_ret").alias("r"), F.explode(arr).alias("_p"))
         .select(*by, date_col, "r", "_p.*")
         .filter((d >= F.coalesce(F.col("p_start"), d)) & (F.col("p_end").isNull() | (d < F.col("p_end")))))
    keys = by + ["period"]
    m = _series_metrics(x, keys, date_col, with_win=True, with_pf=False, dim_col=None, bucket=bucket)
    return m.filter(F.col("n_days") >= min_rows).select(*keys, "n_days", "ann_return", "sharpe",
                                                        "max_drawdown", "win_rate")


def in_periods(rows: DataFrame, periods: DataFrame, date_col: str = "quote_date") -> DataFrame:
    """Rows with each period of a table (period, p_start, p_end) they lie in: half-open, NULL ends are open, periods may overlap.

    Periods are exploded into the months they touch, within the months of the rows (two scalars), and joined on the month;
    the exact bounds are a filter. A long period has one row a month, bounded by the calendar; a month with very many
    rows is split by the skew join of adaptive execution, and no nested loop is ever needed.
    """
    month = F.trunc(F.col(date_col).cast("date"), "MM")
    span = rows.agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    p = periods.select("period", F.col("p_start").cast("date").alias("p_start"), F.col("p_end").cast("date").alias("p_end"))
    p = p.withColumns({"_first": F.greatest(F.coalesce(F.trunc("p_start", "MM"), lo), lo),
                       "_last": F.least(F.coalesce(F.trunc(F.date_sub("p_end", 1), "MM"), hi), hi)})
    months = p.filter("_first <= _last").withColumn("_month", F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 MONTH")))).drop("_first", "_last")
    d = F.col(date_col)
    inside = (F.col("p_start").isNull() | (d >= F.col("p_start"))) & (F.col("p_end").isNull() | (d < F.col("p_end")))
    return rows.withColumn("_month", month).join(months, "_month").filter(inside).drop("_month", "p_start", "p_end")


def period_metrics(bt: DataFrame, periods: DataFrame, min_rows: int = 20, by: list[str] | None = None,
                   date_col: str = "quote_date", bucket: str | None = None) -> DataFrame:
    """B6 over a table of periods: as ``sub_periods``, for any number of them."""
    by = by or ["symbol"]
    x = in_periods(bt.select(*by, date_col, F.col("strat_ret").alias("r")), periods, date_col)
    m = _series_metrics(x, [*by, "period"], date_col, with_win=True, with_pf=False, dim_col=None, bucket=bucket)
    return m.filter(F.col("n_days") >= min_rows).select(*by, "period", "n_days", "ann_return", "sharpe", "max_drawdown", "win_rate")


def monthly_returns(bt: DataFrame, ret_col: str = "strat_ret", by: list[str] | None = None,
                    date_col: str = "quote_date") -> DataFrame:
    """Compounded return per calendar month end; empty months inside the range give 0.

    Months per symbol come from ``sequence`` over the symbol's own range (one
    row per month, bounded by the calendar), left-joined to the monthly
    products.
    """
    by = by or ["symbol"]
    m = (bt.groupBy(*by, F.last_day(date_col).alias("month_end"))
         .agg((F.product(1 + F.col(ret_col)) - 1).alias("ret")))
    rng = bt.groupBy(*by).agg(F.min(F.trunc(date_col, "MM")).alias("_lo"),
                              F.max(F.trunc(date_col, "MM")).alias("_hi"))
    months = rng.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    months = months.select(*by, F.last_day("_m").alias("month_end"))
    return (months.join(m, by + ["month_end"], "left")
            .withColumn("ret", F.coalesce(F.col("ret"), F.lit(0.0))))


def monthly_pivot(monthly: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Year x month table with 12 fixed month columns; missing cells NULL."""
    by = by or ["symbol"]
    p = (monthly.withColumns({"year": F.year("month_end"), "month": F.month("month_end")})
         .groupBy(*by, "year").pivot("month", list(range(1, 13))).agg(F.first("ret")))
    return p.withColumnsRenamed({str(i + 1): MONTH_NAMES[i] for i in range(12)})


def transaction_costs(bt: DataFrame, cost: float, by: list[str] | None = None,
                      date_col: str = "quote_date", position_col: str = "position_dir") -> DataFrame:
    """B9 [ext]: net return = strat_ret - abs(position change) * cost (start from flat)."""
    w = _series_window(by or ["symbol"], date_col)
    chg = F.abs(F.col(position_col) - F.coalesce(F.lag(position_col, 1).over(w), F.lit(0)))
    return bt.withColumn("net_ret", F.col("strat_ret") - chg * F.lit(float(cost)))


def hold_for_horizon(df: DataFrame, horizon: int | None = None, by: list[str] | None = None,
                     date_col: str = "quote_date", position_col: str = "position_dir",
                     ret_col: str = "fwd_ret_1d") -> DataFrame:
    """B10 [ext]: position = average of the last H lagged signals; return = that times fwd return."""
    h = DEFAULTS.horizon if horizon is None else horizon
    w = _series_window(by or ["symbol"], date_col).rowsBetween(-(h - 1), 0)
    out = df.withColumn("position_h", F.avg(position_col).over(w))
    return out.withColumn("hold_ret", F.col("position_h") * F.col(ret_col))
