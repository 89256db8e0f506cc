import datetime as dt
import math

import pytest

from chainsight.operators import backtest
from conftest import rows

D = dt.date(2020, 1, 1)


def bt_frame(spark, rets, pos=None):
    pos = pos or [1] * len(rets)
    data = [("A", D + dt.timedelta(days=i), p, r) for i, (p, r) in enumerate(zip(pos, rets))]
    df = spark.createDataFrame(data, "symbol string, quote_date date, position_dir int, fwd_ret_1d double")
    return backtest.daily_pnl(df)


def test_profit_factor_without_losses_is_null(spark):
    perf = backtest.performance(bt_frame(spark, [0.01, 0.02, 0.0]))
    s = {r["series"]: r for r in perf.collect()}["strategy"]
    assert s["profit_factor"] is None
    assert s["win_rate"] == 1.0
    assert s["max_drawdown"] == 0.0


def test_metrics_match_direct_formulas(spark):
    rets = [0.01, -0.02, 0.03, -0.01, 0.005]
    perf = {r["series"]: r for r in backtest.performance(bt_frame(spark, rets)).collect()}
    s = perf["strategy"]
    eq, e = [], 1.0
    for r in rets:
        e *= 1 + r
        eq.append(e)
    mean = sum(rets) / len(rets)
    sd = math.sqrt(sum((r - mean) ** 2 for r in rets) / (len(rets) - 1))
    peak, dd = -1e9, 0.0
    for v in eq:
        peak = max(peak, v)
        dd = min(dd, (v - peak) / peak)
    assert s["total_return"] == pytest.approx(eq[-1] - 1)
    assert s["ann_return"] == pytest.approx(eq[-1] ** (252 / len(rets)) - 1)
    assert s["sharpe"] == pytest.approx(mean / sd * math.sqrt(252))
    assert s["max_drawdown"] == pytest.approx(dd)
    assert s["max_drawdown"] <= 0
    assert s["profit_factor"] == pytest.approx(0.045 / 0.03)
    assert perf["benchmark"]["days_in_market"] == 1.0


def test_sub_period_covering_everything_equals_performance(spark):
    bt = bt_frame(spark, [0.01, -0.02, 0.03, -0.01, 0.005] * 5)
    sp = backtest.sub_periods(bt, [("all", None, None)], min_rows=20).first()
    pf = {r["series"]: r for r in backtest.performance(bt).collect()}["strategy"]
    for k in ("ann_return", "sharpe", "max_drawdown", "win_rate"):
        assert sp[k] == pytest.approx(pf[k])


def test_sub_periods_overlap_and_skip_short(spark):
    bt = bt_frame(spark, [0.01] * 40)
    per = [("first", None, D + dt.timedelta(days=25)), ("overlap", D + dt.timedelta(days=10), None),
           ("short", D + dt.timedelta(days=38), None)]
    got = dict(rows(backtest.sub_periods(bt, per), "period", "n_days"))
    assert got == {"first": 25, "overlap": 30}


def test_monthly_returns_fill_empty_months(spark):
    data = [("A", dt.date(2020, 1, 15), 1, 0.1), ("A", dt.date(2020, 3, 2), 1, -0.5)]
    df = spark.createDataFrame(data, "symbol string, quote_date date, position_dir int, fwd_ret_1d double")
    m = dict(rows(backtest.monthly_returns(backtest.daily_pnl(df)), "month_end", "ret"))
    assert m[dt.date(2020, 2, 29)] == 0.0 and m[dt.date(2020, 1, 31)] == pytest.approx(0.1)
    piv = backtest.monthly_pivot(backtest.monthly_returns(backtest.daily_pnl(df))).first()
    assert piv["Feb"] == 0.0 and piv["Apr"] is None


def test_threshold_coverage_counts_leading_null(spark):
    data = [("A", D + dt.timedelta(days=i), 1, 0.5, 0.1, 0.01) for i in range(4)]
    df = spark.createDataFrame(data, "symbol string, quote_date date, pred_dir_ens int, proba_up_ens double, "
                                     "proba_down_ens double, fwd_ret_1d double")
    t = {r["threshold"]: r for r in backtest.threshold_sensitivity(df, [0.3, 0.6]).collect()}
    assert t[0.3]["coverage"] == 1.0
    assert t[0.6]["coverage"] == 0.25   # only the leading NULL lag counts as covered


def test_two_level_curves_equal_plain(spark):
    import random
    rnd = random.Random(5)
    data = [("A", D + dt.timedelta(days=i), 1, rnd.uniform(-0.03, 0.03)) for i in range(400)]
    data += [("B", D + dt.timedelta(days=i), 1, rnd.uniform(-0.03, 0.03)) for i in range(0, 400, 3)]
    df = spark.createDataFrame(data, "symbol string, quote_date date, position_dir int, fwd_ret_1d double")
    plain = backtest.drawdown(backtest.equity_curve(df, "fwd_ret_1d", "eq"), "eq")
    two = backtest.drawdown(backtest.equity_curve(df, "fwd_ret_1d", "eq", bucket="month"), "eq", bucket="month")
    a = {(r["symbol"], r["quote_date"]): (r["eq"], r["running_max"], r["drawdown"]) for r in plain.collect()}
    b = {(r["symbol"], r["quote_date"]): (r["eq"], r["running_max"], r["drawdown"]) for r in two.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == pytest.approx(y, rel=1e-12, abs=1e-12)


def test_two_level_metrics_equal_plain(spark):
    import random
    rnd = random.Random(8)
    data = [(s, D + dt.timedelta(days=i), rnd.choice([-1, 0, 1, None]), rnd.choice([-1, 0, 1]), rnd.random(), rnd.random(),
             rnd.uniform(-0.03, 0.03) if rnd.random() > 0.1 else None)
            for s, step in (("A", 1), ("B", 40)) for i in range(0, 400, step)]
    df = spark.createDataFrame(data, "symbol string, quote_date date, pred_dir_ens int, position_dir int, "
                                     "proba_up_ens double, proba_down_ens double, fwd_ret_1d double")
    bt = backtest.daily_pnl(df)
    per = [("all", None, None), ("late", D + dt.timedelta(days=100), None)]
    for make, keys in ((lambda b: backtest.performance(bt, bucket=b), ["symbol", "series"]),
                       (lambda b: backtest.filter_impact(df, bt, bucket=b), ["symbol", "scenario"]),
                       (lambda b: backtest.threshold_sensitivity(df, [0.4, 0.8], bucket=b), ["symbol", "threshold"]),
                       (lambda b: backtest.sub_periods(bt, per, min_rows=5, bucket=b), ["symbol", "period"])):
        plain, two = ({tuple(r[k] for k in keys): r.asDict() for r in make(b).collect()} for b in (None, "month"))
        assert plain and plain.keys() == two.keys()
        for k, r in plain.items():
            for c, x in r.items():
                assert two[k][c] == (x if x is None or isinstance(x, str) else pytest.approx(x, rel=1e-9, abs=1e-12)), (k, c)
