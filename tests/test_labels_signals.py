import datetime as dt

import pytest

from chainsight.operators import labels, signals
from conftest import rows

D = dt.date(2024, 1, 1)


def day(i):
    return D + dt.timedelta(days=i)


def series(spark, prices, symbol="A"):
    return spark.createDataFrame([(symbol, day(i), p) for i, p in enumerate(prices)],
                                 "symbol string, quote_date date, und_price double")


def test_up_wins_when_both_hit_and_last_row_dropped(spark):
    df = series(spark, [100.0, 102.0, 97.0, 100.0])
    out = labels.path_labels(df, horizon=2).orderBy("quote_date")
    got = rows(out, "quote_date", "label")
    # row 0: path max +2 % and min -3 % -> Up wins; the last row has no path and is dropped
    assert got[0] == (day(0), 1)
    assert [d for d, _ in got] == [day(0), day(1), day(2)]
    # the tail row with a partial path (only one row ahead) is kept
    assert got[2][0] == day(2)


def test_require_full_path_drops_partial_tail(spark):
    df = series(spark, [100.0, 101.0, 102.0, 103.0])
    out = labels.path_labels(df, horizon=2, require_full_path=True)
    assert out.count() == 2


def test_null_prices_are_skipped_in_path(spark):
    df = spark.createDataFrame([("A", day(0), 100.0), ("A", day(1), None), ("A", day(2), 98.0), ("A", day(3), 99.0)],
                               "symbol string, quote_date date, und_price double")
    out = {r["quote_date"]: r["label"] for r in labels.path_labels(df, horizon=2).collect()}
    assert out[day(0)] == -1


def test_horizon_must_be_positive(spark):
    with pytest.raises(ValueError):
        labels.path_labels(series(spark, [1.0, 2.0]), horizon=0)


def test_symbols_do_not_mix(spark):
    df = series(spark, [100.0, 100.0], "A").unionByName(series(spark, [200.0, 100.0], "B"))
    out = labels.forward_returns(df)
    r = {(x["symbol"], x["quote_date"]): x["fwd_ret_1d"] for x in out.collect()}
    assert r[("A", day(0))] == 0.0 and r[("B", day(0))] == -0.5 and r[("A", day(1))] is None


def _proba(spark, data):
    return spark.createDataFrame(data, "symbol string, quote_date date, proba_down_ens double, "
                                       "proba_flat_ens double, proba_up_ens double, above_sma200 double, "
                                       "vol_regime double")


def test_gate_modes_on_null_and_zero_sma(spark):
    df = _proba(spark, [("A", day(0), 0.1, 0.2, 0.7, None, 1.0),    # long, sma unknown
                        ("A", day(1), 0.7, 0.2, 0.1, 0.0, 1.0),     # short, below sma
                        ("A", day(2), 0.1, 0.2, 0.7, 0.0, None),    # long, below sma, vol unknown
                        ("A", day(3), 0.1, 0.2, 0.7, 1.0, 0.0)])    # long, extreme vol
    b = dict(rows(signals.signal_gate(df, mode="batch"), "quote_date", "signal_dir"))
    live = dict(rows(signals.signal_gate(df, mode="live"), "quote_date", "signal_dir"))
    assert b == {day(0): 0, day(1): 0, day(2): 0, day(3): 0}
    assert live == {day(0): 1, day(1): -1, day(2): 0, day(3): 0}


def test_flat_filter_and_argmax_ties(spark):
    df = _proba(spark, [("A", day(0), 0.4, 0.4, 0.2, 1.0, 1.0), ("A", day(1), 0.45, 0.1, 0.45, 1.0, 1.0)])
    out = signals.ensemble_class(signals.signal_gate(df)).orderBy("quote_date")
    got = rows(out, "signal_dir", "pred_dir_ens")
    # tie down/flat: down wins the argmax, flat filter zeroes the signal
    assert got[0] == (0, -1)
    # tie up/down at 0.45: the up branch is tested first
    assert got[1] == (1, -1)


def test_weights_and_ensemble_sum_to_one(spark):
    folds = spark.createDataFrame([(0,), (1,), (2,), (4,)], "fold_id int")
    w = signals.fold_weights(folds, alpha=0.7)
    ws = dict(rows(w, "fold_id", "weight"))
    assert abs(sum(ws.values()) - 1) < 1e-12
    assert ws[4] > ws[2] > ws[1] > ws[0]
    assert abs(ws[4] / ws[2] - 1 / 0.7) < 1e-12   # fold 3 was skipped: rank, not id, sets the power
    m = spark.createDataFrame([("A", 0, 0.2, 0.3, 0.5), ("A", 4, 0.6, 0.3, 0.1), ("B", 9, 0.1, 0.1, 0.8)],
                              "symbol string, fold_id int, p_down double, p_flat double, p_up double")
    e = {r["symbol"]: r for r in signals.ensemble_average(m, w, ["symbol"]).collect()}
    a = e["A"]
    assert abs(a.proba_down_ens + a.proba_flat_ens + a.proba_up_ens - 1) < 1e-12
    # fold 9 has no weight: 1/3 each
    assert e["B"].proba_up_ens == pytest.approx(1 / 3)


def test_signal_report_labels(spark):
    df = spark.createDataFrame([(1, 0.123456), (-1, 0.5), (7, 0.2)], "signal_dir int, proba_up_ens double")
    got = rows(signals.signal_report(df), "Signal", "P(Up)")
    assert got == [("BUY", 0.1235), ("SELL", 0.5), ("FLAT", 0.2)]


def test_min_weight_skips_light_folds(spark):
    w = spark.createDataFrame([(0, 0.01), (1, 0.99)], "fold_id int, weight double")
    m = spark.createDataFrame([("A", 0, 1.0, 0.0, 0.0), ("A", 1, 0.0, 0.0, 1.0)],
                              "symbol string, fold_id int, p_down double, p_flat double, p_up double")
    e = signals.ensemble_average(m, w, ["symbol"], min_weight=0.05).first()
    assert e.proba_up_ens == 1.0 and e.proba_down_ens == 0.0
