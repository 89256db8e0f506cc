import datetime as dt
import random

import pytest

from chainsight.functions import columns as C
from chainsight.operators import chain, features
from conftest import rows

T = dt.date(2024, 3, 4)


def test_merge_keeps_last_duplicate_and_left_rows(spark):
    iv = spark.createDataFrame([(1, "S", T, "2024-03-15", "100", "CALL", "1", "2", "0.2", 100.0),
                                (2, "S", T, "2024-03-15", "105", "PUT", "", "2", "0.2", 100.0),
                                (3, "S", T, "2024-03-15", "110", "XYZ", "1", "1", "0.2", None)],
                               "seq long, symbol string, trade_date date, expiration string, strike string, "
                               "right_ string, bid string, ask string, implied_vol string, underlying_price double")
    oi = spark.createDataFrame([(5, "S", T, "2024-03-15", "100", "CALL", "10"),
                                (9, "S", T, "2024-03-15", "100", "CALL", "99")],
                               "seq long, symbol string, trade_date date, expiration string, strike string, "
                               "right_ string, open_interest string")
    ohlc = spark.createDataFrame([], "seq long, symbol string, trade_date date, expiration string, strike string, "
                                     "right_ string, close string, volume string")
    m = chain.merge_feeds(iv, oi, ohlc)
    got = {r["seq"]: r["open_interest"] for r in m.collect()}
    assert got == {1: "99", 2: None, 3: None}
    built = {r["Strike"]: r for r in chain.build_chain_rows(m).collect()}
    # empty bid dropped; unknown right passes through; band around spot 100 keeps 100 and 110
    assert set(built) == {100.0, 110.0}
    assert built[110.0]["righttype"] == "XYZ" and built[100.0]["righttype"] == "C"
    assert built[100.0]["Price"] == 1.5 and built[100.0]["OpenInterest"] == 99.0


def test_zero_mid_dropped_and_no_spot_keeps_all(spark):
    iv = spark.createDataFrame([(1, "S", T, "2024-03-15", "10", "PUT", "0", "0", "0.2", None),
                                (2, "S", T, "2024-03-15", "900", "PUT", "1", "3", "0.2", None)],
                               "seq long, symbol string, trade_date date, expiration string, strike string, "
                               "right_ string, bid string, ask string, implied_vol string, underlying_price double")
    e = spark.createDataFrame([], "seq long, symbol string, trade_date date, expiration string, strike string, "
                                  "right_ string, open_interest string")
    e2 = spark.createDataFrame([], "seq long, symbol string, trade_date date, expiration string, strike string, "
                                   "right_ string, close string, volume string")
    out = chain.build_chain_rows(chain.merge_feeds(iv, e, e2))
    assert rows(out, "Strike", "Price") == [(900.0, 2.0)]


def test_third_friday_and_date_parsers(spark):
    df = spark.createDataFrame([("2026-03-09", "20260315 10:00:00", "20260320")], "a string, b string, c string")
    r = df.select(C.third_friday(C.expiry_date("a")).alias("tf"), C.yyyymmdd_date("b").alias("d"),
                  C.expiry_date("c").alias("e"), C.iso_date_prefix(F_lit("junk")).alias("j")).first()
    assert r["tf"] == dt.date(2026, 3, 20) and r["d"] == dt.date(2026, 3, 15)
    assert r["e"] == dt.date(2026, 3, 20) and r["j"] is None


def F_lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)


def test_norm_cdf_accuracy(spark):
    import math
    xs = [-3.0, -1.0, -0.25, 0.0, 0.5, 2.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(C.norm_cdf("x")).collect()]
    for x, g in zip(xs, got):
        assert abs(g - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1e-7


def test_max_pain_prefix_sums_equal_brute_force(spark):
    rnd = random.Random(7)
    data = []
    for d in range(3):
        for k in range(20):
            strike = 300.0 + 5 * k
            data.append(("S", T + dt.timedelta(days=d), strike, float(rnd.randint(0, 50)), float(rnd.randint(0, 50))))
    df = spark.createDataFrame(data, "symbol string, trade_date date, strike double, call_oi double, put_oi double")
    got = dict(rows(features.max_pain(df), "trade_date", "max_pain_strike"))
    for d in range(3):
        day = [x for x in data if x[1] == T + dt.timedelta(days=d)]

        def pain(K):
            return sum(c * max(K - k, 0) + p * max(k - K, 0) for _, _, k, c, p in day)
        best = min((pain(k), k) for _, _, k, _, _ in day)[1]
        assert got[T + dt.timedelta(days=d)] == best


def test_chain_features_on_tiny_chain(spark):
    exp = T + dt.timedelta(days=11)
    back = T + dt.timedelta(days=39)
    c = spark.createDataFrame([
        ("S", T, exp, 95.0, "P", 300.0, 0.25), ("S", T, exp, 100.0, "P", 100.0, 0.2),
        ("S", T, exp, 100.0, "C", 200.0, 0.22), ("S", T, exp, 110.0, "C", 500.0, 0.18),
        ("S", T, back, 100.0, "C", 50.0, 0.2), ("S", T, back, 100.0, "P", 150.0, 0.2),
        ("S", T, T - dt.timedelta(days=1), 100.0, "C", 999.0, 0.2)],   # expired: ignored
        "symbol string, trade_date date, expiry date, strike double, right_ string, oi double, iv double")
    spot = spark.createDataFrame([("S", T, 101.0)], "symbol string, trade_date date, und_price double")
    f = features.chain_features(c, spot).first()
    assert f["pc_ratio_front"] == pytest.approx(400 / 700)
    assert f["pc_ratio_back"] == pytest.approx(3.0)
    assert f["call_wall_dist_pct"] == pytest.approx((110 - 101) / 101)
    assert f["put_wall_dist_pct"] == pytest.approx((95 - 101) / 101)
    assert f["atm_iv"] == pytest.approx(0.21)
    assert f["dte_front"] == 11
    assert f["oi_concentration"] == pytest.approx((300 ** 2 + 300 ** 2 + 500 ** 2) / 1100 ** 2)
    assert f["gex_flip"] in (0, 1) and f["net_gex"] is not None


def test_price_features_windows(spark):
    data = [("A", T + dt.timedelta(days=i), 100.0 + i) for i in range(260)]
    df = spark.createDataFrame(data, "symbol string, quote_date date, close double")
    out = features.price_features(df).orderBy("quote_date").collect()
    assert out[198]["sma_200"] is None and out[199]["sma_200"] == pytest.approx(sum(100.0 + i for i in range(200)) / 200)
    assert out[19]["vol_20d"] is None and out[20]["vol_20d"] is not None
    assert out[20]["ret_20d"] == pytest.approx(120 / 100 - 1)
    assert features.history_gate(df, 270).count() == 0 and features.history_gate(df, 260).count() == 260
