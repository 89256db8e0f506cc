"""Options-microstructure and price features.

The reference names and describes these features but does not publish the
code that builds them, so the formulas here are this library's contract:

* F0   expiry rank per (symbol, day): dte = expiry - day (kept if >= 0); 1 = front, 2 = back.
* F1/2 put OI / call OI of the front / back expiry.
* F3/4 (K - S) / S with K the call / put strike of largest front OI (tie: nearest S, then lowest).
* F5   F3 - F4.
* F6   Herfindahl of front OI over strikes: sum(OI_k^2) / (sum OI_k)^2.
* F7   (K* - S) / S, K* the front strike minimising writer payout
       pain(K) = sum_calls OI (K - k)+ + sum_puts OI (k - K)+ (tie: lowest K).
* F8/9 net gamma exposure sum(gamma * OI * 100 * S), calls +, puts -, front / back.
* F10  1 if net_gex < 0 else 0 (NULL if net_gex is NULL).
* F11  mean IV of the front contracts at the strike nearest S (tie: lower strike).
* F12  IV of the front put with |delta| nearest 0.25 minus the same for calls (tie: lower strike).
* F13  days to the front expiry.
* F14-F21 price features on the daily close series; F22 history gate; F23 Black-Scholes
  gamma/delta (r = 0, T = dte/365) where the chain has none.

Chain work is keyed by (symbol, trade_date[, expiry, strike]) so no task
holds more than one day of one symbol; strike-level windows (max pain) run
on the per-strike aggregate, bounded by the strikes listed for one expiry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import columns as C

DAY = ["symbol", "trade_date"]

CHAIN_FEATURES = ["pc_ratio_front", "pc_ratio_back", "call_wall_dist_pct", "put_wall_dist_pct",
                  "wall_spread_pct", "net_gex", "net_gex_back", "gex_flip", "max_pain_dist_pct",
                  "atm_iv", "iv_skew", "oi_concentration", "dte_front"]
PRICE_FEATURES = ["sma_200", "above_sma200", "ret_20d", "ret_60d", "vol_20d", "daily_ret", "vol_5d",
                  "vol_regime"]


# ---------------------------------------------------------------- F0, F23

def expiry_ranks(chain: DataFrame, expiry_col: str = "expiry") -> DataFrame:
    """dte and expiry rank per (symbol, trade_date), ranked on the distinct-expiry table."""
    e = chain.select(*DAY, C.expiry_date(F.col(expiry_col).cast("string")).alias("expiry")).distinct()
    e = e.withColumn("dte", F.datediff("expiry", "trade_date")).filter(F.col("dte") >= 0)
    w = Window.partitionBy(*DAY).orderBy("expiry")
    return e.withColumn("exp_rank", F.dense_rank().over(w))


def with_greeks(c: DataFrame, spot_col: str = "und_price") -> DataFrame:
    """gamma and delta from IV, S, K, T = dte / 365 (r = 0) unless the chain carries them."""
    t = F.col("dte") / 365.0
    valid = (F.col(spot_col) > 0) & (F.col("strike") > 0) & (F.col("iv") > 0) & (F.col("dte") > 0)
    gamma = F.when(valid, C.bs_gamma(spot_col, "strike", "iv", t))
    delta = F.when(valid, C.bs_delta(spot_col, "strike", "iv", t, "right_"))
    out = c
    out = out.withColumn("gamma", F.coalesce(F.col("gamma"), gamma) if "gamma" in c.columns else gamma)
    out = out.withColumn("delta", F.coalesce(F.col("delta"), delta) if "delta" in c.columns else delta)
    return out


def prepared_chain(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """F0 + F23: front/back contracts with dte, rank, spot S and greeks."""
    ranks = expiry_ranks(chain).filter(F.col("exp_rank") <= 2)
    c = (chain.withColumn("expiry", C.expiry_date(F.col("expiry").cast("string")))
         .join(ranks, DAY + ["expiry"], "inner")
         .join(spot.select(*DAY, "und_price"), DAY, "inner"))
    return with_greeks(c)


# ---------------------------------------------------------------- chain features

def _strike_table(front: DataFrame) -> DataFrame:
    """Per (symbol, day, strike) aggregate of the front expiry: call/put OI, IV sums."""
    is_c = F.col("right_") == "C"
    return front.groupBy(*DAY, "strike").agg(
        F.first("und_price").alias("S"),
        F.sum(F.when(is_c, F.col("oi"))).alias("call_oi"),
        F.sum(F.when(~is_c, F.col("oi"))).alias("put_oi"),
        F.sum("oi").alias("oi"),
        F.sum("iv").alias("iv_sum"), F.count("iv").alias("iv_n"))


def _pain(strikes: DataFrame) -> DataFrame:
    """The strike table with the pain of settling at each strike, by prefix sums (no strike x strike join).

    pain(K) = K * Cc(<=K) - Cw(<=K) + (Pw_tot - Pw(<=K)) - K * (Pc_tot - Pc(<=K)),
    Cc/Cw cumulative call OI and OI * strike, Pc/Pw the same for puts.
    """
    run = Window.partitionBy(*DAY).orderBy("strike").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy(*DAY)
    co, po = F.coalesce(F.col("call_oi"), F.lit(0.0)), F.coalesce(F.col("put_oi"), F.lit(0.0))
    k = F.col("strike")
    s = strikes.withColumns({
        "_cc": F.sum(co).over(run), "_cw": F.sum(co * k).over(run),
        "_pc": F.sum(po).over(run), "_pw": F.sum(po * k).over(run),
        "_pct": F.sum(po).over(tot), "_pwt": F.sum(po * k).over(tot)})
    pain = k * F.col("_cc") - F.col("_cw") + (F.col("_pwt") - F.col("_pw")) - k * (F.col("_pct") - F.col("_pc"))
    return s.withColumn("pain", pain)


_MAX_PAIN = ("strike", ("pain", "strike"))


def max_pain(strikes: DataFrame) -> DataFrame:
    """the strike of least pain per (symbol, day), ties to the lower strike."""
    return _pain(strikes).groupBy(*DAY).agg(F.min_by(_MAX_PAIN[0], F.struct(*_MAX_PAIN[1])).alias("max_pain_strike"))


def chain_features(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """F1-F13 per (symbol, trade_date) from a contract-grain chain
    (symbol, trade_date, expiry, strike, right_ C/P, oi, iv[, gamma, delta]) and spot
    (symbol, trade_date, und_price)."""
    c = prepared_chain(chain, spot)
    is_c, is_p = F.col("right_") == "C", F.col("right_") == "P"
    front, back = F.col("exp_rank") == 1, F.col("exp_rank") == 2
    gex = F.col("gamma") * F.col("oi") * 100 * F.col("und_price") * F.when(is_c, 1.0).when(is_p, -1.0)
    dist = F.abs(F.col("strike") - F.col("und_price"))
    delta_gap = F.abs(F.abs(F.col("delta")) - 0.25)
    S = F.first("und_price")
    base = c.groupBy(*DAY).agg(
        S.alias("S"),
        F.try_divide(F.sum(F.when(front & is_p, F.col("oi"))), F.sum(F.when(front & is_c, F.col("oi")))).alias("pc_ratio_front"),
        F.try_divide(F.sum(F.when(back & is_p, F.col("oi"))), F.sum(F.when(back & is_c, F.col("oi")))).alias("pc_ratio_back"),
        F.sum(F.when(front, gex)).alias("net_gex"),
        F.sum(F.when(back, gex)).alias("net_gex_back"),
        F.min(F.when(front, F.col("dte"))).alias("dte_front"),
        F.min_by(F.when(front & is_p, F.col("iv")),
                 F.when(front & is_p & F.col("delta").isNotNull(), F.struct(delta_gap, F.col("strike")))).alias("_put_iv"),
        F.min_by(F.when(front & is_c, F.col("iv")),
                 F.when(front & is_c & F.col("delta").isNotNull(), F.struct(delta_gap, F.col("strike")))).alias("_call_iv"),
        F.max_by(F.when(front & is_c, F.col("strike")),
                 F.when(front & is_c, F.struct(F.col("oi"), -dist, -F.col("strike")))).alias("_kc"),
        F.max_by(F.when(front & is_p, F.col("strike")),
                 F.when(front & is_p, F.struct(F.col("oi"), -dist, -F.col("strike")))).alias("_kp"),
    )
    # windows and aggregate of the strike table share one partitioning by (symbol, day)
    strikes = _pain(_strike_table(c.filter(front))).groupBy(*DAY).agg(
        F.min_by(_MAX_PAIN[0], F.struct(*_MAX_PAIN[1])).alias("max_pain_strike"),
        F.try_divide(F.sum(F.col("oi") * F.col("oi")), F.pow(F.sum("oi"), 2)).alias("oi_concentration"),
        F.min_by(F.try_divide(F.col("iv_sum"), F.col("iv_n").cast("double")),
                 F.struct(F.abs(F.col("strike") - F.col("S")), F.col("strike"))).alias("atm_iv"))
    out = base.join(strikes, DAY, "left")
    Sx = F.col("S")
    out = out.withColumns({
        "call_wall_dist_pct": F.try_divide(F.col("_kc") - Sx, Sx),
        "put_wall_dist_pct": F.try_divide(F.col("_kp") - Sx, Sx),
        "max_pain_dist_pct": F.try_divide(F.col("max_pain_strike") - Sx, Sx),
        "iv_skew": F.col("_put_iv") - F.col("_call_iv"),
        "gex_flip": F.when(F.col("net_gex").isNotNull(), F.when(F.col("net_gex") < 0, 1).otherwise(0)),
    }).withColumn("wall_spread_pct", F.col("call_wall_dist_pct") - F.col("put_wall_dist_pct"))
    return out.select(*DAY, *CHAIN_FEATURES)


# ---------------------------------------------------------------- price features

def price_features(px: DataFrame, price_col: str = "close", date_col: str = "quote_date",
                   symbol_col: str = "symbol") -> DataFrame:
    """F14-F21 on a daily close series (one row per symbol and day)."""
    w = Window.partitionBy(symbol_col).orderBy(date_col)
    p = F.col(price_col)

    def frame(n):
        return w.rowsBetween(-(n - 1), 0)

    out = px.withColumns({
        "_rn": F.row_number().over(w),
        "daily_ret": F.try_divide(p, F.lag(p, 1).over(w)) - 1,
        "ret_20d": F.try_divide(p, F.lag(p, 20).over(w)) - 1,
        "ret_60d": F.try_divide(p, F.lag(p, 60).over(w)) - 1,
        "_sma": F.avg(p).over(frame(200)),
    })
    out = out.withColumn("sma_200", F.when(F.col("_rn") >= 200, F.col("_sma")))
    out = out.withColumn("above_sma200", F.when(F.col("sma_200").isNotNull(),
                                                F.when(p > F.col("sma_200"), 1).otherwise(0)))
    r = F.col("daily_ret")
    out = out.withColumns({
        "vol_20d": F.when(F.count(r).over(frame(20)) == 20, F.stddev_samp(r).over(frame(20))),
        "vol_5d": F.when(F.count(r).over(frame(5)) == 5, F.stddev_samp(r).over(frame(5))),
    })
    out = out.withColumn("_vmean", F.avg("vol_20d").over(frame(252)))
    out = out.withColumn("vol_regime", F.when(F.col("vol_20d").isNotNull(),
                                              F.when(F.col("vol_20d") > 2 * F.col("_vmean"), 0).otherwise(1)))
    return out.drop("_rn", "_sma", "_vmean")


def history_gate(px: DataFrame, min_rows: int | None = None, symbol_col: str = "symbol") -> DataFrame:
    """keep symbols with at least ``min_rows`` rows (partial count + semi join, skew-safe)."""
    n = DEFAULTS.min_history_rows if min_rows is None else min_rows
    ok = px.groupBy(symbol_col).count().filter(F.col("count") >= n).select(symbol_col)
    return px.join(ok, symbol_col, "left_semi")


def feature_table(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """Feature table (symbol, quote_date, und_price, F1-F21): chain features joined with
    price features computed on the spot series."""
    s = spot.select("symbol", F.col("trade_date").alias("quote_date"), "und_price")
    pf = price_features(s, price_col="und_price")
    cf = chain_features(chain, spot).withColumnRenamed("trade_date", "quote_date")
    return cf.join(pf, ["symbol", "quote_date"], "inner").select(
        "symbol", "quote_date", "und_price", *CHAIN_FEATURES, *PRICE_FEATURES)
