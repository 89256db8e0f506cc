"""Stand-in inputs derived from the driver's TPC-H-ish tables.

The reference ships no data, so each input it consumes (daily closes, chain
feeds, ticks, ensemble probabilities, ...) is re-created here from
``orders``/``lineitem``/``events`` with DataFrame operations only. Every view
scales with the base tables; nothing is made up in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes: one row per (priority, order date), close from the highest order key."""
    o = _orders(spark, sf_dir)
    return (o.groupBy(F.col("o_orderpriority").alias("symbol"),
                      F.col("o_orderdate").cast("date").alias("quote_date"))
            .agg((F.lit(400) + F.max_by("o_totalprice", "o_orderkey") / 40000).alias("close")))


def und(spark: SparkSession, sf_dir: str, px_df: DataFrame | None = None) -> DataFrame:
    """Weekly spot: last close of each (symbol, Monday-week)."""
    p = px_df if px_df is not None else px(spark, sf_dir)
    return (p.groupBy("symbol", F.trunc("quote_date", "week").alias("trade_date"))
            .agg(F.max_by("close", "quote_date").alias("und_price")))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "lineitem")
    week = F.trunc(F.col("l_shipdate").cast("date"), "week")
    return l.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000
         + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        F.when(F.col("l_suppkey") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("symbol"),
        week.alias("trade_date"),
        F.date_add(week, (4 + 28 * (F.col("l_linenumber") - 1)).cast("int")).alias("expiry"),
        (F.lit(400) + ((F.col("l_partkey") % 41) - 20) * 5).alias("k"),
        F.when(F.col("l_linestatus") == "F", "CALL")
         .when(F.col("l_linestatus") == "O", "PUT").alias("right_code"),
        F.floor(F.col("l_extendedprice") / 1000).cast("bigint").alias("bid_i"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("spread_i"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc_i"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("ln"),
    )


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def iv_feed(spark: SparkSession, sf_dir: str, legs_df: DataFrame | None = None,
            und_df: DataFrame | None = None) -> DataFrame:
    """Implied-vol feed rows (all text, like a vendor CSV) with the spot attached."""
    lg = legs_df if legs_df is not None else legs(spark, sf_dir)
    u = und_df if und_df is not None else und(spark, sf_dir)
    j = lg.join(F.broadcast(u), ["symbol", "trade_date"], "left")  # one spot a symbol and week: the legs stay where they are
    return j.select(
        "seq", "symbol", "trade_date",
        _s("expiry").alias("expiration"), _s("k").alias("strike"),
        F.col("right_code").alias("right_"),
        F.when((F.col("flag") == "N") & (F.col("ln") == 7), F.lit("")).otherwise(_s("bid_i")).alias("bid"),
        _s(F.col("bid_i") + F.col("spread_i")).alias("ask"),
        F.concat(F.lit("0."), _s(10 + 2 * F.col("disc_i"))).alias("implied_vol"),
        F.col("und_price").alias("underlying_price"),
    )


def oi_feed(spark: SparkSession, sf_dir: str, legs_df: DataFrame | None = None) -> DataFrame:
    lg = legs_df if legs_df is not None else legs(spark, sf_dir)
    return lg.filter(F.col("flag") != "R").select(
        "seq", "symbol", "trade_date", _s("expiry").alias("expiration"), _s("k").alias("strike"),
        F.col("right_code").alias("right_"), _s(F.col("qty") * 10).alias("open_interest"))


def ohlc_feed(spark: SparkSession, sf_dir: str, legs_df: DataFrame | None = None) -> DataFrame:
    lg = legs_df if legs_df is not None else legs(spark, sf_dir)
    return lg.filter(F.col("flag") != "N").select(
        "seq", "symbol", "trade_date", _s("expiry").alias("expiration"), _s("k").alias("strike"),
        F.col("right_code").alias("right_"),
        F.when(F.col("ln") == 6, F.lit("")).otherwise(_s("bid_i")).alias("close"),
        _s("qty").alias("volume"))


def chain(spark: SparkSession, sf_dir: str, legs_df: DataFrame | None = None) -> DataFrame:
    """Normalised chain at contract grain: (symbol, trade_date, expiry, strike, right_)."""
    lg = legs_df if legs_df is not None else legs(spark, sf_dir)
    return (lg.groupBy("symbol", "trade_date", "expiry",
                       F.col("k").cast("double").alias("strike"),
                       F.when(F.col("right_code") == "CALL", "C").otherwise("P").alias("right_"))
            .agg((F.sum("qty") * 10).cast("double").alias("oi"),
                 F.round(F.avg(10 + 2 * F.col("disc_i")) / 100, 6).alias("iv")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    code = (F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2)
            .when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 9)
            .otherwise(99))
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("req_id"),
                    code.alias("tick_type"), "value")


def tick_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of all three kinds: prices, sizes (with unknown codes) and option computations."""
    e = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "purchase"), "price").when(F.col("event_type") == "signup", "option").otherwise("size")
    code = (F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 5 == 0, 8).otherwise(1))
            .when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", F.when(F.col("event_id") % 4 == 0, 10).otherwise(13))
            .when(F.col("event_id") % 3 == 0, 27).when(F.col("event_id") % 3 == 1, 28).otherwise(F.when(F.col("event_id") % 2 == 0, 1).otherwise(8)))
    v = F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value"))
    opt = {"iv": F.col("value") / 1000, "delta": F.col("value") / 500 - 0.5, "gamma": F.col("value") / 10000, "theta": -F.col("value") / 100,
           "vega": F.col("value") / 50, "opt_price": F.when(F.col("event_id") % 11 == 0, -1.0).otherwise(F.col("value") / 10), "und_price": F.col("value") + 400}
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("req_id"), kind.alias("kind"), code.alias("tick_type"), v.alias("value"),
                    *[F.when(F.col("event_type") == "signup", x).alias(n) for n, x in opt.items()])


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract per market-data request of ``tick_feed``."""
    r = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("req_id")).distinct()
    return r.select("req_id", F.when(F.col("req_id") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("symbol"), F.lit("2024-06-21").alias("expiry"),
                    (400 + 5 * (F.col("req_id") % 41)).cast("double").alias("strike"), F.when(F.col("req_id") % 3 == 0, "P").otherwise("C").alias("right_"))


def signal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features per (symbol, day) with the context columns of ``proba``."""
    return proba(spark, sf_dir).select("symbol", "quote_date", (F.dayofmonth("quote_date") % 7).cast("double").alias("f1"),
                                       F.when(F.dayofmonth("quote_date") != 13, (F.month("quote_date") % 3).cast("double")).alias("f2"),
                                       F.col("above_sma200").cast("double").alias("above_sma200"), F.col("vol_regime").cast("double").alias("vol_regime"))


def fixed_ensemble(spark: SparkSession, symbols: list[str]):
    """A stated three-fold softmax ensemble: (features, coefficients, scalers, weights)."""
    coefs = [(s, f, [x for k in range(3) for x in (0.1 * k - 0.05 * f, 0.9 * (k - 1), 0.4 * (f + 1) * (1 - k))]) for s in symbols for f in range(3)]
    scalers = [(s, f, 3.0, 2.0, 1.0, 1.0 + f) for s in symbols for f in range(3)]
    weights = [(s, f, w) for s in symbols for f, w in enumerate((0.0, 0.4, 0.6))]
    return (["f1", "f2"], spark.createDataFrame(coefs, "symbol string, fold_id int, coef array<double>"),
            spark.createDataFrame(scalers, "symbol string, fold_id int, mean_f1 double, scale_f1 double, mean_f2 double, scale_f2 double"),
            spark.createDataFrame(weights, "symbol string, fold_id int, weight double"))


def _abc(p: DataFrame) -> DataFrame:
    d = F.col("d")
    return p.select(
        "symbol", "quote_date", "close", F.dayofmonth("quote_date").alias("d"),
        (1 + F.dayofmonth("quote_date") % 7).cast("double").alias("a"),
        (1 + F.month("quote_date") % 3).cast("double").alias("b"),
        (1 + F.dayofyear("quote_date") % 5).cast("double").alias("c"),
    ).withColumn("d", d)


def proba(spark: SparkSession, sf_dir: str, px_df: DataFrame | None = None) -> DataFrame:
    """Deterministic ensemble probabilities and regime flags per (symbol, day)."""
    t = _abc(px_df if px_df is not None else px(spark, sf_dir))
    tot = F.col("a") + F.col("b") + F.col("c")
    return t.select(
        "symbol", "quote_date", "close",
        (F.col("a") / tot).alias("proba_up_ens"), (F.col("b") / tot).alias("proba_flat_ens"),
        (F.col("c") / tot).alias("proba_down_ens"),
        F.when(F.col("d") == 31, None).when(F.col("d") % 4 == 0, 0).otherwise(1).alias("above_sma200"),
        F.when(F.col("d") % 9 == 0, 0).otherwise(1).alias("vol_regime"),
    )


MEMBER_FOLDS = (0, 1, 2, 4)


def members(spark: SparkSession, sf_dir: str, px_df: DataFrame | None = None) -> DataFrame:
    """Per-fold member probabilities; fold 3 was skipped by the size gate (ids 0, 1, 2, 4)."""
    t = _abc(px_df if px_df is not None else px(spark, sf_dir))
    t = t.withColumn("fold_id", F.explode(F.array(*[F.lit(i) for i in MEMBER_FOLDS])))
    tot = F.col("a") + F.col("b") + F.col("c") + F.col("fold_id")
    return t.select("symbol", "quote_date", "fold_id",
                    ((F.col("a") + F.col("fold_id")) / tot).alias("p_up"),
                    (F.col("b") / tot).alias("p_flat"), (F.col("c") / tot).alias("p_down"))


def price_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    return o.select(
        k.alias("seq"), F.col("o_orderpriority").alias("symbol"),
        F.when(k % 50 == 0, "").when(k % 51 == 0, "junk-date-")
         .otherwise(F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T16:00:00")))
         .alias("created"),
        F.when(k % 53 == 0, "").when(k % 59 == 0, "bad")
         .otherwise(F.floor("o_totalprice").cast("bigint").cast("string")).alias("close"),
    )


def stored(spark: SparkSession, sf_dir: str, px_df: DataFrame | None = None) -> DataFrame:
    p = px_df if px_df is not None else px(spark, sf_dir)
    return p.filter((F.col("quote_date") < F.lit("2000-01-01").cast("date")) & (F.col("symbol") != "5-LOW"))


def expirations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return o.select(F.col("o_orderpriority").alias("symbol"),
                    F.col("o_orderdate").cast("date").cast("string").alias("expiration")).distinct()


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-bar text feed (time 'YYYYMMDD[ hh:mm:ss]', OHLCV) made from ``orders``.

    One bar per order: time text from the order date (every third with a time
    suffix), close = total price / 1000; several bars can share a day, so the
    keep-first dedupe (D2) matters.
    """
    o = _orders(spark, sf_dir)
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit(" 16:00:00"))).otherwise(day).alias("time"),
        (F.col("o_totalprice") / 1000).alias("close"),
        F.col("o_custkey").cast("double").alias("volume"),
    )
