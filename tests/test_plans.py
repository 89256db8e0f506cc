import tempfile

from pyspark.sql import functions as F

from chainsight.operators import chain, features, labels, model, walkforward as wf
from chainsight.plans import daily, research
from chainsight.sources import fixtures as fx
from chainsight.sources import sinks
from chainsight.streaming import jobs


def test_research_run_end_to_end(spark, sf):
    ft = features.feature_table(fx.chain(spark, sf), fx.und(spark, sf))
    out = research.research_run(ft, periods=[("all", None, None)])
    perf = {(r["symbol"], r["series"]) for r in out.performance.collect()}
    syms = {r["symbol"] for r in out.results.select("symbol").distinct().collect()}
    assert perf == {(s, x) for s in syms for x in ("strategy", "benchmark")}
    assert out.thresholds.count() == 10 * len(syms)
    assert out.fold_metrics.count() > 0 and out.sub_periods.count() == len(syms)
    assert out.results.filter(~F.col("signal_dir").isin(-1, 0, 1)).count() == 0


def test_daily_jobs(spark, sf):
    root = tempfile.mkdtemp(prefix="cs-daily-", dir="/tmp")
    lg = fx.legs(spark, sf)
    daily.ingest_snapshot(fx.iv_feed(spark, sf, lg), fx.oi_feed(spark, sf, lg), fx.ohlc_feed(spark, sf, lg),
                          f"{root}/chains")
    # a re-run replaces the same trade dates instead of duplicating them
    daily.ingest_snapshot(fx.iv_feed(spark, sf, lg), fx.oi_feed(spark, sf, lg), fx.ohlc_feed(spark, sf, lg),
                          f"{root}/chains")
    n = spark.read.parquet(f"{root}/chains").count()
    assert n == chain.chain_snapshot(fx.iv_feed(spark, sf, lg), fx.oi_feed(spark, sf, lg),
                                     fx.ohlc_feed(spark, sf, lg)).count()
    sinks.write_keyed(fx.stored(spark, sf).withColumn("seq", F.lit(None).cast("long")), f"{root}/prices")
    daily.top_up_prices(spark, fx.price_feed(spark, sf), f"{root}/prices", "2001-06-30")
    a = sorted(map(tuple, sinks.read_keyed(spark, f"{root}/prices").select("symbol", "quote_date", "close").collect()))
    daily.top_up_prices(spark, fx.price_feed(spark, sf), f"{root}/prices", "2001-06-30")
    b = sorted(map(tuple, sinks.read_keyed(spark, f"{root}/prices").select("symbol", "quote_date", "close").collect()))
    assert len(a) > fx.stored(spark, sf).count() and a == b     # idempotent top-up


def test_signal_stream_and_report(spark, sf):
    root = tempfile.mkdtemp(prefix="cs-r4-", dir="/tmp")
    ft = labels.path_labels(features.feature_table(fx.chain(spark, sf), fx.und(spark, sf)), price_col="und_price")
    ml, cols = wf.ml_table(ft)
    res = model.train_walkforward(ml, cols)
    model.export_ensemble(res, f"{root}/ens")
    feats = ml.drop("label", "fwd_ret_1d", "y")
    feats.write.parquet(f"{root}/landing")
    ens = model.load_ensemble(spark, f"{root}/ens")
    jobs.signal_stream(spark, f"{root}/landing", feats.schema, ens, f"{root}/signals",
                       checkpoint=f"{root}/ckpt").awaitTermination()
    sig = sinks.read_keyed(spark, f"{root}/signals")
    assert sig.count() == feats.select("symbol", "quote_date").distinct().count()
    day = sig.first()["quote_date"]
    counts, report = daily.signal_report(spark, f"{root}/signals", day)
    c = counts.first()
    assert c["buys"] + c["sells"] + c["flats"] == report.count() >= 1
    assert "P(Up)" in report.columns


def test_right_dependent_open_interest(spark):
    df = spark.createDataFrame([(1, "C", 10.0, 20.0, 5.0), (2, "P", 10.0, 20.0, 5.0), (3, "P", 1.0, 2.0, None), (4, "C", 1.0, 2.0, -1.0)],
                               "req_id long, right_ string, CallOpenInterest double, PutOpenInterest double, Last double")
    got = {r["req_id"]: r["open_interest"] for r in chain.contract_prices(df, right_col="right_").collect()}
    assert got == {1: 10.0, 2: 20.0}
