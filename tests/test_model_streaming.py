import tempfile

import pytest
from pyspark.sql import functions as F

from chainsight.operators import chain, features, labels, model, walkforward as wf
from chainsight.sources import fixtures as fx
from chainsight.sources import sinks
from chainsight.streaming import jobs


@pytest.fixture(scope="module")
def trained(spark, sf):
    ft = labels.path_labels(features.feature_table(fx.chain(spark, sf), fx.und(spark, sf)), price_col="und_price")
    ml, cols = wf.ml_table(ft)
    return model.train_walkforward(ml, cols), ml


def test_walkforward_results_and_properties(trained):
    res, _ = trained
    r = res.results
    assert r.count() > 0
    bad = r.filter(F.abs(F.col("proba_down_ens") + F.col("proba_flat_ens") + F.col("proba_up_ens") - 1) > 1e-9).count()
    assert bad == 0
    assert r.filter(F.col("train_end") >= F.col("test_start")).count() == 0
    w = res.weights.groupBy("symbol").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(x["s"] - 1) < 1e-12 for x in w)
    assert res.models.filter("not converged").count() == 0
    imp = model.feature_importance(res)
    assert imp.count() == len(res.features) * r.select("symbol").distinct().count()


def test_export_load_and_inference(spark, trained):
    res, ml = trained
    root = tempfile.mkdtemp(prefix="cs-ens-", dir="/tmp")
    model.export_ensemble(res, root)
    cols, models, scalers, weights = model.load_ensemble(spark, root)
    assert cols == res.features
    keys = lambda df: {(r["symbol"], r["fold_id"]) for r in df.select("symbol", "fold_id").collect()}
    assert keys(models) == keys(res.models)
    feats = ml.drop("label", "fwd_ret_1d", "y")
    sig = model.run_inference(feats, cols, models, scalers, weights, trade_date="2001-09-03")
    got = sig.collect()
    assert len(got) == ml.select("symbol").distinct().count()
    assert all(str(x["quote_date"]) == "2001-09-03" and x["signal_dir"] in (-1, 0, 1) for x in got)
    with pytest.raises(FileNotFoundError):
        model.load_ensemble(spark, root + "-missing")
    with pytest.raises(RuntimeError):
        model.run_inference(feats.drop(cols[0]), cols, models, scalers, weights)


def test_price_topup_stream_equals_batch_upsert(spark, sf):
    """One file, many files in many batches, and two runs in the wrong order give the same table."""
    stored = fx.stored(spark, sf).select(F.lit(None).cast("long").alias("seq"), "symbol", "quote_date", "close")
    feed = fx.price_feed(spark, sf)
    batch = sinks.upsert(stored.drop("seq"), sinks.parse_price_feed(feed).select("seq", "symbol", "quote_date", "close"),
                         ["symbol", "quote_date"])
    want = sorted(map(tuple, batch.collect()))
    late = F.coalesce(F.col("created") < "1996", F.lit(True))
    for parts, files, max_files in (([F.lit(True)], 1, 1), ([F.lit(True)], 4, 2), ([~late, late], 2, 1)):
        root = tempfile.mkdtemp(prefix="cs-r3-", dir="/tmp")
        sinks.write_keyed(stored, f"{root}/prices")
        for part in parts:
            feed.filter(part).repartition(files, "seq").write.mode("append").option("header", True).csv(f"{root}/landing")
            jobs.price_topup_stream(spark, f"{root}/landing", f"{root}/prices", f"{root}/ckpt", max_files=max_files).awaitTermination()
        got = sinks.read_keyed(spark, f"{root}/prices").select("symbol", "quote_date", "close").collect()
        assert sorted(map(tuple, got)) == want


def test_chain_stream_does_not_depend_on_batches(spark):
    """Spot 100 in the first rows and 200 in the last of one (symbol, day, expiry): the band is around 100 however
    the rows arrive, and a run with a new checkpoint changes nothing."""
    rows = [(i, "A", "2024-01-05", "2024-02-16", str(k), "CALL", "1", "2", "0.2", str(u)) for i, (k, u) in
            enumerate([(100, 100.0), (170, 100.0), (100, 200.0), (170, 200.0)])]
    rows += [(9, "B", "2024-01-06", "2024-02-16", "100", "CALL", "1", "2", "0.2", None)]
    iv = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in jobs.IV_COLUMNS))
    side = spark.createDataFrame([], "seq long, symbol string, trade_date date, expiration string, strike string, right_ string, open_interest string, close string, volume string")
    for files in ([F.lit(True)], [F.col("seq") < 2, F.col("seq") >= 2], [F.col("seq") >= 2, F.col("seq") < 2]):
        root = tempfile.mkdtemp(prefix="cs-r1-", dir="/tmp")
        for run in ("a", "b"):
            for part in files if run == "a" else []:
                iv.filter(part).coalesce(1).write.mode("append").option("header", True).csv(f"{root}/landing")
                jobs.chain_snapshot_stream(spark, f"{root}/landing", side, side, f"{root}/out", f"{root}/ckpt-{run}", max_files=1).awaitTermination()
            if run == "b":
                jobs.chain_snapshot_stream(spark, f"{root}/landing", side, side, f"{root}/out", f"{root}/ckpt-{run}", max_files=1).awaitTermination()
            got = spark.read.parquet(f"{root}/out").select("Symbol", "Strike", "UndPrice").collect()
            assert sorted(map(tuple, got), key=str) == [("A", 100.0, 100.0), ("A", 100.0, 200.0), ("B", 100.0, None)]


def test_keyed_writes_touch_only_the_batch_months(spark):
    import os
    root = f"{tempfile.mkdtemp(prefix='cs-keyed-', dir='/tmp')}/t"
    files = lambda: {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if f.startswith("part-")}
    mk = lambda *r: spark.createDataFrame(r, "symbol string, quote_date string, close double").withColumn("quote_date", F.to_date("quote_date"))
    got = lambda: sorted((r.symbol, str(r.quote_date), r.close) for r in sinks.read_keyed(spark, root).collect())
    assert sinks.read_keyed(spark, root) is None
    sinks.merge_keyed(mk(("A", "2024-01-02", 1.0), ("A", "2024-02-02", 2.0), ("B", "2024-03-04", 3.0), ("B", None, 9.0)), root, ["symbol", "quote_date"], seq_col=None)
    before = files()
    for _ in range(2):
        sinks.merge_keyed(mk(("A", "2024-02-02", 5.0), ("C", "2024-02-05", 6.0)), root, ["symbol", "quote_date"], seq_col=None)
        assert got() == [("A", "2024-01-02", 1.0), ("A", "2024-02-02", 5.0), ("B", "2024-03-04", 3.0), ("B", "None", 9.0), ("C", "2024-02-05", 6.0)]
    assert {f for f in before if "2024_02" not in f} <= files()  # other months' files are not written again
    sinks.vacuum(spark, root, keep=1)
    assert {f for f in before if "2024_02" not in f} <= files() and not {f for f in before if "2024_02" in f} & files()
    # K3: A from the batch's first to its last date is replaced, others stay
    sinks.replace_keyed(mk(("A", "2024-01-09", 7.0), ("A", "2024-03-09", 8.0)), root)
    assert got() == [("A", "2024-01-02", 1.0), ("A", "2024-01-09", 7.0), ("A", "2024-03-09", 8.0), ("B", "2024-03-04", 3.0), ("B", "None", 9.0), ("C", "2024-02-05", 6.0)]
    # a month that is left without rows goes
    sinks.replace_keyed(mk(("C", "2024-01-01", 1.0), ("C", "2024-03-31", 2.0)), root)
    assert len(got()) == 7 and ("C", "2024-02-05", 6.0) not in got() and "m2024_02" not in sinks.current_version(spark, root)[1]
    sinks.vacuum(spark, root, keep=1)
    assert not any("2024_02" in f for f in files())
    same = got()
    sinks.replace_keyed(mk(("C", "2024-02-05", 1.0)).filter("symbol = 'none'"), root)
    assert got() == same


def test_shared_folder_is_needed_off_a_local_master():
    from types import SimpleNamespace
    from chainsight.session import ensure_checkpoint_dir
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=sc))


def test_missing_scaler_fold_raises(spark, trained):
    res, _ = trained
    root = tempfile.mkdtemp(prefix="cs-ens-", dir="/tmp")
    one = res.weights.select("symbol", "fold_id").first()
    short = model.WalkForwardResult(res.results, res.models, res.scalers.filter((F.col("symbol") != one[0]) | (F.col("fold_id") != one[1])),
                                    res.weights, res.features, res.plan, res.members)
    model.export_ensemble(short, root)
    with pytest.raises(FileNotFoundError):
        model.load_ensemble(spark, root)
    model.export_ensemble(res, root)
    assert model.load_ensemble(spark, root)[0] == res.features


def test_tick_stream_matches_static(spark, sf):
    root = tempfile.mkdtemp(prefix="cs-r2-", dir="/tmp")
    ticks = fx.ticks(spark, sf)
    ticks.coalesce(1).write.parquet(f"{root}/landing")
    fields = ["Bid", "Ask", "Last", "Close", "T99"]
    jobs.run_tick_snapshots(spark, f"{root}/landing", fields, f"{root}/out", checkpoint=f"{root}/ckpt").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    static = jobs.tick_snapshot_stream(ticks, fields)
    # append mode only emits windows closed by the watermark (10 minutes behind the last tick)
    wm = ticks.agg(F.max("ts")).first()[0]
    import datetime as dt
    closed = static.filter(F.col("window.end") <= F.lit(wm - dt.timedelta(minutes=10)))
    a = out.select(F.col("window.start").cast("timestamp_ntz").alias("s"), "req_id", *fields)
    b = closed.select(F.col("window.start").alias("s"), "req_id", *fields)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_tick_snapshots_take_all_three_kinds(spark, sf):
    root = tempfile.mkdtemp(prefix="cs-r2k-", dir="/tmp")
    feed = fx.tick_feed(spark, sf)
    feed.coalesce(1).write.parquet(f"{root}/landing")
    fields = ["Bid", "Volume", "CallOpenInterest", "PutOpenInterest", "Model_IV", "Model_OptPrice"]
    jobs.run_tick_snapshots(spark, f"{root}/landing", fields, f"{root}/out", checkpoint=f"{root}/ckpt").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    import datetime as dt
    wm = feed.agg(F.max("ts")).first()[0]
    closed = jobs.tick_snapshot_stream(feed, fields).filter(F.col("window.end") <= F.lit(wm - dt.timedelta(minutes=10)))
    a = out.select(F.col("window.start").cast("timestamp_ntz").alias("s"), "req_id", *fields)
    b = closed.select(F.col("window.start").alias("s"), "req_id", *fields)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    assert all(n > 0 for n in a.agg(*[F.count(f) for f in fields]).first())
    assert all(n > 0 for n in chain.latest_ticks(feed, fields).agg(*[F.count(f) for f in fields]).first())
    # codes alone, and kinds that are not known
    rows = [(1, dt.datetime(2024, 1, 1), 5, 8, 3.0), (2, dt.datetime(2024, 1, 1), 5, 78, 4.0), (3, dt.datetime(2024, 1, 1), 5, 4, 5.0)]
    bare = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, req_id long, tick_type int, value double")
    full = bare.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), *[(x, "double") for x in ("iv", "delta", "gamma", "theta", "vega", "opt_price", "und_price")])])
    for d in (bare, full):
        assert tuple(chain.latest_ticks(d, ["Volume", "OpenInterest", "Last"]).first()) == (5, 3.0, 4.0, 5.0)


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_softmax_matches_spark_logistic_regression(spark):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    from chainsight.operators.softmax import fit_softmax
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 3))
    y = np.argmax(x @ rnd.normal(size=(3, 3)) + rnd.normal(size=(300, 3)), axis=1)
    w, _ = fit_softmax(x, y, l2=0.05)
    df = spark.createDataFrame([(Vectors.dense(r), int(c)) for r, c in zip(x.tolist(), y)], ["features", "y"])
    m = LogisticRegression(labelCol="y", family="multinomial", regParam=0.05, standardization=False,
                           tol=1e-10, maxIter=200).fit(df)
    xb = np.hstack([np.ones((300, 1)), x])
    z = xb @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    ps = np.array([r.probability.toArray() for r in m.transform(df).select("probability").collect()])
    assert np.abs(p - ps).max() < 1e-3


def test_pipeline_engine_one_symbol(trained):
    _, ml = trained
    one = ml.filter(F.col("symbol") == "1-URGENT")
    cols = [c for c in ml.columns if c not in ("symbol", "quote_date", "label", "fwd_ret_1d", "y")]
    res = model.train_walkforward(one, cols, classifier="forest", parallelism=8, n_trees=30)
    assert res.results.count() > 0 and len(res.models) > 0
    assert model.feature_importance(res).count() == len(cols)


def test_merges_leave_no_staging_tables(spark, tmp_path):
    import os
    from chainsight.session import ensure_checkpoint_dir
    tables = os.path.join(ensure_checkpoint_dir(spark), "tables")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    root = str(tmp_path / "px")
    make = lambda v: spark.createDataFrame([(v, "A", "2024-01-02", float(v))], "seq long, symbol string, d string, close double").select(
        "seq", "symbol", F.to_date("d").alias("quote_date"), "close")
    for v in (1, 2):
        sinks.merge_keyed(make(v), root, ["symbol", "quote_date"])
    sinks.replace_keyed(make(3), root)
    with pytest.raises(Exception):
        sinks.merge_keyed(make(4).withColumn("close", F.raise_error(F.lit("broken")).cast("double")), root, ["symbol", "quote_date"])
    assert [r["close"] for r in sinks.read_keyed(spark, root).collect()] == [3.0]
    after = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    assert not {t for t in after - before if not t.startswith(".")}
