import datetime as dt
import random

from chainsight.operators import walkforward as wf
from chainsight.sources import sinks
from conftest import rows

D = dt.date(2024, 1, 1)


def prices(spark, data):
    return spark.createDataFrame(data, "symbol string, quote_date date, close double")


def test_upsert_is_idempotent_and_last_write_wins(spark):
    base = prices(spark, [("A", D, 1.0), ("A", D + dt.timedelta(1), 2.0)])
    new = spark.createDataFrame([(1, "A", D + dt.timedelta(1), 5.0), (2, "A", D + dt.timedelta(1), 6.0),
                                 (3, "B", D, 7.0)], "seq long, symbol string, quote_date date, close double")
    once = sinks.upsert(base, new, ["symbol", "quote_date"])
    twice = sinks.upsert(once, new, ["symbol", "quote_date"])
    assert sorted(rows(once)) == sorted(rows(twice))
    assert dict(((s, d), c) for s, d, c in rows(once))[("A", D + dt.timedelta(1))] == 6.0


def test_replace_range_leaves_outside_untouched(spark):
    base = prices(spark, [("A", D + dt.timedelta(i), float(i)) for i in range(10)] + [("B", D, 9.0)])
    batch = prices(spark, [("A", D + dt.timedelta(3), 30.0), ("A", D + dt.timedelta(5), 50.0)])
    out = dict(((s, d), c) for s, d, c in rows(sinks.replace_range(base, batch)))
    assert ("A", D + dt.timedelta(4)) not in out          # inside the range, absent from the batch: deleted
    assert out[("A", D + dt.timedelta(2))] == 2.0 and out[("A", D + dt.timedelta(6))] == 6.0
    assert out[("B", D)] == 9.0 and out[("A", D + dt.timedelta(5))] == 50.0


def test_incremental_slice_seeds_new_symbols(spark):
    stored = prices(spark, [("A", D, 1.0)])
    feed = spark.createDataFrame([("A", D, 1.0), ("A", D + dt.timedelta(1), 2.0), ("B", D - dt.timedelta(2000), 3.0),
                                  ("B", D - dt.timedelta(10), 4.0)], "symbol string, quote_date date, close double")
    got = sorted(rows(sinks.incremental_slice(feed, stored, D + dt.timedelta(1)), "symbol", "close"))
    assert got == [("A", 2.0), ("B", 4.0)]


def test_fold_assignment_matches_range_definition(spark):
    rnd = random.Random(3)
    for n, t in ((36, 3), (3, 1), (5, 3)):
        months = sorted(rnd.sample(range(200), rnd.randint(n + t, n + 40)))
        data = [("A", dt.date(2000 + m // 12, m % 12 + 1, 5)) for m in months]
        df = spark.createDataFrame(data, "symbol string, quote_date date")
        idx = wf.month_index(df)
        counts = wf.fold_counts(idx, n, t)
        got = set(rows(wf.assign_folds(idx, counts, n, t), "quote_date", "fold_id", "role"))
        F = (len(months) - n) // t
        want = set()
        for i, (_, d) in enumerate(data):
            for f in range(F):
                if f * t <= i < f * t + n:
                    want.add((d, f, "train"))
                if f * t + n <= i < f * t + n + t:
                    want.add((d, f, "test"))
        assert got == want


def test_fold_time_order_and_no_folds(spark):
    data = [("A", dt.date(2000 + m // 12, m % 12 + 1, 3)) for m in range(50)]
    idx = wf.month_index(spark.createDataFrame(data, "symbol string, quote_date date"))
    a = wf.assign_folds(idx, wf.fold_counts(idx))
    from pyspark.sql import functions as F
    chk = a.groupBy("fold_id").agg(F.max(F.when(F.col("role") == "train", F.col("quote_date"))).alias("tr"),
                                   F.min(F.when(F.col("role") == "test", F.col("quote_date"))).alias("te"))
    assert all(r["tr"] < r["te"] for r in chk.collect())
    small = wf.month_index(spark.createDataFrame(data[:30], "symbol string, quote_date date"))
    assert wf.assign_folds(small, wf.fold_counts(small)).count() == 0
    assert wf.fold_plan(small).count() == 0


def test_scaler_uses_population_std_and_unit_for_constants(spark):
    df = spark.createDataFrame([("A", 0, "train", 1.0, 5.0), ("A", 0, "train", 3.0, 5.0), ("A", 0, "test", 9.0, 5.0)],
                               "symbol string, fold_id int, role string, x double, c double")
    s = wf.scaler_stats(df, ["x", "c"]).first()
    assert s["mean_x"] == 2.0 and s["scale_x"] == 1.0 and s["scale_c"] == 1.0


def test_keep_dense_features_threshold(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None), (5.0, 1.0)], "a double, b double")
    assert wf.keep_dense_features(df, ["a", "b", "zz"]) == ["a"]


def test_fold_median_fill_uses_train_rows_only(spark):
    df = spark.createDataFrame([("A", 0, "train", 1.0), ("A", 0, "train", 3.0), ("A", 0, "test", None),
                                ("A", 0, "test", 100.0), ("A", 1, "train", None), ("A", 1, "train", 7.0)],
                               "symbol string, fold_id int, role string, x double")
    got = sorted(rows(wf.fold_median_fill(df, ["x"]), "fold_id", "role", "x"))
    assert (0, "test", 2.0) in got and (1, "train", 7.0) in got and (0, "test", 100.0) in got
