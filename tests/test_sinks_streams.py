"""Feeds by header, emptied days, versioned tables, ordered files, period tables, bucketed merges, waited snapshots."""

import tempfile

import pytest
from pyspark.sql import functions as F

from chainsight.operators import backtest, chain
from chainsight.sources import buckets, sinks
from chainsight.streaming import jobs


def _tmp(name):
    return tempfile.mkdtemp(prefix=f"cs-{name}-", dir="/tmp")


def _land(root, name, *lines):
    with open(f"{root}/{name}.csv", "w") as f:
        f.write("\n".join(lines) + "\n")


# ---------------------------------------------------------------- S3, S4

def test_columns_are_taken_by_the_header_of_each_file(spark):
    root = _tmp("csv")
    _land(root, "a", "symbol,bid,ask", "A,1.0,2.0")
    _land(root, "b", "ask,symbol,bid", "4.0,B,3.0", ",C,")
    _land(root, "c", "venue,ask,symbol", 'x,"6,5",D')
    _land(root, "d", "symbol,bid,ask")
    got = sorted(map(tuple, chain.read_feed_csv(spark, root, ["symbol", "bid", "ask"]).collect()))
    assert got == [("A", "1.0", "2.0"), ("B", "3.0", "4.0"), ("C", None, None), ("D", None, "6,5")]


def test_a_file_without_a_header_raises(spark):
    root = _tmp("csv")
    _land(root, "a", "symbol,bid,ask", "A,1.0,2.0")
    _land(root, "b", "B,3.0,4.0")
    with pytest.raises(Exception, match="no header line"):
        chain.read_feed_csv(spark, root, ["symbol", "bid", "ask"]).collect()
    wide = _tmp("csv")
    _land(wide, "a", ",".join(["symbol", "bid", *[f"x{i}" for i in range(80)], "ask"]), "A,1.0")
    with pytest.raises(Exception, match="columns or more"):
        chain.read_feed_csv(spark, wide, ["symbol", "bid", "ask"]).collect()


def test_a_feed_is_parsed_once_and_as_far_as_its_last_asked_name(spark):
    root = _tmp("csv")
    _land(root, "a", "symbol,bid,ask,venue,note", "A,1.0,2.0,x,y,more,cells", "symbol and bid,,", "", "ask,symbol,bid,venue", "B")
    _land(root, "b", '"ask" ,note,"symbol"', '4.0,"bid,ask",C', "x,symbol")
    rows = chain.read_feed_csv(spark, root, ["symbol", "bid", "ask"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "_c2" in plan and "_c3:" not in plan
    # a second header line is no row; the smallest of a file's headers holds
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        ("1.0", "2.0", "A"), (None, None, "symbol and bid"), (None, None, "B"), ("C", None, "4.0"), (None, None, "x")], key=str)


# ---------------------------------------------------------------- R1, R3

_SIDE = "seq long, symbol string, trade_date date, expiration string, strike string, right_ string, open_interest string, close string, volume string"


def test_a_day_that_is_left_without_rows_goes(spark):
    import os
    root = _tmp("r1")
    os.makedirs(f"{root}/landing")
    side = spark.createDataFrame([], _SIDE)
    head = ",".join(jobs.IV_COLUMNS)
    run = lambda: jobs.chain_snapshot_stream(spark, f"{root}/landing", side, side, f"{root}/out", f"{root}/ckpt").awaitTermination()
    _land(f"{root}/landing", "a", head, "5,A,2024-01-05,2024-02-16,100,CALL,1,2,0.2,100", "6,A,2024-01-08,2024-02-16,100,CALL,1,2,0.2,100", "7,A,2024-01-08,2024-03-15,50,CALL,1,2,0.2,")
    run()
    got = lambda: sorted((str(r.trade_date), r.Expiry, r.Strike) for r in spark.read.parquet(f"{root}/out").collect())
    assert got() == [("2024-01-05", "2024-02-16", 100.0), ("2024-01-08", "2024-02-16", 100.0), ("2024-01-08", "2024-03-15", 50.0)]
    # an earlier arrival sets the spot to 1000: strike 100 leaves the band, and the day is empty; another expiry of a day stays
    _land(f"{root}/landing", "b", ",".join(reversed(jobs.IV_COLUMNS)), "1000,0.2,,,CALL,100,2024-02-16,2024-01-05,A,1", "1000,0.2,,,CALL,100,2024-02-16,2024-01-08,A,1")
    run()
    assert got() == [("2024-01-08", "2024-03-15", 50.0)] and not any("2024-01-05" in d for d in os.listdir(f"{root}/out"))
    jobs.compact_raw(spark, f"{root}/out")
    assert len([d for d in os.listdir(f"{root}/out_raw") if d.startswith("batch=")]) == 1
    _land(f"{root}/landing", "c", head, "0,A,2024-01-08,2024-02-16,100,PUT,1,2,0.2,100")
    run()
    assert got() == [("2024-01-08", "2024-02-16", 100.0)] * 2 + [("2024-01-08", "2024-03-15", 50.0)]


def test_raw_rows_are_dealt_once_for_equal_rows_and_both_merges(spark):
    iv = "seq long, symbol string, trade_date date, expiration string, strike string, right_ string, bid string, ask string, implied_vol string, underlying_price string"
    one = (1, "A", None, "2024-02-16", "100", "CALL", "1", "2", "0.2", "100")
    banded = spark.createDataFrame([one, one, (2, *one[1:]), (3, None, None, "2024-02-16", "100", None, "1", "2", None, None)], iv)
    keys = "symbol string, trade_date date, expiration string, strike string, right_ string"
    oi = spark.createDataFrame([(*one[1:6], "10"), (None, None, "2024-02-16", "100", None, "30")], f"{keys}, open_interest string")
    oh = spark.createDataFrame([(*one[1:6], "5", "7"), ("B", *one[2:6], "6", "8")], f"{keys}, close string, volume string")
    rows = jobs._chain_rows(banded, oi.hint("merge"), oh.hint("merge"), None)
    assert rows._jdf.queryExecution().sparkPlan().toString().count("Join") == 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # the rows once, and each side
    got = sorted(((r.Symbol, r.OpenInterest, r.Close, r.Volume) for r in rows.collect()), key=str)
    assert got == [("A", 10.0, 5.0, 7.0)] * 2 + [(None, 30.0, None, None)]


def test_price_files_of_another_column_order(spark):
    import os
    root = _tmp("r3")
    os.makedirs(f"{root}/landing")
    _land(f"{root}/landing", "a", "seq,symbol,created,close", "1,A,2024-01-05 10:00,1.5")
    _land(f"{root}/landing", "b", "close,seq,created,symbol", "2.5,2,2024-01-06 10:00,A")
    jobs.price_topup_stream(spark, f"{root}/landing", f"{root}/prices", f"{root}/ckpt", max_files=1).awaitTermination()
    assert sorted(r.close for r in sinks.read_keyed(spark, f"{root}/prices").collect()) == [1.5, 2.5]


# ---------------------------------------------------------------- K2-K4

def _prices(spark, *rows):
    return spark.createDataFrame(rows, "symbol string, quote_date string, close double").withColumn("quote_date", F.to_date("quote_date"))


def test_a_reader_sees_a_version_before_or_after_a_write(spark, monkeypatch):
    root = f"{_tmp('ver')}/t"
    keys = ["symbol", "quote_date"]
    read = lambda: sorted((str(r.quote_date), r.close) for r in sinks.read_keyed(spark, root).collect())
    sinks.merge_keyed(_prices(spark, ("A", "2024-01-02", 1.0), ("A", "2024-02-02", 2.0)), root, keys, seq_col=None)
    began = sinks.read_keyed(spark, root)
    seen, commit = [], sinks._commit

    def watched(*args):
        seen.append(read())  # all months are written, none is visible
        commit(*args)
    monkeypatch.setattr(sinks, "_commit", watched)
    sinks.merge_keyed(_prices(spark, ("A", "2024-01-02", 5.0), ("A", "2024-02-02", 6.0)), root, keys, seq_col=None)
    assert seen == [[("2024-01-02", 1.0), ("2024-02-02", 2.0)]] and read() == [("2024-01-02", 5.0), ("2024-02-02", 6.0)]
    assert sorted(r.close for r in began.collect()) == [1.0, 2.0]  # a reader that began before still can read
    assert [sinks.read_keyed(spark, root, 1).count(), sinks.current_version(spark, root)[0]] == [2, 2]


def test_the_second_of_two_writers_fails_and_leaves_nothing(spark, monkeypatch):
    import os
    root = f"{_tmp('ver')}/t"
    keys = ["symbol", "quote_date"]
    sinks.merge_keyed(_prices(spark, ("A", "2024-01-02", 1.0)), root, keys, seq_col=None)
    put = sinks._put
    once = []

    def slow(df, r):
        if not once:  # another writer commits between this one's read and its commit
            once.append(1)
            sinks.merge_keyed(_prices(spark, ("B", "2024-01-03", 2.0)), root, keys, seq_col=None)
        return put(df, r)
    monkeypatch.setattr(sinks, "_put", slow)
    with pytest.raises(sinks.ConcurrentWrite):
        sinks.merge_keyed(_prices(spark, ("C", "2024-01-04", 3.0)), root, keys, seq_col=None)
    assert sorted(r.symbol for r in sinks.read_keyed(spark, root).collect()) == ["A", "B"]
    assert len(os.listdir(f"{root}/data")) == 2 and not [f for f in os.listdir(f"{root}/_versions") if f.startswith("draft")]
    sinks.merge_keyed(_prices(spark, ("C", "2024-01-04", 3.0)), root, keys, seq_col=None)
    assert sinks.read_keyed(spark, root).count() == 3


# ---------------------------------------------------------------- T4

def test_ordered_files_split_a_common_value(spark):
    path = f"{_tmp('t4')}/o"
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 8, 5).otherwise(F.col("id") % 7).alias("k"), "id")
    sinks.write_ordered(df, path, ["k"], files=6)
    rows = sinks.read_ordered(spark, path).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 4001)) and [r.k for r in rows] == sorted(r.k for r in rows)
    per = spark.read.parquet(path).groupBy(F.col("_metadata.file_name")).count().collect()
    assert len(per) == 6 and max(r["count"] for r in per) < 1200
    sinks.write_ordered(df, f"{path}-d", [F.col("k").desc(), F.col("id")])
    assert [(r.k, r.id) for r in sinks.read_ordered(spark, f"{path}-d").orderBy("position").collect()] == sorted(((r.k, r.id) for r in rows), key=lambda x: (-x[0], x[1]))


# ---------------------------------------------------------------- J7

def test_ten_thousand_periods_without_a_nested_loop(spark):
    days = spark.range(1500).select(F.date_add(F.lit("2019-06-15").cast("date"), F.col("id").cast("int")).alias("quote_date"), F.lit("A").alias("symbol"))
    p = spark.range(10_000).select(F.concat(F.lit("p"), "id").alias("period"), F.date_add(F.lit("2018-01-01").cast("date"), (F.col("id") % 2500).cast("int")).alias("p_start"),
                                   (F.col("id") % 97).cast("int").alias("n")).select("period", "p_start", F.expr("date_add(p_start, n)").alias("p_end"))
    p = p.unionByName(spark.sql("SELECT 'all' AS period, CAST(NULL AS DATE) AS p_start, CAST(NULL AS DATE) AS p_end UNION ALL SELECT 'none', DATE '2020-01-05', DATE '2020-01-05' UNION ALL SELECT 'back', DATE '2020-02-05', DATE '2020-01-05'"))
    j = backtest.in_periods(days, p)
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.period: r["count"] for r in j.groupBy("period").count().collect()}
    lo, hi = 0, 1500
    import datetime as dt
    base = dt.date(2019, 6, 15)
    want = {}
    for r in p.collect():
        a = lo if r.p_start is None else max(lo, (r.p_start - base).days)
        b = hi if r.p_end is None else min(hi, (r.p_end - base).days)
        if b > a:
            want[r.period] = b - a
    assert got == want and got["all"] == 1500


# ---------------------------------------------------------------- S9, J1

def test_bucketed_merge_has_no_shuffle(spark):
    rows = [(i, "AB"[i % 2], f"2024-01-{1 + i % 20:02d}", "2024-02-16", str(i % 9), "CALL" if i % 3 else None) for i in range(300)]
    base = spark.createDataFrame(rows, "seq long, symbol string, trade_date string, expiration string, strike string, right_ string").withColumn("trade_date", F.to_date("trade_date"))
    oi = base.filter("seq % 4 > 0").withColumn("open_interest", F.col("seq").cast("string"))
    oh = base.filter("seq % 5 > 0").withColumns({"close": F.col("seq").cast("string"), "volume": F.lit("1")})
    import uuid
    run = uuid.uuid4().hex[:8]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tables = [buckets.write_bucketed(d, f"{n}_{run}", buckets=4) for n, d in (("iv", base), ("oi", oi), ("oh", oh))]
        with buckets.co_partitioned(spark):
            merged = buckets.merge_bucketed(*tables)
            assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, merged.collect())) == sorted(map(str, chain.merge_feeds(base, oi, oh).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    with pytest.raises(Exception, match="NULL in bucket column"):
        buckets.write_bucketed(base.withColumn("symbol", F.lit(None).cast("string")), f"bad_{run}", buckets=2)


# ---------------------------------------------------------------- R2 after a wait

def _ticks(spark, *rows):
    cols = [c.split()[0] for c in jobs.TICK_COLUMNS.split(", ")]
    full = [(seq, ts, req, kind, code, value, *[None] * (len(cols) - 6)) for seq, ts, req, kind, code, value in rows]
    return spark.createDataFrame(full, jobs.TICK_COLUMNS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_one_row_a_request_at_its_timer_also_after_a_restart(spark):
    root = _tmp("wait")
    at = lambda s: f"2024-01-05 10:{s // 60:02d}:{s % 60:02d}"
    batches = [
        [(1, at(0), 1, "request", None, None), (2, at(3), 1, "price", 1, 10.0), (3, at(5), 2, "price", 1, 20.0)],
        # request 2 arrives after its first tick; 1 has a later bid, and one after its wait; 3 fails, 4 has no tick
        [(4, at(4), 2, "request", None, None), (5, at(14), 1, "price", 1, 11.0), (6, at(15), 1, "price", 1, 12.0), (7, at(6), 3, "request", None, None),
         (8, at(7), 3, "price", 1, 1.0), (9, at(8), 3, "error", None, None), (10, at(9), 4, "request", None, None), (11, at(2), 1, "price", 2, 10.5)],
        # the watermark passes the timers; a late tick of request 5 is older than the watermark and dropped
        [(12, at(100), 9, "price", 1, 0.0)],
        [(13, at(20), 5, "request", None, None), (14, at(101), 6, "request", None, None), (15, at(102), 6, "price", 4, 7.0)],
        [(16, at(400), 9, "price", 1, 0.0)],
    ]
    for rows in batches:  # each batch is a run of its own on the same checkpoint
        _ticks(spark, *rows).coalesce(1).write.mode("append").parquet(f"{root}/landing")
        jobs.run_wait_snapshots(spark, f"{root}/landing", ["Bid", "Ask", "Last"], f"{root}/out", f"{root}/ckpt", 15, "30 seconds").awaitTermination()
    got = sorted((r.req_id, str(r.requested_at)[11:19], str(r.snapshot_at)[11:19], r.Bid, r.Ask, r.Last) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [(1, "10:00:00", "10:00:15", 11.0, 10.5, None), (2, "10:00:04", "10:00:19", 20.0, None, None), (6, "10:01:41", "10:01:56", None, None, 7.0)]


def test_buckets_grow_with_the_table(spark):
    assert buckets.bucket_count(spark.range(10)) == 8
    assert buckets.bucket_count(spark.range(90), least=2, each=20) == 5
    assert buckets.bucket_count(spark.range(9 * buckets.BUCKET_ROWS + 1)) == 10
