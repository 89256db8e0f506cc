"""Registered queries of nearest-neighbour information, exact selection, ordered output, period tables, versioned tables,
waited snapshots and bucketed storage, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from .checks import (_ALLF, _bt, _feed_wide, _FEED_SQL, _FEED_WIDE_SQL, _flab, _land, _merged, _MERGE_SQL, _metrics_sql, _ML_SQL, _ml, _r, _RES_SQL, _results,  # noqa: F401
                     _ROUND_ML, _scratch, register)
from .fixture_sql import with_views
from .output import round_doubles

# ---------------------------------------------------------------- A13 by nearest neighbours

def _psi(n: str) -> str:
    x = f"(CAST({n} AS DOUBLE))"
    y = f"({x} + 6)"
    z = f"(1 / ({y} * {y}))"
    steps = " + ".join(f"1 / ({x} + {i})" for i in range(6))
    return f"(ln({y}) - 0.5 / {y} - {z} * (1.0 / 12 - {z} * (1.0 / 120 - {z} * (1.0 / 252 - {z} * (1.0 / 240 - {z} / 132)))) - ({steps}))"


_KNN_INTS = ", ".join(f"CAST(round({c} * {10 ** _ROUND_ML.get(c, 6)}.0, 0) AS BIGINT) AS {c}" for c in _ALLF)


@register("a13_mutual_information_knn", _ML_SQL.rstrip() + f""",
kc AS (SELECT label, {_KNN_INTS} FROM flab2 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _ALLF)}),
kl AS (UNPIVOT kc ON {', '.join(_ALLF)} INTO NAME feature VALUE v),
kn AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS n_y FROM kl),
kw AS MATERIALIZED (SELECT feature, label, v, n_y, least(3, n_y - 1) AS k, row_number() OVER (PARTITION BY feature ORDER BY v, label) AS id,
       {', '.join(f'v - lag(v, {i}) OVER w AS d{i}' for i in (1, 2, 3))}, {', '.join(f'lead(v, {i}) OVER w - v AS e{i}' for i in (1, 2, 3))}
       FROM kn WHERE n_y > 1 WINDOW w AS (PARTITION BY feature, label ORDER BY v)),
kr AS MATERIALIZED (SELECT feature, v, n_y, k, list_sort([d1, d2, d3, e1, e2, e3], 'ASC', 'NULLS LAST')[k] AS r FROM kw),
kp AS (SELECT feature, v, count(*) AS n FROM kr GROUP BY 1, 2),
ku AS (SELECT feature, v, sum(n) OVER (PARTITION BY feature ORDER BY v) AS upto FROM kp),
kq AS (SELECT feature, n_y, k, v + greatest(r - 1, 0) AS hi, v - greatest(r - 1, 0) - 1 AS lo FROM kr),
km AS (SELECT q.feature, n_y, k, coalesce(a.upto, 0) - coalesce(b.upto, 0) AS m FROM kq q ASOF LEFT JOIN ku a ON a.feature = q.feature AND a.v <= q.hi
       ASOF LEFT JOIN ku b ON b.feature = q.feature AND b.v <= q.lo)
SELECT feature, round(greatest(0, {_psi('count(*)')} + avg({_psi('k')}) - avg({_psi('n_y')}) - avg({_psi('m')})), 6) AS mi_score FROM km GROUP BY 1""")
def q_mutual_information_knn(spark, sf):
    from ..operators import stats
    return round_doubles(stats.mutual_information_knn(_flab(spark, sf), _ALLF, decimals=_ROUND_ML))


# ---------------------------------------------------------------- P16 by narrowing

@register("p16_exact_medians", _ML_SQL.rstrip() + "\nSELECT symbol, " + ", ".join(f"round(median({c}), {_ROUND_ML.get(c, 6)}) AS {c}" for c in _ALLF) + " FROM flab2 GROUP BY 1")
def q_exact_medians(spark, sf):
    """Medians per symbol, narrowed down to 50 values: the passes that large tables take."""
    from ..operators.selection import exact_medians
    return round_doubles(exact_medians(_flab(spark, sf).select("symbol", *_ALLF), _ALLF, ["symbol"], few=50, bins=16), overrides=_ROUND_ML)


# ---------------------------------------------------------------- T4, U1, U4

@register("t4_ordered_output", with_views("px") + """
SELECT symbol, quote_date, close, row_number() OVER (ORDER BY quote_date, symbol) AS position FROM px""")
def q_ordered_output(spark, sf):
    """Prices as sorted files, read back in the order of the files."""
    from ..sources import sinks
    path = f"{_scratch(spark, 't4')}/ordered"
    sinks.write_ordered(fx.px(spark, sf).select("symbol", "quote_date", "close"), path, ["quote_date", "symbol"], files=8)
    return sinks.read_ordered(spark, path)


@register("t4_ordered_report", _RES_SQL + """
SELECT quote_date, symbol, round(proba_up_ens, 6) AS proba_up_ens, row_number() OVER (ORDER BY round(proba_up_ens, 6) DESC, symbol, quote_date) AS position FROM res""")
def q_ordered_report(spark, sf):
    """Signals by probability, the highest first."""
    from ..sources import sinks
    path = f"{_scratch(spark, 't4')}/report"
    rows = round_doubles(_results(spark, sf).select("quote_date", "symbol", "proba_up_ens"))
    sinks.write_ordered(rows, path, [F.col("proba_up_ens").desc(), F.col("symbol"), F.col("quote_date")], files=8)
    return sinks.read_ordered(spark, path)


@register("u1_union_of_fold_tests", _ML_SQL + "SELECT symbol, quote_date, fold_id, label, 'fold_' || fold_id AS model_id, row_number() OVER (ORDER BY quote_date, symbol, fold_id) AS position FROM asg WHERE role = 'test'")
def q_union_of_fold_tests(spark, sf):
    """The folds' test rows as one frame, sorted by date."""
    from ..operators import walkforward as wf
    from ..sources import sinks
    ml, _ = _ml(spark, sf)
    idx = wf.month_index(ml)
    test = wf.assign_folds(idx, wf.fold_counts(idx)).filter("role = 'test'")
    path = f"{_scratch(spark, 'u1')}/tests"
    sinks.write_ordered(test.select("symbol", "quote_date", "fold_id", "label", F.concat(F.lit("fold_"), F.col("fold_id").cast("string")).alias("model_id")), path, ["quote_date", "symbol", "fold_id"], files=8)
    return sinks.read_ordered(spark, path)


@register("u4_probabilities_beside_rows", with_views("proba", "px") + """
SELECT x.symbol, x.quote_date, x.close, round(p.proba_down_ens, 6) AS proba_down_ens, round(p.proba_flat_ens, 6) AS proba_flat_ens, round(p.proba_up_ens, 6) AS proba_up_ens
FROM px x LEFT JOIN proba p ON x.symbol = p.symbol AND x.quote_date = p.quote_date""")
def q_probabilities_beside_rows(spark, sf):
    """U4: probabilities put beside their rows by key, never by position."""
    from ..sources import sinks
    proba = fx.proba(spark, sf).select("symbol", "quote_date", "proba_down_ens", "proba_flat_ens", "proba_up_ens")
    return round_doubles(sinks.beside(fx.px(spark, sf).select("symbol", "quote_date", "close"), proba, ["symbol", "quote_date"]))


# ---------------------------------------------------------------- J7 with a table of periods

_PERIOD_TABLE = """
per AS (SELECT 'from ' || CAST(quote_date AS VARCHAR) AS period, quote_date AS p_start, CAST(quote_date + INTERVAL 45 DAY AS DATE) AS p_end FROM (SELECT DISTINCT quote_date FROM px)
        UNION ALL SELECT 'until ' || CAST(quote_date AS VARCHAR), NULL, quote_date FROM (SELECT DISTINCT quote_date FROM px) WHERE day(quote_date) = 1
        UNION ALL SELECT 'since ' || CAST(quote_date AS VARCHAR), quote_date, NULL FROM (SELECT DISTINCT quote_date FROM px) WHERE day(quote_date) = 1
        UNION ALL SELECT 'ever', NULL, NULL)"""


def _period_table(spark, sf):
    days = fx.px(spark, sf).select("quote_date").distinct()
    text, first = F.col("quote_date").cast("string"), days.filter(F.dayofmonth("quote_date") == 1)
    none = F.lit(None).cast("date")
    return (days.select(F.concat(F.lit("from "), text).alias("period"), F.col("quote_date").alias("p_start"), F.date_add("quote_date", 45).alias("p_end"))
            .unionByName(first.select(F.concat(F.lit("until "), text).alias("period"), none.alias("p_start"), F.col("quote_date").alias("p_end")))
            .unionByName(first.select(F.concat(F.lit("since "), text).alias("period"), F.col("quote_date").alias("p_start"), none.alias("p_end")))
            .unionByName(spark.range(1).select(F.lit("ever").alias("period"), none.alias("p_start"), none.alias("p_end"))))


@register("j7_period_table", with_views("px", extra=_PERIOD_TABLE) + """
SELECT period, symbol, count(*) AS n, min(quote_date) AS first_day, max(quote_date) AS last_day
FROM px JOIN per ON (p_start IS NULL OR quote_date >= p_start) AND (p_end IS NULL OR quote_date < p_end) GROUP BY 1, 2""")
def q_period_table(spark, sf):
    """Every price in every one of thousands of overlapping periods, some of them open."""
    from ..operators import backtest
    j = backtest.in_periods(fx.px(spark, sf).select("symbol", "quote_date"), _period_table(spark, sf))
    return j.groupBy("period", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("quote_date").alias("first_day"), F.max("quote_date").alias("last_day"))


@register("b6_period_table_metrics", _RES_SQL + """,
days AS (SELECT DISTINCT quote_date FROM bt),
per AS (SELECT 'quarter from ' || CAST(quote_date AS VARCHAR) AS period, quote_date AS p_start, CAST(quote_date + INTERVAL 90 DAY AS DATE) AS p_end FROM days WHERE day(quote_date) = 1
        UNION ALL SELECT 'until ' || CAST(quote_date AS VARCHAR), NULL, quote_date FROM days WHERE day(quote_date) = 1 AND month(quote_date) = 1),
long AS (SELECT symbol, period, quote_date, strat_ret AS r FROM bt JOIN per ON (p_start IS NULL OR quote_date >= p_start) AND (p_end IS NULL OR quote_date < p_end)),
m AS """ + _metrics_sql("long", "symbol, period", win=True, pf=False, dim=False) + """
SELECT symbol, period, n_days, ann_return, sharpe, max_drawdown, win_rate FROM m WHERE n_days >= 20""")
def q_period_table_metrics(spark, sf):
    from ..operators import backtest
    bt = _bt(spark, sf)
    days = bt.select("quote_date").distinct().filter(F.dayofmonth("quote_date") == 1)
    text, none = F.col("quote_date").cast("string"), F.lit(None).cast("date")
    periods = (days.select(F.concat(F.lit("quarter from "), text).alias("period"), F.col("quote_date").alias("p_start"), F.date_add("quote_date", 90).alias("p_end"))
               .unionByName(days.filter(F.month("quote_date") == 1).select(F.concat(F.lit("until "), text).alias("period"), none.alias("p_start"), F.col("quote_date").alias("p_end"))))
    return round_doubles(backtest.period_metrics(bt, periods))


# ---------------------------------------------------------------- K2-K4 as versions

@register("k2_k4_versioned_table", _FEED_SQL + """,
newest AS (SELECT symbol, quote_date, arg_max(close, (seq, close)) AS close FROM ok GROUP BY 1, 2),
v2 AS (SELECT s.symbol, s.quote_date, s.close FROM stored s ANTI JOIN newest d ON s.symbol = d.symbol AND s.quote_date = d.quote_date UNION ALL SELECT * FROM newest),
rep AS (SELECT symbol, quote_date, close + 1 AS close FROM v2 WHERE quote_date BETWEEN DATE '1996-02-10' AND DATE '1996-05-20' AND day(quote_date) % 2 = 0),
bnd AS (SELECT min(quote_date) AS lo, max(quote_date) AS hi FROM rep),
v3 AS (SELECT v2.* FROM v2, bnd WHERE NOT (quote_date IS NOT NULL AND quote_date BETWEEN lo AND hi AND symbol IN (SELECT symbol FROM rep)) UNION ALL SELECT * FROM rep)
SELECT 2 AS version, * FROM v2 UNION ALL SELECT 3, * FROM v3""")
def q_versioned_table(spark, sf):
    """K2 then K3 on a stored table; both versions are read: the one before a write stays whole."""
    from ..sources import sinks
    root = f"{_scratch(spark, 'versions')}/prices"
    sinks.write_keyed(fx.stored(spark, sf).select(F.lit(None).cast("bigint").alias("seq"), "symbol", "quote_date", "close"), root)
    parsed = sinks.parse_price_feed(fx.price_feed(spark, sf))
    sinks.merge_keyed(parsed.select("seq", "symbol", "quote_date", "close"), root, ["symbol", "quote_date"])
    some = sinks.read_keyed(spark, root).filter("quote_date BETWEEN DATE '1996-02-10' AND DATE '1996-05-20' AND day(quote_date) % 2 = 0")
    sinks.replace_keyed(some.withColumn("close", F.col("close") + 1), root)
    return sinks.read_keyed(spark, root, 2).select(F.lit(2).alias("version"), "symbol", "quote_date", "close").unionByName(
        sinks.read_keyed(spark, root, 3).select(F.lit(3).alias("version"), "symbol", "quote_date", "close"))


# ---------------------------------------------------------------- R2 after a wait

_WAIT_FIELDS = ["Bid", "Last", "Volume", "CallOpenInterest", "Model_IV", "Bid_Delta"]
_WAIT_HOURS = 48


@register("r2_snapshot_after_wait", with_views("tick_rows", extra=f"""
rq AS (SELECT req_id, min(ts) AS requested_at FROM tick_rows GROUP BY 1),
bad AS (SELECT req_id FROM rq WHERE req_id % 17 = 0),
win AS (SELECT t.*, requested_at FROM tick_rows t JOIN rq USING (req_id) WHERE ts < requested_at + INTERVAL {_WAIT_HOURS} HOUR AND req_id NOT IN (SELECT req_id FROM bad)),
lastv AS (SELECT req_id, requested_at, field, arg_max(value, (ts, seq)) AS value FROM win GROUP BY 1, 2, 3)""") + f"""
SELECT req_id, requested_at, requested_at + INTERVAL {_WAIT_HOURS} HOUR AS snapshot_at, """ + ", ".join(
    f"round(max(value) FILTER (WHERE field = '{f}'), 6) AS \"{f}\"" for f in _WAIT_FIELDS) + " FROM lastv GROUP BY 1, 2")
def q_snapshot_after_wait(spark, sf):
    """Requests, ticks and errors as one stream in several batches, the requests landed after their ticks; a last row moves the watermark on."""
    from ..streaming import jobs
    root = _scratch(spark, "r2-wait")
    feed = fx.tick_feed(spark, sf)
    none = {c.name: F.lit(None).cast(c.dataType).alias(c.name) for c in feed.schema.fields}
    asked = feed.groupBy("req_id").agg(F.min("ts").alias("ts"))

    def mark(rows, kind):
        return rows.select(*[F.col(c) if c in ("req_id", "ts") else F.lit(kind).alias(c) if c == "kind" else none[c] for c in feed.columns])

    landing = f"{root}/landing"
    for part in (feed.filter("seq % 3 = 0"), mark(asked, jobs.REQUEST), feed.filter("seq % 3 <> 0"), mark(asked.filter("req_id % 17 = 0"), jobs.ERROR)):
        part.coalesce(2).write.mode("append").parquet(landing)
    run = lambda: jobs.run_wait_snapshots(spark, landing, _WAIT_FIELDS, f"{root}/out", f"{root}/ckpt", _WAIT_HOURS * 3600, "2000 days", max_files=3).awaitTermination()
    run()
    last = feed.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("req_id"), (F.col("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts"))
    mark(last, jobs.ERROR).coalesce(1).write.mode("append").parquet(landing)
    run()
    out = spark.read.parquet(f"{root}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("requested_at", "snapshot_at")})
    return round_doubles(out)


# ---------------------------------------------------------------- S9 / J1 on bucketed tables

@register("s9_j1_bucketed_merge", _MERGE_SQL + "SELECT * FROM merged")
def q_bucketed_merge(spark, sf):
    """Feeds stored in buckets of (symbol, trade_date), merged without a shuffle."""
    from ..operators import chain
    from ..sources import buckets
    import uuid
    lg = fx.legs(spark, sf)
    run = uuid.uuid4().hex[:10]
    count = buckets.bucket_count(lg)
    iv, oi, oh = (buckets.write_bucketed(f(spark, sf, lg), f"{n}_{run}", ["symbol", "trade_date"], count)
                  for n, f in (("iv", fx.iv_feed), ("oi", fx.oi_feed), ("ohlc", fx.ohlc_feed)))
    return buckets.merge_bucketed(iv, oi, oh)
