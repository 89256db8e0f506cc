"""Structured Streaming jobs for the incremental behaviours.

* R1 chain snapshots: IV feed files stream in and are kept raw, by trade date; each micro-batch builds the
  chain rows of the (symbol, day, expiry) groups it touches anew, from all their raw rows, and overwrites just
  their days; a day left without rows goes. The spot and the band of a group thus never depend on how files fall into batches, and a
  replay or a run with a new checkpoint gives the same table.
* R2 tick snapshots: event-time windows with a watermark, latest value per
  (minute, request, field); late ticks beyond the watermark are dropped. ``wait_snapshots``: one row a request, taken by an
  event-time timer some seconds after it.
* R3 price top-up: parsed EOD rows upserted (K2) into a keyed price table per micro-batch; late rows,
  back-fills and new symbols are upserted like any other.
* R4 daily signals: every (symbol, day) of the new feature rows scored by a loaded ensemble and
  upserted (K4) into a keyed signal table.
* R5 trade-date buckets: tumbling 1-day windows starting at the cut-off hour.

R2 keeps state inside the watermark only; R1, R3 and R4 keep none. Each job needs a checkpoint location of its own.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..operators import chain
from ..sources import sinks
from ..session import cut_lineage, file_system, staging

# The feeds' columns.
IV_COLUMNS = ["seq", "symbol", "trade_date", "expiration", "strike", "right_", "bid", "ask",
              "implied_vol", "underlying_price"]
PRICE_COLUMNS = ["seq", "symbol", "created", "close"]
TICK_COLUMNS = ("seq bigint, ts timestamp_ntz, req_id bigint, kind string, tick_type int, value double, iv double, delta double, "
                "gamma double, theta double, vega double, opt_price double, und_price double")


# ---------------------------------------------------------------- R1

def _csv_cells(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """CSV files as a stream of cells with their file, for ``chain.feed_by_header``. A file is in one batch whole."""
    src = spark.readStream.schema(chain.cell_schema()).option("header", False).option("maxFilesPerTrigger", max_files).csv(path)
    return src.select(*[f"_c{i}" for i in range(chain.MOST_CELLS)], F.col("_metadata.file_path").alias("_file"))


_GROUP = ["symbol", "trade_date", "_expiry"]


def chain_snapshot_stream(spark: SparkSession, iv_dir: str, oi: DataFrame, ohlc: DataFrame, out: str,
                          checkpoint: str, snapshot_ts=None, max_files: int = 1000) -> StreamingQuery:
    """IV CSV files -> raw rows at ``<out>_raw`` -> J1 (stream-static) -> D3/P4/P2/P1 -> the touched days of ``out``.

    ``max_files`` only bounds a micro-batch; the result does not depend on it. Feed rows carry their arrival
    number, so rows that are equal in every column are one row delivered again. A batch's raw rows go to a folder
    of the checkpoint and the epoch, so a replayed batch writes them once; ``compact_raw`` puts many folders in one.
    """
    keys = chain.FEED_KEYS
    # the static sides are keep-last deduplicated once, not once per micro-batch
    oi_d = cut_lineage(chain.dedupe_last(oi.select(*keys, "seq", "open_interest"), keys).drop("seq"))
    oh_d = cut_lineage(chain.dedupe_last(ohlc.select(*keys, "seq", "close", "volume"), keys).drop("seq"))
    raw = f"{out.rstrip('/')}_raw"
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, epoch: int) -> None:
        with staging(batch.sparkSession):
            rebuild(batch.sparkSession, chain.feed_by_header(batch, IV_COLUMNS), f"{raw}/batch={run}-{epoch}")

    def rebuild(spark: SparkSession, feed: DataFrame, folder: str) -> None:
        iv = feed.withColumns({"seq": F.col("seq").cast("bigint"), "trade_date": F.to_date("trade_date")})
        iv.hint("rebalance", "trade_date").write.mode("overwrite").partitionBy("trade_date").parquet(folder)
        iv = spark.read.schema(iv.schema).parquet(folder).select(*iv.columns)  # computed once: the batch is what was stored
        days = [r[0] for r in iv.select("trade_date").distinct().collect()]  # bounded by the calendar
        if not days:
            return
        touched = F.col("trade_date").isin([d for d in days if d is not None])
        touched = touched | F.col("trade_date").isNull() if None in days else touched
        expiry = C.expiry_date("expiration").cast("string")
        # stored, so that a join of them is planned by their size: few groups and spots are broadcast, and the raw rows stay where they are
        groups = cut_lineage(iv.select("symbol", "trade_date", expiry.alias("_expiry")).distinct())
        whole = spark.read.schema(iv.schema).option("basePath", raw).parquet(raw).filter(touched).select(*iv.columns)
        whole = _matching(whole.withColumn("_expiry", expiry), groups, _GROUP, "left_semi").drop("_expiry")
        spot = cut_lineage(chain.first_underlying(whole))  # rows delivered again do not change it
        rows = chain.conform(_chain_rows(chain.band_filter(whole, spot=spot), oi_d, oh_d, snapshot_ts))
        if sinks.has_parts(spark, out, "trade_date"):
            stored = spark.read.schema(rows.schema).parquet(out).filter(touched)
            before = [r[0] for r in stored.select("trade_date").distinct().collect()]
            others = _matching(stored, groups, ["Symbol", "trade_date", "Expiry"], "left_anti")
            rows = cut_lineage(others.select(*rows.columns).unionByName(rows))  # it reads the days that it replaces
        else:
            before = []
        (rows.hint("rebalance", "trade_date").write.mode("overwrite").partitionBy("trade_date")
         .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 5_000_000).parquet(out))
        now = {r[0] for r in rows.select("trade_date").distinct().collect()} if before else set()
        sinks.drop_parts(spark, out, "trade_date", [d for d in before if d not in now])

    return (_csv_cells(spark, iv_dir, max_files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _chain_rows(banded: DataFrame, oi_d: DataFrame, oh_d: DataFrame, snapshot_ts) -> DataFrame:
    """Chain rows of the banded raw rows, each distinct row once. They are dealt by their keys once, for the dropping of equal rows and both
    merges: the keys stand in one column, and so compare with NULLs equal."""
    keys, values = chain.FEED_KEYS, [c for c in banded.columns if c not in chain.FEED_KEYS]

    def by_key(df: DataFrame) -> DataFrame:
        return df.select(F.struct(*keys).alias("_key"), *[c for c in df.columns if c not in keys])

    same = Window.partitionBy("_key", *values).orderBy("seq")  # one sort, which the merges take over
    x = by_key(banded).repartition("_key").withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    for side in (oi_d, oh_d):
        x = x.join(by_key(side), "_key", "left")
    merged = x.select("_key.*", *values, "open_interest", "close", "volume")
    return chain.build_chain_rows(merged, snapshot_ts, band=False)


def _matching(rows: DataFrame, groups: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Rows whose ``columns`` are (``left_semi``) or are not (``left_anti``) a row of ``groups``; NULLs compare equal."""
    g = groups.toDF(*[f"_g{i}" for i in range(len(columns))])
    cond = [rows[c].eqNullSafe(g[f"_g{i}"]) for i, c in enumerate(columns)]
    return rows.join(g, cond, how)


def compact_raw(spark: SparkSession, out: str) -> None:
    """R1's raw rows in one folder instead of one a batch, each row once. To be run while no stream writes; if it fails half way,
    rows are there twice, which R1 ignores."""
    raw = f"{out.rstrip('/')}_raw"
    old = sinks.part_folders(spark, raw, "batch")
    whole = spark.read.parquet(raw)
    whole.drop("batch").distinct().hint("rebalance", "trade_date").write.partitionBy("trade_date").parquet(f"{raw}/batch=whole-{uuid.uuid4().hex}")
    for folder in old:
        fs, p = file_system(spark, folder)
        fs.delete(p, True)


# ---------------------------------------------------------------- R2

def tick_snapshot_stream(ticks: DataFrame, fields: list[str], watermark: str = "10 minutes",
                         window: str = "1 minute") -> DataFrame:
    """R2: latest value per (window, request, field) as one wide row per (window, request).

    ``ticks`` is a streaming (or static) frame (seq, ts, req_id, tick_type, value), with a kind and the option
    columns where it holds all three kinds of ticks (``chain.tick_fields``);
    pivot is not allowed on streams, so each known field is a conditional ``max_by``.
    """
    if ticks.isStreaming and ticks.schema["ts"].dataType.typeName() == "timestamp_ntz":
        # watermarks need TIMESTAMP; static frames keep the zone-free type
        ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    named = chain.tick_fields(ticks) if "kind" in ticks.columns else chain.tick_names(ticks)
    t = named.withWatermark("ts", watermark)
    order = F.struct("ts", "seq")
    aggs = [F.max_by(F.when(F.col("field") == f, F.col("value")),
                     F.when(F.col("field") == f, order)).alias(f) for f in fields]
    return t.groupBy(F.window("ts", window).alias("window"), "req_id").agg(*aggs)


def run_tick_snapshots(spark: SparkSession, ticks_dir: str, fields: list[str], out: str,
                       checkpoint: str, schema: str | None = None) -> StreamingQuery:
    schema = schema or TICK_COLUMNS
    src = spark.readStream.schema(schema).parquet(ticks_dir)
    q = tick_snapshot_stream(src, fields)
    return (q.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# ---------------------------------------------------------------- R3

def price_topup_stream(spark: SparkSession, feed_dir: str, table_root: str, checkpoint: str,
                       max_files: int = 1000) -> StreamingQuery:
    """Parsed EOD rows, K2 upsert per micro-batch; of a batch's rows of one key the last arrival wins.

    Files are taken in the order of arrival, so a later batch's row replaces an earlier one's, as in the feed.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        with staging(batch.sparkSession):
            feed = chain.feed_by_header(cut_lineage(batch), PRICE_COLUMNS)
            parsed = sinks.parse_price_feed(feed.withColumn("seq", F.col("seq").cast("bigint")))
            sinks.merge_keyed(parsed.select("seq", "symbol", "quote_date", "close"), table_root, ["symbol", "quote_date"])

    return (_csv_cells(spark, feed_dir, max_files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# ---------------------------------------------------------------- R4

def signal_stream(spark: SparkSession, features_dir: str, schema, ensemble, table_root: str,
                  checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Score every (symbol, day) of new feature rows with a loaded ensemble (K8 output), K4 upsert."""
    from ..operators.model import run_inference
    feature_cols, models, scalers, weights = ensemble
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(features_dir)

    def write(batch: DataFrame, epoch: int) -> None:
        sig = run_inference(batch, feature_cols, models, scalers, weights, latest=False)
        sinks.merge_keyed(sig, table_root, ["quote_date", "symbol"], seq_col=None)

    return (src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# ---------------------------------------------------------------- R5

def trade_day_buckets(ticks: DataFrame, cutoff_hour: int = 7, ts_col: str = "ts") -> DataFrame:
    """1-day tumbling windows starting at the cut-off hour; trade_date = window start date
    (same day as P6). Works on static and streaming frames (add a watermark for streams)."""
    w = F.window(ts_col, "1 day", "1 day", f"{cutoff_hour} hours")
    return (ticks.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n_ticks"), F.sum("value").alias("value_sum"))
            .select(F.to_date("w.start").alias("trade_date"), "n_ticks", "value_sum"))


# ---------------------------------------------------------------- R2: a snapshot some time after its request

_WAITING = "requested long, failed boolean, field array<string>, at array<long>, seq array<long>, value array<double>"
REQUEST, ERROR = "request", "error"


def wait_snapshots(feed: DataFrame, fields: list[str], wait_seconds: float = 15.0, watermark: str = "10 minutes") -> DataFrame:
    """R2: one wide row per request, ``wait_seconds`` after it: the latest value of each field among the ticks from the
    request on and before that time. A request without a tick, and one with an error, gives no row.

    ``feed`` is a stream of TICK_COLUMNS in which rows of kind ``request`` and ``error`` tell when a request was sent or
    failed. State per request: its time and the latest tick of each field; an event-time timer emits the row and removes the
    state. Rows older than the watermark are late and dropped. Ticks that arrive before their request are kept
    until the watermark passes them; of two requests of one id under way the earlier counts.
    """
    control = feed.filter(F.col("kind").isin(REQUEST, ERROR))
    if feed.schema["ts"].dataType.typeName() == "timestamp_ntz":
        feed, control = (d.withColumn("ts", F.col("ts").cast("timestamp")) for d in (feed, control))
    named = chain.tick_fields(feed.filter(F.col("kind").isNull() | ~F.col("kind").isin(REQUEST, ERROR)))
    marks = control.select("seq", "ts", "req_id", F.concat(F.lit("__"), "kind").alias("field"), F.lit(None).cast("double").alias("value"))
    rows = named.unionByName(marks).withColumn("at", F.unix_micros("ts")).withWatermark("ts", watermark)
    wait = int(wait_seconds * 1_000_000)
    step = _waiting_step(list(fields), wait)
    schema = "req_id long, requested_at long, snapshot_at long, " + ", ".join(f"`{f}` double" for f in fields)
    out = rows.groupBy("req_id").applyInPandasWithState(step, schema, _WAITING, "append", "EventTimeTimeout")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("requested_at", "snapshot_at")})


def _waiting_step(fields: list[str], wait: int):
    import pandas as pd

    def latest(ticks: list[tuple], since: int | None) -> list[tuple]:
        """Per field the last tick by (time, arrival); once the request is known, of its time only."""
        if since is None:
            return ticks
        best: dict = {}
        for f, at, seq, v in ticks:
            if since <= at < since + wait and (f not in best or (at, seq) > best[f][:2]):
                best[f] = (at, seq, v)
        return [(f, at, seq, v) for f, (at, seq, v) in best.items()]

    def row(req_id: int, requested: int, ticks: list[tuple]):
        got = {f: v for f, _, _, v in ticks}
        return pd.DataFrame({"req_id": [req_id], "requested_at": [requested], "snapshot_at": [requested + wait],
                             **{f: pd.array([got.get(f)], dtype="Float64") for f in fields}})

    def step(key, parts, state):
        requested, failed, *lists = state.get if state.exists else (None, False, [], [], [], [])
        ticks = list(zip(*lists))
        if not state.hasTimedOut:
            for part in parts:
                for f, at, seq, v in zip(part["field"], part["at"], part["seq"], part["value"]):
                    if f == f"__{REQUEST}":
                        requested = int(at) if requested is None else min(requested, int(at))
                    elif f == f"__{ERROR}":
                        failed = True
                    else:
                        ticks.append((f, int(at), -1 if pd.isna(seq) else int(seq), None if pd.isna(v) else float(v)))
        now = state.getCurrentWatermarkMs()
        ticks = latest(ticks, requested)
        if requested is None:
            ticks = [t for t in ticks if t[1] >= now * 1000]
            due = max((t[1] for t in ticks), default=0) // 1000 + 1
        else:
            due = -(-(requested + wait) // 1000)
        if state.hasTimedOut or due <= now:
            if state.exists:
                state.remove()
            if requested is not None and ticks and not failed:
                yield row(int(key[0]), requested, ticks)
            return
        state.update((requested, failed, *[[t[i] for t in ticks] for i in range(4)]))
        state.setTimeoutTimestamp(due)

    return step


def run_wait_snapshots(spark: SparkSession, ticks_dir: str, fields: list[str], out: str, checkpoint: str,
                       wait_seconds: float = 15.0, watermark: str = "10 minutes", max_files: int = 1000) -> StreamingQuery:
    src = spark.readStream.schema(TICK_COLUMNS).option("maxFilesPerTrigger", max_files).parquet(ticks_dir)
    rows = wait_snapshots(src, fields, wait_seconds, watermark)
    return (rows.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
