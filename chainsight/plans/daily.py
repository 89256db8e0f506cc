"""Daily jobs: chain snapshot ingest, EOD price top-up, signal generation and report.

Ordinary driver functions calling the operators (no scheduler). Each job
handles every symbol in one plan and rewrites only the date partitions it
touches, so a re-run after a failure is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain, model, signals
from ..sources import sinks


def ingest_snapshot(iv: DataFrame, oi: DataFrame, ohlc: DataFrame, chain_path: str,
                    snapshot_ts=None, replace_day: bool = True) -> None:
    """Step 1: feeds -> chain rows (J1, D1, D3, P4, P2, P1) -> K1 (the trade dates of this run
    are overwritten when ``replace_day``; plain append otherwise, like the source)."""
    rows = chain.conform(chain.chain_snapshot(iv, oi, ohlc, snapshot_ts))
    sinks.append_chain(rows, chain_path, replace_day=replace_day)


def top_up_prices(spark: SparkSession, feed: DataFrame, prices_root: str, end, seed_days: int | None = None) -> None:
    """Step 2: P7 -> J6 (only days after the last stored one) -> K2 into the months the new days touch."""
    parsed = sinks.parse_price_feed(feed)
    base = sinks.read_keyed(spark, prices_root)
    if base is None:
        base = parsed.select("symbol", "quote_date", "close").limit(0)
    batch = sinks.incremental_slice(parsed, base, end, seed_days)
    cols = [c for c in ("seq", "symbol", "quote_date", "close") if c in batch.columns]
    sinks.merge_keyed(batch.select(*cols), prices_root, ["symbol", "quote_date"])


def daily_signal(spark: SparkSession, features: DataFrame, artifacts_dir: str, signals_root: str,
                 trade_date=None) -> None:
    """Step 3: K8 -> M9 (latest row per symbol, live gate) -> K4 into the signal table."""
    cols, models, scalers, weights = model.load_ensemble(spark, artifacts_dir)
    sig = model.run_inference(features, cols, models, scalers, weights, trade_date)
    sinks.merge_keyed(sig, signals_root, ["quote_date", "symbol"], seq_col=None)


def signal_report(spark: SparkSession, signals_root: str, trade_date) -> tuple[DataFrame, DataFrame]:
    """Step 4: P19 -> A6 counters and the K6 report table (ordered by symbol at the sink)."""
    table = sinks.read_keyed(spark, signals_root)
    if table is None:
        raise RuntimeError("signal table not found: has the signal job been run?")
    day = signals.day_signals(table, trade_date)
    return signals.signal_counts(day), signals.signal_report(day).orderBy(F.col("Symbol"))
