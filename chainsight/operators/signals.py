"""Ensemble probabilities to trading signals.

All gates are ``when`` chains evaluated inside whole-stage codegen; no
row-wise Python. Member probabilities are a long table
(key..., fold_id, p_down, p_flat, p_up) combined by ONE aggregation, never by
one join or column per fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS

# Class maps down/flat/up = -1/0/1 <-> 0/1/2, report labels 1 BUY, -1 SELL, 0 FLAT.
SIGNAL_LABELS = {1: "BUY", -1: "SELL", 0: "FLAT"}
REPORT_ROUND_COLS = ("proba_up_ens", "proba_flat_ens", "proba_down_ens",
                     "ret_20d", "ret_60d", "vol_20d", "vol_5d", "daily_ret")
REPORT_NAMES = {
    "quote_date": "Date", "symbol": "Symbol", "signal_dir": "Signal",
    "proba_up_ens": "P(Up)", "proba_flat_ens": "P(Flat)", "proba_down_ens": "P(Down)",
    "above_sma200": "Above SMA200", "vol_regime": "Vol Regime",
    "ret_20d": "Ret 20D", "ret_60d": "Ret 60D", "vol_20d": "Vol 20D", "vol_5d": "Vol 5D",
    "daily_ret": "Daily Ret", "sma_200": "SMA 200",
}


# ---------------------------------------------------------------- P18 class codes

def encode_class(label: Column | str) -> Column:
    """Direction -1/0/1 to class index 0/1/2."""
    return (F.col(label) if isinstance(label, str) else label) + 1


def decode_class(idx: Column | str) -> Column:
    """P18 inverse: class index 0/1/2 to direction -1/0/1."""
    return ((F.col(idx) if isinstance(idx, str) else idx) - 1).cast("int")


# ---------------------------------------------------------------- distributions

def class_distribution(df: DataFrame, col: str = "label", by: list[str] | None = None,
                       count_col: str = "n", pct_col: str = "pct") -> DataFrame:
    """Count and % per value (within ``by`` groups when given)."""
    keys = list(by or [])
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias(count_col))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    # the window runs over the grouped result: at most (#groups x #classes) rows
    return counts.withColumn(pct_col, F.col(count_col) * 100.0 / F.sum(count_col).over(w))


def signal_counts(df: DataFrame, signal_col: str = "signal_dir", by: list[str] | None = None) -> DataFrame:
    """Buy / sell / flat counters (per ``by`` group) with ``count_if``."""
    s = F.col(signal_col)
    aggs = [F.count_if(s == 1).alias("buys"), F.count_if(s == -1).alias("sells"),
            F.count_if(s == 0).alias("flats")]
    return df.groupBy(*(by or [])).agg(*aggs)


# ---------------------------------------------------------------- ensemble

def fold_weights(folds: DataFrame, alpha: float | None = None, fold_col: str = "fold_id",
                 by: list[str] | None = None) -> DataFrame:
    """alpha^(K-1-rank) / sum over TRAINED folds (rank = position among fold ids, 0-based).

    ``folds`` holds one row per trained fold (optionally per ``by`` group); the
    table is bounded by the number of folds.
    """
    a = DEFAULTS.alpha if alpha is None else alpha
    keys = list(by or [])
    w_rank = Window.partitionBy(*keys).orderBy(fold_col)
    w_all = Window.partitionBy(*keys)
    base = folds.select(*keys, fold_col).distinct()
    ranked = base.withColumns({"_rank": F.row_number().over(w_rank) - 1,
                               "_k": F.count(F.lit(1)).over(w_all)})
    raw = F.pow(F.lit(a), F.col("_k") - 1 - F.col("_rank"))
    return (ranked.withColumn("_raw", raw)
            .withColumn("weight", F.col("_raw") / F.sum("_raw").over(w_all))
            .select(*keys, fold_col, "weight"))


def ensemble_average(member_probs: DataFrame, weights: DataFrame, keys: list[str],
                     fold_col: str = "fold_id", weight_keys: list[str] | None = None,
                     probs=("p_down", "p_flat", "p_up"),
                     out=("proba_down_ens", "proba_flat_ens", "proba_up_ens"),
                     min_weight: float = 0.0) -> DataFrame:
    """J4 + A24: weighted mean of member probabilities per key.

    ``min_weight`` [ext] also skips folds whose weight is at or below it (with
    alpha 0.7 the oldest folds carry almost nothing); the rest renormalise.

    Weight lookup is a LEFT join on fold id (missing weight = 0); folds with
    weight <= 0 are skipped; rows with no positive weight get 1/3 each. The
    aggregation is partial (map-side) per key.
    """
    wk = [fold_col] + list(weight_keys or [])
    # keyed by fold only, the weights table is bounded by the fold count: broadcast it;
    # keyed by (symbol, fold) it grows with the symbol count, so AQE picks the join
    w_side = F.broadcast(weights) if not weight_keys else weights
    j = member_probs.join(w_side, wk, "left")
    return weighted_average(j, keys, probs, out, min_weight=min_weight)


def weighted_average(members: DataFrame, keys: list[str], probs=("p_down", "p_flat", "p_up"),
                     out=("proba_down_ens", "proba_flat_ens", "proba_up_ens"),
                     weight_col: str = "weight", min_weight: float = 0.0) -> DataFrame:
    """A24 core: sum(w * p) / sum(w) per key over members with w > max(0, min_weight);
    1/3 each when none."""
    w = F.when(F.col(weight_col) > max(0.0, float(min_weight)), F.col(weight_col))
    aggs = [F.sum(w * F.col(p)).alias(f"_s{i}") for i, p in enumerate(probs)]
    g = members.groupBy(*keys).agg(*aggs, F.sum(w).alias("_w"))
    third = F.lit(1.0 / 3.0)
    return g.select(*keys, *[
        F.coalesce(F.try_divide(F.col(f"_s{i}"), F.col("_w")), third).alias(o)
        for i, o in enumerate(out)])


def ensemble_class(df: DataFrame, down="proba_down_ens", flat="proba_flat_ens", up="proba_up_ens",
                   raw_col: str = "pred_raw_ens", dir_col: str = "pred_dir_ens") -> DataFrame:
    """M6: argmax over [down, flat, up] (first wins ties) and direction = class - 1."""
    d, f, u = F.col(down), F.col(flat), F.col(up)
    raw = F.when((d >= f) & (d >= u), 0).when(f >= u, 1).otherwise(2)
    return df.withColumn(raw_col, raw).withColumn(dir_col, decode_class(raw_col))


# ---------------------------------------------------------------- gates

def _num(df: DataFrame, name: str) -> Column | None:
    return F.col(name).cast("double") if name in df.columns else None


def signal_gate(df: DataFrame, mode: str = "batch", thr_up: float | None = None,
                thr_down: float | None = None, flat_filter: bool | None = None,
                sma_filter: bool | None = None, vol_filter: bool | None = None,
                out_col: str = "signal_dir", up="proba_up_ens", flat="proba_flat_ens",
                down="proba_down_ens") -> DataFrame:
    """M7 (``mode="batch"``) and M8 (``mode="live"``) signal gates.

    Both: flat filter (flat >= up and flat >= down -> 0); up if p_up >= thr_up
    and p_up >= p_down; else down likewise; else 0; vol_regime == 0 -> 0.
    batch: above_sma200 != 1 zeroes BOTH directions (NULL counts as != 1).
    live:  above_sma200 != 1 zeroes only LONG signals and is skipped when NULL;
           the vol filter is skipped when NULL.
    A filter whose column is absent is skipped.
    """
    if mode not in ("batch", "live"):
        raise ValueError("mode must be 'batch' or 'live'")
    c = DEFAULTS
    thr_up = c.conf_threshold_up if thr_up is None else thr_up
    thr_down = c.conf_threshold_down if thr_down is None else thr_down
    flat_filter = c.use_flat_class_filter if flat_filter is None else flat_filter
    sma_filter = c.use_above_sma200_filter if sma_filter is None else sma_filter
    vol_filter = c.use_vol_regime_filter if vol_filter is None else vol_filter
    pu, pf, pd = F.col(up), F.col(flat), F.col(down)

    direction = (F.when((pu >= thr_up) & (pu >= pd), 1)
                 .when((pd >= thr_down) & (pd >= pu), -1).otherwise(0))
    sig = direction
    above = _num(df, "above_sma200")
    if sma_filter and above is not None:
        if mode == "batch":
            sig = F.when(~above.eqNullSafe(1.0), 0).otherwise(sig)
        else:
            sig = F.when(above.isNotNull() & (sig == 1) & (above != 1.0), 0).otherwise(sig)
    vol = _num(df, "vol_regime")
    if vol_filter and vol is not None:
        # batch: NULL == 0 is not true, so NULL passes in both modes
        sig = F.when(vol.isNotNull() & (vol == 0.0), 0).otherwise(sig)
    if flat_filter:
        sig = F.when((pf >= pu) & (pf >= pd), 0).otherwise(sig)
    return df.withColumn(out_col, sig.cast("int"))


def add_positions(df: DataFrame, signal_col: str = "signal_dir", out_col: str = "position_dir",
                  by: list[str] | None = None, date_col: str = "quote_date") -> DataFrame:
    """position = signal lagged one row inside the series, first row 0."""
    w = Window.partitionBy(*(by or ["symbol"])).orderBy(date_col)
    return df.withColumn(out_col, F.coalesce(F.lag(signal_col, 1).over(w), F.lit(0)).cast("int"))


def add_signal_columns(df: DataFrame, by: list[str] | None = None, **gate_kw) -> DataFrame:
    """M7 + W9: batch gate then one-row-lagged position."""
    return add_positions(signal_gate(df, mode="batch", **gate_kw), by=by)


# ---------------------------------------------------------------- report

def context_columns(df: DataFrame, cols=None) -> DataFrame:
    """P20: the context columns as doubles; absent ones become NULL."""
    cols = list(cols or DEFAULTS.context_cols)
    return df.withColumns({c: (F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double"))
                           for c in cols})


def day_signals(signals: DataFrame, trade_date) -> DataFrame:
    """Rows of one quote_date (pushed down to the scan); ordered by symbol at the sink."""
    return signals.filter(F.col("quote_date") == F.lit(trade_date).cast("date"))


def signal_report(df: DataFrame, scale: int = 4) -> DataFrame:
    """K6: -1/0/1 to SELL/FLAT/BUY (unknown -> FLAT), round 8 columns to 4 dp, readable names."""
    sig = F.col("signal_dir")
    label = F.when(sig == 1, "BUY").when(sig == -1, "SELL").otherwise("FLAT")
    out = df.withColumn("signal_dir", label)
    out = out.withColumns({c: F.round(F.col(c), scale) for c in REPORT_ROUND_COLS if c in out.columns})
    return out.withColumnsRenamed({k: v for k, v in REPORT_NAMES.items() if k in out.columns})
