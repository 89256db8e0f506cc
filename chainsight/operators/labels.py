"""Forward-path labels on ordered daily series.

"k days ahead" means k ROWS ahead inside one symbol's series, so every
operator here uses ``Window.partitionBy(symbol).orderBy(date)`` with row
frames. A daily series holds one row per (symbol, date), so a window
partition is bounded by the number of trading days, not by data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS


def _w(symbol_col: str, date_col: str):
    return Window.partitionBy(symbol_col).orderBy(date_col)


def forward_returns(df: DataFrame, price_col: str = "und_price", horizon: int | None = None,
                    symbol_col: str = "symbol", date_col: str = "quote_date",
                    multipliers: bool = False) -> DataFrame:
    """W1 (+ W2 when ``multipliers``): fwd_ret_1d = lead(px,1)/px - 1; fwd_mult_kd = lead(px,k)/px."""
    h = DEFAULTS.horizon if horizon is None else horizon
    w = _w(symbol_col, date_col)
    px = F.col(price_col)
    cols = {"fwd_ret_1d": F.try_divide(F.lead(px, 1).over(w), px) - 1}
    if multipliers:
        for k in range(1, h + 1):
            cols[f"fwd_mult_{k}d"] = F.try_divide(F.lead(px, k).over(w), px)
    return df.withColumns(cols)


def path_extremes(df: DataFrame, price_col: str = "und_price", horizon: int | None = None,
                  symbol_col: str = "symbol", date_col: str = "quote_date") -> DataFrame:
    """Max / min forward return over rows t+1..t+H (NULLs skipped, partial tail kept)."""
    h = DEFAULTS.horizon if horizon is None else horizon
    fw = _w(symbol_col, date_col).rowsBetween(1, h)
    px = F.col(price_col)
    hi, lo = F.max(px).over(fw), F.min(px).over(fw)
    # max over k of lead_k/px is max(lead)/px for px > 0 and min(lead)/px for px < 0
    return df.withColumns({
        "path_fwd_ret_max": F.try_divide(F.when(px < 0, lo).otherwise(hi), px) - 1,
        "path_fwd_ret_min": F.try_divide(F.when(px < 0, hi).otherwise(lo), px) - 1,
    })


def path_labels(df: DataFrame, price_col: str = "und_price", horizon: int | None = None,
                up: float | None = None, down: float | None = None,
                symbol_col: str = "symbol", date_col: str = "quote_date",
                require_full_path: bool = False, multipliers: bool = False) -> DataFrame:
    """Label 1 if path max >= up, else -1 if path min <= down, else 0.

    Up wins when both are hit. Rows whose extremes are NULL are dropped: only
    the last row of a series by default (the frame skips NULL and a partial
    tail still has values). ``require_full_path`` also drops rows with fewer
    than H following rows.
    """
    h = DEFAULTS.horizon if horizon is None else horizon
    if h <= 0:
        raise ValueError("horizon must be > 0")
    up = DEFAULTS.up_threshold if up is None else up
    down = DEFAULTS.down_threshold if down is None else down
    out = forward_returns(df, price_col, h, symbol_col, date_col, multipliers)
    out = path_extremes(out, price_col, h, symbol_col, date_col)
    out = out.withColumn(
        "label",
        F.when(F.col("path_fwd_ret_max") >= up, 1)
         .when(F.col("path_fwd_ret_min") <= down, -1).otherwise(0))
    if require_full_path:
        out = out.withColumn("_ahead", F.lead(F.col(price_col), h).over(_w(symbol_col, date_col)))
        out = out.filter(F.col("_ahead").isNotNull()).drop("_ahead")
    return out.dropna(subset=["path_fwd_ret_max", "path_fwd_ret_min"])
