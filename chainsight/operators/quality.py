"""Data-quality operators: table and null profiles, date gaps, return outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Column names searched, in order, for the date and symbol of a table profile.
DATE_CANDIDATES = ("date", "quote_date", "trade_date", "created_at")
SYMBOL_CANDIDATES = ("symbol", "Symbol", "ticker", "underlying_symbol")


def profile_table(df: DataFrame, date_candidates=DATE_CANDIDATES,
                  symbol_candidates=SYMBOL_CANDIDATES) -> DataFrame:
    """A1: row count, min/max of the first date-like column, distinct symbols; one aggregate pass."""
    cols = set(df.columns)
    date_col = next((c for c in date_candidates if c in cols), None)
    sym_col = next((c for c in symbol_candidates if c in cols), None)
    aggs = [F.count(F.lit(1)).alias("row_count")]
    if date_col:
        aggs += [F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date")]
    if sym_col:
        aggs.append(F.count_distinct(sym_col).alias("n_symbols"))
    return df.agg(*aggs)


def null_profile(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """A2: null count and null % per column, largest first; one aggregate then an unpivot."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot("__n", cols, "column_name", "null_count")
    long = long.select("column_name", F.col("null_count").cast("bigint").alias("null_count"),
                       (F.col("null_count") * 100.0 / F.col("__n")).alias("null_pct"))
    if only_positive:
        long = long.filter(F.col("null_count") > 0)
    return long


def date_gaps(df: DataFrame, date_col: str = "quote_date", symbol_col: str = "symbol") -> DataFrame:
    """Previous date in the series and the calendar gap in days."""
    w = Window.partitionBy(symbol_col).orderBy(date_col)
    return df.withColumns({"prev_date": F.lag(date_col).over(w)}).withColumn(
        "gap_days", F.datediff(F.col(date_col), F.col("prev_date")))


def large_gaps(df: DataFrame, max_gap: int = 5, date_col: str = "quote_date",
               symbol_col: str = "symbol") -> DataFrame:
    """Rows whose calendar gap to the previous row exceeds ``max_gap`` days."""
    return date_gaps(df, date_col, symbol_col).filter(F.col("gap_days") > max_gap)


def pct_change(df: DataFrame, price_col: str = "close", out_col: str = "ret_1d",
               date_col: str = "quote_date", symbol_col: str = "symbol") -> DataFrame:
    """One-row percent change px / lag(px) - 1."""
    w = Window.partitionBy(symbol_col).orderBy(date_col)
    return df.withColumn(out_col, F.try_divide(F.col(price_col), F.lag(price_col).over(w)) - 1)


def return_outliers(df: DataFrame, threshold: float = 0.05, price_col: str = "close",
                    date_col: str = "quote_date", symbol_col: str = "symbol") -> DataFrame:
    """Rows with abs(1-day return) > threshold."""
    return pct_change(df, price_col, "ret_1d", date_col, symbol_col).filter(
        F.abs(F.col("ret_1d")) > threshold)


def last_stored_date(df: DataFrame, symbol_col: str = "symbol", date_col: str = "quote_date") -> DataFrame:
    """A3: last stored date per symbol (partial aggregation; symbols absent have no row -> NULL on join)."""
    return df.groupBy(symbol_col).agg(F.max(date_col).alias("last_date"))


def latest_rows(df: DataFrame, date_col: str = "quote_date", symbol_col: str | None = "symbol") -> DataFrame:
    """The latest row per symbol (``max_by`` on a struct: a partial aggregate, no sort).

    With ``symbol_col=None`` it is the single latest row of the table, as
    ``ORDER BY date DESC LIMIT 1`` (a top-1, planned as TakeOrderedAndProject).
    """
    if symbol_col is None:
        return df.orderBy(F.col(date_col).desc()).limit(1)
    cols = [c for c in df.columns if c != symbol_col]
    return (df.groupBy(symbol_col)
            .agg(F.max_by(F.struct(*cols), F.col(date_col)).alias("_r"))
            .select(symbol_col, "_r.*"))


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """Raise when a DataFrame is empty (one ``limit(1)`` probe, no full count)."""
    if not df.limit(1).take(1):
        raise RuntimeError(f"{what} is empty")
    return df
