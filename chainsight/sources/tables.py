"""Parquet scans of the input tables (S1, S6, S9 and the raw driver tables).

Every scan is a plain ``spark.read.parquet``: Catalyst prunes columns and
pushes filters into the Parquet reader, so callers select and filter after
the scan and never materialise whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one input table; splits and parallelism follow the session's settings at every size."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL once at the scan (Spark treats NaN as the largest double)."""
    targets = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (DoubleType, FloatType)) and (cols is None or f.name in cols)]
    if not targets:
        return df
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in targets})


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Feature table scan, quote_date as DATE, NaN as NULL, in the order of the date (range-partitioned sort)."""
    df = spark.read.parquet(path)
    return nan_to_null(df.withColumn("quote_date", F.to_date("quote_date"))).orderBy("quote_date")


def price_history(prices: DataFrame, symbol: str) -> DataFrame:
    """One symbol's closes with quote_date renamed to ``date`` (filter pushed to the scan)."""
    return (prices.filter(F.col("symbol") == symbol)
            .select(F.col("quote_date").alias("date"), "symbol", "close"))


def chain_scan(spark: SparkSession, path: str, start=None, end=None,
               symbols: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Historical chain table partitioned by trade_date; pruning by date and columns."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    if symbols:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    if columns:
        df = df.select(*columns)
    return df
