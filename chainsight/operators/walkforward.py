"""Walk-forward preparation: ML table, month index, fold plan and assignment, scaler stats.

Covers P15-P18, M1, M2, J2, W10, A22, A23, A26. Folds are planned per
symbol over the months PRESENT in its data (gaps do not count). Fold
membership is computed arithmetically from the month index, so no range
join between rows and folds is needed: a row lands in at most
ceil(N_train / N_test) training folds (12 for 36/3) and one test fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..session import cut_lineage
from .selection import exact_medians


# ---------------------------------------------------------------- P15-P17, M1

def sparse_feature_shares(df: DataFrame, candidates) -> DataFrame:
    """P15 statistics: null share of every candidate column, one aggregate row."""
    present = [c for c in candidates if c in df.columns]
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in present])


def keep_dense_features(df: DataFrame, candidates=None, max_null_share: float | None = None) -> list[str]:
    """Candidates present in ``df`` whose null share is < ``max_null_share`` (strict).

    One aggregate job; its single result row decides the projection.
    """
    cand = list(candidates or DEFAULTS.feature_cols_base)
    t = DEFAULTS.max_null_share if max_null_share is None else max_null_share
    present = [c for c in cand if c in df.columns]
    if not present:
        return []
    row = sparse_feature_shares(df, present).first()
    return [c for c in present if row[c] is not None and row[c] < t]


def median_fill(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """NULLs replaced by the exact median of the column over the whole table
    (per ``by`` group when given, e.g. symbol). Looks ahead in time, as the reference does. Groups of
    any size: see ``selection.exact_medians``."""
    keys = list(by or [])
    med = exact_medians(df, cols, keys)
    if not keys:
        # one row of k medians: applied as literals
        row = med.first()
        return df.fillna({c: row[c] for c in cols if row is not None and row[c] is not None})
    j = df.join(med.withColumnsRenamed({c: f"_med_{c}" for c in cols}), keys, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols}).drop(
        *[f"_med_{c}" for c in cols])


def fold_median_fill(assigned: DataFrame, cols: list[str], keys=("symbol", "fold_id")) -> DataFrame:
    """P16 variant [ext]: fill NULLs of a fold's train AND test rows with medians of that
    fold's TRAIN rows only (no look-ahead). ``assigned`` is the J2 output; the
    medians table has one row per fold."""
    keys = list(keys)
    med = exact_medians(assigned.filter(F.col("role") == "train"), cols, keys).withColumnsRenamed({c: f"_med_{c}" for c in cols})
    j = assigned.join(med, keys, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols}).drop(
        *[f"_med_{c}" for c in cols])


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL features become 0.0 at inference."""
    return df.fillna(0.0, subset=list(cols))


def ml_table(feat: DataFrame, candidates=None, by: list[str] | None = None,
             keys=("symbol", "quote_date")) -> tuple[DataFrame, list[str]]:
    """M1: P15 + P16, keep keys + features + label + fwd_ret_1d, drop NULL labels, add y = label + 1."""
    by = ["symbol"] if by is None else by
    present = [c for c in (candidates or DEFAULTS.feature_cols_base) if c in feat.columns]
    # the null-share job and the table itself read the same input: write it once to the
    # shared checkpoint dir (reliable, lineage cut) instead of computing the features twice
    feat = cut_lineage(feat.select(*keys, *present, "label", "fwd_ret_1d"))
    cols = keep_dense_features(feat, present)
    t = feat.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols], "label", "fwd_ret_1d")
    t = median_fill(t, cols, by)
    t = t.dropna(subset=["label"]).withColumn("y", (F.col("label") + 1).cast("int"))
    return t, cols


# ---------------------------------------------------------------- months and folds

def month_index(df: DataFrame, date_col: str = "quote_date", by: list[str] | None = None) -> DataFrame:
    """0-based rank of each month PRESENT per symbol, on the distinct-month table
    (bounded by the calendar), joined back to the rows."""
    keys = list(by or ["symbol"])
    d = df.withColumn("ym", F.trunc(date_col, "MM"))
    months = d.select(*keys, "ym").distinct()
    w = Window.partitionBy(*keys).orderBy("ym")
    months = months.withColumn("m_idx", F.row_number().over(w) - 1)
    return d.join(months, keys + ["ym"], "inner")


def fold_plan(indexed: DataFrame, n_train: int | None = None, n_test: int | None = None,
              by: list[str] | None = None) -> DataFrame:
    """M2: folds per symbol: f = 0..F-1, F = floor((M - N) / T) when M >= N + T; the trailing
    partial test window is dropped; boundary dates are FIRST days of the months."""
    n = DEFAULTS.n_train_months if n_train is None else n_train
    t = DEFAULTS.n_test_months if n_test is None else n_test
    keys = list(by or ["symbol"])
    months = indexed.select(*keys, "m_idx", "ym").distinct()
    # one sorted month array per symbol: bounded by the calendar (a few hundred entries)
    per = months.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("m_idx", "ym"))).alias("_ms"))
    per = per.withColumn("_M", F.size("_ms")).withColumn(
        "_F", F.when(F.col("_M") >= n + t, F.floor((F.col("_M") - n) / t)).otherwise(0).cast("int"))
    per = per.filter(F.col("_F") > 0)
    f = per.select(*keys, "_ms", F.explode(F.sequence(F.lit(0), F.col("_F") - 1)).alias("fold_id"))

    def at(i):
        return F.element_at("_ms", (i + 1).cast("int"))["ym"]

    s = F.col("fold_id") * t
    return f.select(*keys, F.col("fold_id").cast("int").alias("fold_id"),
                    at(s).alias("train_start"), at(s + n - 1).alias("train_end"),
                    at(s + n).alias("test_start"), at(s + n + t - 1).alias("test_end"))


def assign_folds(indexed: DataFrame, n_folds: DataFrame, n_train: int | None = None,
                 n_test: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows x folds without a join on ranges: train folds
    f in [max(0, floor((m - N) / T) + 1), min(F - 1, floor(m / T))], test fold floor((m - N) / T)
    when m >= N and it is < F. Output adds ``fold_id`` and ``role`` ('train' / 'test').

    ``n_folds`` has (symbol, F), one row per symbol.
    """
    n = DEFAULTS.n_train_months if n_train is None else n_train
    t = DEFAULTS.n_test_months if n_test is None else n_test
    keys = list(by or ["symbol"])
    m = F.col("m_idx")
    x = indexed.join(n_folds, keys, "inner")
    lo = F.greatest(F.lit(0), F.floor((m - n) / t) + 1).cast("int")
    hi = F.least(F.col("_F") - 1, F.floor(m / t)).cast("int")
    train = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda f: F.struct(f.alias("fold_id"),
                                                                                  F.lit("train").alias("role"))))
    tf = F.floor((m - n) / t).cast("int")
    test = F.when((m >= n) & (tf < F.col("_F")), F.array(F.struct(tf.alias("fold_id"), F.lit("test").alias("role"))))
    both = F.concat(F.coalesce(train, F.array().cast("array<struct<fold_id:int,role:string>>")),
                    F.coalesce(test, F.array().cast("array<struct<fold_id:int,role:string>>")))
    return x.select(*indexed.columns, F.explode(both).alias("_f")).select(*indexed.columns, "_f.fold_id", "_f.role")


def fold_counts(indexed: DataFrame, n_train: int | None = None, n_test: int | None = None,
                by: list[str] | None = None) -> DataFrame:
    """Number of folds F per symbol (one row per symbol) from the month index."""
    n = DEFAULTS.n_train_months if n_train is None else n_train
    t = DEFAULTS.n_test_months if n_test is None else n_test
    keys = list(by or ["symbol"])
    per = indexed.groupBy(*keys).agg((F.max("m_idx") + 1).alias("_M"))
    return per.select(*keys, F.when(F.col("_M") >= n + t, F.floor((F.col("_M") - n) / t)).otherwise(0)
                      .cast("int").alias("_F"))


def fold_sizes(assigned: DataFrame, by: list[str] | None = None, min_train: int | None = None,
               min_test: int | None = None) -> DataFrame:
    """train/test row counts per fold and the size gate (skipped folds keep their id)."""
    a = DEFAULTS.min_train_rows if min_train is None else min_train
    b = DEFAULTS.min_test_rows if min_test is None else min_test
    keys = list(by or ["symbol"])
    c = assigned.groupBy(*keys, "fold_id").agg(F.count_if(F.col("role") == "train").alias("n_train"),
                                              F.count_if(F.col("role") == "test").alias("n_test"))
    return c.withColumn("trained", (F.col("n_train") >= a) & (F.col("n_test") >= b))


def scaler_stats(assigned: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """Per fold, mean and population std of each feature over its TRAIN rows
    (std 0 becomes 1, like a standard scaler); all folds in one aggregation."""
    keys = list(by or ["symbol"])
    tr = assigned.filter(F.col("role") == "train")
    aggs = []
    for c in features:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    s = tr.groupBy(*keys, "fold_id").agg(*aggs)
    return s.withColumns({f"scale_{c}": F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}"))
                          for c in features}).drop(*[f"_sd_{c}" for c in features])


def date_range(df: DataFrame, date_col: str = "quote_date", by: list[str] | None = None) -> DataFrame:
    """First and last date (per ``by`` group)."""
    return df.groupBy(*(by or [])).agg(F.min(date_col).alias("date_min"), F.max(date_col).alias("date_max"))
