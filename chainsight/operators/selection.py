"""Exact medians of many columns at once by histogram narrowing (P16 on large tables).

One aggregate finds each column's count, least and greatest value per group. Each further pass counts the values of
all open columns in ``bins`` parts of their open interval and keeps the part in which the median lies: parts of equal ratio while the
interval spans magnitudes, then of equal width, so a heavy tail costs a pass or two and any doubles are told apart in some ten. Passes read the rows,
but shuffle only counts: no task holds a column. As soon as an interval holds few values, an
exact aggregate over those alone ends it. NaN counts as missing, as at the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS = 1024
#: values that one aggregate buffer may hold
FEW = 10_000
#: groups x columns whose intervals may be broadcast
FEW_OPEN = 100_000


def exact_medians(df: DataFrame, cols: list[str], by: list[str] | None = None, few: int = FEW, bins: int = BINS) -> DataFrame:
    """(by..., one column per name): the exact median, the mean of the two middle values for an even count; NULL without values."""
    keys = list(by or [])
    rows = df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])
    most = rows.groupBy(*keys).agg(F.greatest(F.lit(0), *[F.count(c) for c in cols]).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= few:
        return rows.groupBy(*keys).agg(*[F.median(c).alias(c) for c in cols])
    long = _medians(cut_lineage(rows), cols, keys, few, bins)
    groups = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    wide = long.groupBy(*keys).pivot("_c", cols).agg(F.first("_m"))
    if not keys:
        return wide
    right = wide.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *cols)
    return groups.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left").select(*keys, *cols)


def _values(rows: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in cols])
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p._c", "p._v").filter("_v IS NOT NULL")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Inner join on NULL-safe ``keys``; the right side is broadcast where it is known to be small."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(F.broadcast(r) if few else r, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]).drop(*[f"_r_{k}" for k in keys])


def _magnitude(x: Column) -> Column:
    """Sign and logarithm in one rising number, from the least double to the greatest."""
    return F.when(x > 0, F.log(x) + 750).when(x < 0, -(F.log(-x) + 750)).otherwise(F.lit(0.0))


def _medians(rows: DataFrame, cols: list[str], keys: list[str], few: int, bins: int) -> DataFrame:
    """(keys..., _c, _m) by narrowing."""
    at = [*keys, "_c"]
    first = _values(rows, cols, keys).groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    # ranks from 0 of the two middle values, counted from the interval's first value
    opened = cut_lineage(first.select(*at, F.floor((F.col("n") - 1) / 2).alias("r1"), F.floor(F.col("n") / 2).alias("r2"), "n", "lo", "hi"))
    done = []
    while True:
        flat = opened.filter("lo = hi").select(*at, F.col("lo").alias("_m"))
        done.append(flat)
        opened = opened.filter("lo < hi")
        n_open = opened.count()
        if not n_open:
            break
        small, large = opened.filter(F.col("n") <= few), opened.filter(F.col("n") > few)
        inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
        close = n_open <= FEW_OPEN
        got = _joined(_values(rows, cols, keys), small, at, close).filter(inside).groupBy(*at, "r1", "r2").agg(F.sort_array(F.collect_list("_v")).alias("s"))
        done.append(cut_lineage(got.select(*at, ((F.get("s", F.col("r1").cast("int")) + F.get("s", F.col("r2").cast("int"))) / 2).alias("_m"))))
        if not large.take(1):
            break
        lo, hi = F.col("lo"), F.col("hi")
        narrow = ((lo > 0) & (hi <= 4 * lo)) | ((hi < 0) & (lo >= 4 * hi))
        at_v, at_lo, at_hi = (F.when(narrow, x).otherwise(_magnitude(x)) for x in (F.col("_v"), lo, hi))
        share = (at_v - at_lo) / (at_hi - at_lo)
        binned = _joined(_values(rows, cols, keys), large, at, close).filter(inside).withColumn("b", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = binned.groupBy(*at, "b", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*at).orderBy("b").rowsBetween(Window.unboundedPreceding, 0))  # at most ``bins`` rows
        c = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        hit = lambda r: (F.col(r) >= F.col("before")) & (F.col(r) < F.col("upto"))
        c = cut_lineage(c.filter(hit("r1") | hit("r2")).withColumn("both", hit("r1") & hit("r2")))
        # two parts: the middle values are the last of one and the first of the next
        split = c.filter("NOT both").groupBy(*at).agg(F.min("hi").alias("a"), F.max("lo").alias("b"))
        done.append(split.select(*at, ((F.col("a") + F.col("b")) / 2).alias("_m")))
        opened = c.filter("both").select(*at, (F.col("r1") - F.col("before")).alias("r1"), (F.col("r2") - F.col("before")).alias("r2"), "n", "lo", "hi")
    return reduce(lambda a, b: a.unionByName(b), done)
