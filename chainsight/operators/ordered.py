"""Running totals and ranks over a global order, without a task that holds a whole group.

Rows are sorted in ranges (``repartitionByRange`` with a tie-breaker, so a common key is split too) and written with
the number of their range. A running total is then two-level: inside a range, plus the ranges' totals
before it (one row per group and range).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PART, AT = "_part", "_at"


def in_order(df: DataFrame, order: list) -> DataFrame:
    """``df`` sorted by ``order`` (columns; later ones break ties), with its range (``_part``) and place (``_at``).
    Equal rows are dealt by their number in the input, so no key is too common for a range."""
    tie = "_tie"
    keyed = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    return cut_lineage(ranged.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()}))


def running_total(ordered: DataFrame, by: list[str], weight: str, out: str) -> DataFrame:
    """Inclusive running total of ``weight`` in the order of ``in_order``, per ``by``; NULL keys are groups."""
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = ordered.groupBy(*by, PART).agg(F.sum(weight).alias("_s")).select(*[F.col(c).alias(f"_b_{c}") for c in [*by, PART]],
                                                                             F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    own = ordered.withColumn("_own", F.sum(weight).over(inside))
    cond = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in [*by, PART]]
    return own.join(bases, cond).withColumn(out, F.col("_own") + F.col("_base")).drop("_own", "_base", *[f"_b_{c}" for c in [*by, PART]])


def ranks(ordered: DataFrame, by: list[str], out: str) -> DataFrame:
    """Place from 1 inside ``by``."""
    one = "_one"
    return running_total(ordered.withColumn(one, F.lit(1).cast("long")), by, one, out).drop(one)
