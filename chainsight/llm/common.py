"""Helpers the training-data operators share: reading tables, written intermediates, two-level ranks, components.

Intermediates are written as Parquet under the folder that ``spark.checkpoint.dir`` names, so a
lost executor recomputes nothing above them. A machine-local folder is used only where the
setting is unset *and* the master is local (tests, benches).
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master one is made where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="chainsight-llm-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, computes once. ``files``: at most so many
    files, for tables whose size the caller knows to be small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(batches, column, most: int = 4 << 20):
    """Arrow batches cut into parts of about ``most`` bytes of the texts in ``column`` (one row at least): what a
    worker makes of a part is bounded by that, whatever the lengths of the texts."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def prefix_totals(counts: DataFrame, part: list[str], bucket: str, weight: str, out: str) -> DataFrame:
    """Exclusive running total of ``weight`` over ``bucket`` inside ``part``; ``counts`` has one
    row per (part, bucket), so a window holds at most as many rows as there are buckets."""
    w = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(weight).over(w), F.lit(0)).cast("long"))


def ranked(df: DataFrame, part: list[str], spread: Column, order: list, out: str, buckets: int) -> DataFrame:
    """Gapless rank from 0 inside ``part`` in two levels: ``spread`` deals the rows of a part into
    ``buckets`` windows, and the buckets' counts give each window its first rank. No window holds
    more than a bucket of a part, however many rows one part has."""
    b, base, n = "__bucket", "__base", "__n"
    dealt = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int"))
    bases = prefix_totals(dealt.groupBy(*part, b).agg(F.count(F.lit(1)).alias(n)), part, b, n, base)
    first = F.row_number().over(Window.partitionBy(*part, b).orderBy(*order)).cast("long") - 1
    inner = dealt.withColumn(out, first)
    on = [inner[c].eqNullSafe(bases[c]) for c in [*part, b]]
    joined = inner.join(bases, on)
    return joined.select(*[inner[c] for c in df.columns], (inner[out] + bases[base]).alias(out))


def components(edges: DataFrame, hub: int = 20_000) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) by alternating large and small stars.

    Returns (node, root) for every node that is not its component's smallest. Each round's edges
    are written; the driver sees only a count and a checksum. The smallest neighbour is a pre-aggregated
    minimum. It is joined back to the neighbours of a node; those of a hub (more than ``hub``, and more than a thousandth of
    all rows) meet it in a broadcast table of at most about 1000 hubs, so they are never gathered in a task.
    """
    e = written(edges.filter("a <> b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = _signature(e)
    while sign[0]:
        bound = max(hub, 2 * sign[0] // 1000)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "lowest")
        large = _with_least(both.filter("v > u"), low, "u", bound).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = _with_least(large, least, "a", bound).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last, sign = sign, _signature(e)
        if sign == last:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _with_least(rows: DataFrame, least: DataFrame, key: str, bound: int) -> DataFrame:
    """``rows`` with ``m`` of their key. ``least`` has (key, m, n): keys with more than ``bound`` rows are looked up in a
    broadcast table; rows over ``bound`` bounds their number."""
    hubs = F.broadcast(least.filter(F.col("n") > bound).select(F.col(key).alias("__hub"), F.col("m").alias("__m")))
    marked = rows.join(hubs, F.col(key) == F.col("__hub"), "left")
    others = marked.filter("__hub IS NULL").join(least.filter(F.col("n") <= bound).select(F.col(key).alias("__k"), "m"), F.col(key) == F.col("__k"))
    return others.select(*rows.columns, "m").unionByName(marked.filter("__hub IS NOT NULL").select(*rows.columns, F.col("__m").alias("m")))


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
