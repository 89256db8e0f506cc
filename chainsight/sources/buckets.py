"""Bucketed tables: chain and feeds stored by (symbol, trade_date), so that the merge, the spot and the features of a day
need no shuffle (S9, J1).

A table is written once with its rows dealt to buckets by a hash of the keys and sorted inside them; joins and aggregates on
these keys (and any more) then read matching buckets side by side. Spark joins on more keys than those of the buckets without a shuffle only where
``co_partitioned`` (a session setting) allows it; without it the result is the same and the feeds are shuffled. A busy (symbol, day) is one bucket's; the number of
buckets is the number of tasks, so choose it by the size of the table.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chain import FEED_KEYS, dedupe_last
from ..session import ensure_checkpoint_dir

KEYS = ["symbol", "trade_date"]
#: rows of a bucket, about: a task sorts them at once
BUCKET_ROWS = 500_000


def bucket_count(rows: DataFrame, least: int = 8, each: int = BUCKET_ROWS) -> int:
    """Buckets for the largest of the tables that are joined: as many as keep a bucket at about ``each`` rows at every size."""
    return max(least, -(-rows.count() // each))


def write_bucketed(df: DataFrame, name: str, keys: list[str] = KEYS, buckets: int = 200, path: str | None = None) -> DataFrame:
    """Store ``df`` as the catalog table ``name`` in ``buckets`` buckets of ``keys`` and return it. The files are under ``path``, or in the
    shared folder. A NULL key raises: the bucketed joins compare keys with plain equality."""
    spark = df.sparkSession
    folder = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/buckets/{name}"
    for k in keys:
        df = df.withColumn(k, F.coalesce(F.col(k), F.raise_error(F.lit(f"NULL in bucket column {k}")).cast(df.schema[k].dataType)))
    # dealt by the same hash first, so that each bucket is one file
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).format("parquet").saveAsTable(name)
    return spark.table(name)


@contextmanager
def co_partitioned(spark: SparkSession):
    """Plans made inside may join tables by buckets of only some of the join keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def merge_bucketed(iv: DataFrame, oi: DataFrame, ohlc: DataFrame, seq_col: str = "seq") -> DataFrame:
    """J1 on bucketed feeds: as ``chain.merge_feeds``, with plain equality on the bucket columns."""
    rest = [k for k in FEED_KEYS if k not in KEYS]

    def join(left: DataFrame, side: DataFrame, values: list[str]) -> DataFrame:
        last = dedupe_last(side.select(*FEED_KEYS, seq_col, *values), FEED_KEYS, seq_col).drop(seq_col)
        r = last.select(*[F.col(k).alias(f"_r_{k}") for k in FEED_KEYS], *values)
        cond = [left[k] == r[f"_r_{k}"] for k in KEYS] + [left[k].eqNullSafe(r[f"_r_{k}"]) for k in rest]
        return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in FEED_KEYS])

    return join(join(iv, oi, ["open_interest"]), ohlc, ["close", "volume"])
