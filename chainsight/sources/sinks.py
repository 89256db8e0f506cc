"""Sinks and incremental ingest on plain Parquet: append, keyed upsert, range replace.

Parquet has no primary key and no MERGE here. ``upsert`` and ``replace_range`` express keyed writes as set
operations (anti join + union). A keyed table on disk is a row of versions: data folders by batch and month, which are
never changed, and a small pointer file per version that names the folder of each month. ``merge_keyed`` and ``replace_keyed`` read
and write only the months that a batch touches; the pointer is written last, by a rename that fails if the version is there already. So
a reader sees the table before or after a write, never between; a job that fails leaves it as it was; of two writers
that began at the same version one raises ``ConcurrentWrite``; and running a batch again gives the same table. The folders of
the version before stay for readers that have begun. (The rename is exclusive on HDFS-like stores and local disks; an object store
needs a committer that makes it so.)
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import columns as C
from ..operators.chain import dedupe_last
from ..operators.quality import last_stored_date
from ..session import cut_lineage, file_system, staging


# ---------------------------------------------------------------- parsing

def parse_price_feed(feed: DataFrame, start=None, end=None, created_col: str = "created",
                     close_col: str = "close") -> DataFrame:
    """quote_date from ``created[:10]``, close from text; rows with an empty or bad
    date or close are skipped; optional inclusive [start, end] range."""
    out = feed.withColumns({"quote_date": C.iso_date_prefix(created_col),
                            "_close": C.text_number(close_col)})
    out = out.filter(F.col("quote_date").isNotNull() & F.col("_close").isNotNull())
    if start is not None:
        out = out.filter(F.col("quote_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        out = out.filter(F.col("quote_date") <= F.lit(str(end)).cast("date"))
    return out.drop(close_col).withColumnRenamed("_close", close_col)


# ---------------------------------------------------------------- incremental slice

def incremental_slice(feed: DataFrame, stored: DataFrame, end, seed_days: int | None = None,
                      keys=("symbol",), date_col: str = "quote_date") -> DataFrame:
    """Per symbol, feed rows after the last stored date (or from end - seed_days when the
    symbol has no history) up to ``end`` inclusive; stored days are not refetched.

    The last-stored table has one row per symbol (A3); the join is on the
    symbol key and the filter is a plain range predicate.
    """
    seed = DEFAULTS.price_seed_days if seed_days is None else seed_days
    end_d = F.lit(str(end)).cast("date")
    last = last_stored_date(stored, keys[0], date_col)
    j = feed.join(last, list(keys), "left")
    start_excl = F.coalesce(F.col("last_date"), F.date_sub(end_d, seed + 1))
    return j.filter((F.col(date_col) > start_excl) & (F.col(date_col) <= end_d)).drop("last_date")


# ---------------------------------------------------------------- keyed writes (K2, K3, K4)

def upsert(base: DataFrame, new: DataFrame, keys: list[str], seq_col: str | None = "seq") -> DataFrame:
    """K2/K4: INSERT OR REPLACE on ``keys``: last write wins inside the batch (by ``seq``),
    batch rows replace stored rows with the same key; columns matched by name."""
    cols = base.columns
    if seq_col and seq_col in new.columns:
        new = dedupe_last(new, keys, seq_col)
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(base.schema[c].dataType).alias(c)
                       for c in cols])
    kept = base.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new)


def replace_range(base: DataFrame, batch: DataFrame, date_col: str = "quote_date",
                  symbol_col: str = "symbol") -> DataFrame:
    """K3 + J5: delete stored rows with date BETWEEN the batch's min and max AND symbol IN the
    batch's symbols (also days absent from the batch), then insert the batch BY NAME.

    The bounds are scalar subqueries of the plan (no job runs while it is built); as in SQL, rows without a date are not
    in any range and stay. The symbol set is a join with the batch's distinct symbols.
    """
    bounds = batch.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    syms = batch.select(symbol_col).distinct().withColumn("_hit", F.lit(True))
    in_range = F.col(date_col).between(bounds.select("lo").scalar(), bounds.select("hi").scalar())
    gone = F.coalesce(in_range & F.col("_hit").isNotNull(), F.lit(False))
    kept = base.join(syms, symbol_col, "left").filter(~gone).drop("_hit")
    return kept.unionByName(batch.select(*[c for c in batch.columns if c in base.columns]),
                            allowMissingColumns=True)


def union_all(frames: list[DataFrame], by_name: bool = True, allow_missing: bool = False) -> DataFrame:
    """UNION ALL of frames, matched by column name (missing columns NULL when allowed)."""
    if by_name:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
    return reduce(lambda a, b: a.union(b), frames)


def beside(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """U4: the columns of ``values`` put beside ``rows`` by their keys, never by position; ``values`` has one row a key."""
    return rows.join(values, list(keys), "left")


# ---------------------------------------------------------------- physical writes (K1, versioned tables)

def append_chain(df: DataFrame, path: str, replace_day: bool = False) -> None:
    """K1: append chain rows partitioned by trade_date (a re-run duplicates, like the source);
    ``replace_day=True`` overwrites only the partitions present in ``df`` (dynamic overwrite).
    An empty input writes no partition (no-op) without a separate emptiness job."""
    # rows of a day come together before the partitioned write, so no task writes a small file for each
    # day; AQE splits a day that is large, so the busiest day is not one task
    w = df.hint("rebalance", "trade_date").write.partitionBy("trade_date").option("maxRecordsPerFile", 5_000_000)
    if replace_day:
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        w.mode("append").parquet(path)


PART = "part"
BATCH = "batch"
#: versions whose folders stay
KEEP = 2


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this one read the table."""


def _month(date_col: str) -> Column:
    """Partition value of a date: m1996_01; rows without a date have their own."""
    return F.coalesce(F.date_format(date_col, "'m'yyyy_MM"), F.lit("none"))


def part_folders(spark: SparkSession, root: str, column: str) -> list[str]:
    """Folders ``column=...`` right below ``root``."""
    fs, p = file_system(spark, root)
    if not fs.exists(p):
        return []
    return [str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{column}=")]


def has_parts(spark: SparkSession, root: str, column: str) -> bool:
    return bool(part_folders(spark, root, column))


def drop_parts(spark: SparkSession, root: str, column: str, values: list) -> None:
    """Delete the folders of some partition values (None: rows without one)."""
    for v in values:
        fs, p = file_system(spark, f"{root.rstrip('/')}/{column}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}")
        fs.delete(p, True)


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = file_system(spark, f"{root.rstrip('/')}/_versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _pointer(root: str, n: int) -> str:
    return f"{root.rstrip('/')}/_versions/v{n:010d}.json"


def _parts(spark: SparkSession, root: str, n: int) -> dict[str, str]:
    """Month -> batch folder of a version."""
    return json.loads(_read_text(spark, _pointer(root, n)))["parts"]


def current_version(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number and months of the newest version; (0, {}) if there is no table."""
    have = _versions(spark, root)
    return (have[-1], _parts(spark, root, have[-1])) if have else (0, {})


def table_exists(spark: SparkSession, root: str) -> bool:
    return bool(_versions(spark, root))


def _rows_of(spark: SparkSession, root: str, parts: dict[str, str]) -> DataFrame | None:
    base = f"{root.rstrip('/')}/data"
    if not parts:
        return None
    return spark.read.option("basePath", base).parquet(*[f"{base}/{BATCH}={b}/{PART}={m}" for m, b in sorted(parts.items())]).drop(BATCH)


def read_keyed(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """A keyed table's rows (of the newest version, or of ``version`` while its folders stay), None if there is no table."""
    parts = current_version(spark, root)[1] if version is None else _parts(spark, root, version)
    rows = _rows_of(spark, root, parts)
    return None if rows is None else rows.drop(PART)


def _put(df: DataFrame, root: str) -> dict[str, str]:
    """Write rows with their month into a new batch folder; returns its months."""
    spark, batch = df.sparkSession, uuid.uuid4().hex
    folder = f"{root.rstrip('/')}/data/{BATCH}={batch}"
    df.hint("rebalance", PART).write.partitionBy(PART).option("maxRecordsPerFile", 5_000_000).parquet(folder)
    return {f.rsplit(f"{PART}=", 1)[1]: batch for f in part_folders(spark, folder, PART)}


def _commit(spark: SparkSession, root: str, n: int, parts: dict[str, str], written: dict[str, str]) -> None:
    """Make ``parts`` version ``n`` + 1, unless somebody else has; then the batch just written goes."""
    jvm = spark.sparkContext._jvm
    draft = f"{root.rstrip('/')}/_versions/draft-{uuid.uuid4().hex}"
    fs, p = file_system(spark, draft)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps({"parts": parts}).encode()))
    out.close()
    _, final = file_system(spark, _pointer(root, n + 1))
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(p, final, never)
    except Exception as e:  # noqa: BLE001 - py4j wraps the store's own exception
        fs.delete(p, True)
        _drop_batches(spark, root, set(written.values()))
        if n + 1 in _versions(spark, root):
            raise ConcurrentWrite(f"version {n + 1} of {root} was committed by another writer") from e
        raise
    vacuum(spark, root, KEEP)


def _drop_batches(spark: SparkSession, root: str, batches: set[str]) -> None:
    drop_parts(spark, f"{root.rstrip('/')}/data", BATCH, sorted(batches))


def vacuum(spark: SparkSession, root: str, keep: int = KEEP) -> None:
    """Delete the pointers before the last ``keep`` versions and the month folders that only these named. Folders of writes
    under way, which no version names yet, stay."""
    have = _versions(spark, root)
    old, new = have[:-keep], have[-keep:]
    used = {(m, b) for n in new for m, b in _parts(spark, root, n).items()}
    for n in old:
        for m, b in _parts(spark, root, n).items():
            if (m, b) not in used:
                drop_parts(spark, f"{root.rstrip('/')}/data/{BATCH}={b}", PART, [m])
        fs, p = file_system(spark, _pointer(root, n))
        fs.delete(p, True)


def write_keyed(df: DataFrame, root: str, date_col: str = "quote_date") -> None:
    """Create a keyed table, or overwrite the months that ``df`` holds."""
    spark = df.sparkSession
    n, parts = current_version(spark, root)
    new = _put(df.withColumn(PART, _month(date_col)), root)
    _commit(spark, root, n, {**parts, **new}, new)


def merge_keyed(new: DataFrame, root: str, keys: list[str], date_col: str = "quote_date",
                seq_col: str | None = "seq") -> None:
    """K2/K4 on disk: upsert ``new`` into the table at ``root``; only the months of ``new`` are read and rewritten.

    With ``seq_col`` the table keeps the arrival number and of equal keys the last arrival stays (stored rows without
    one come first), so the result does not depend on how a feed is cut into batches. Without it the
    batch's row replaces the stored one. ``new`` is computed once (written); its distinct months,
    bounded by the calendar, choose the folders that are read.
    """
    spark = new.sparkSession
    if seq_col:
        new = dedupe_last(new, keys, seq_col)
    with staging(spark):
        n, parts = current_version(spark, root)
        new = cut_lineage(new.withColumn(PART, _month(date_col)))
        months = {r[0] for r in new.select(PART).distinct().collect()}
        stored = _rows_of(spark, root, {m: b for m, b in parts.items() if m in months})
        if stored is not None:
            if seq_col:
                new = dedupe_last(stored.unionByName(new), keys, seq_col)
            else:
                new = upsert(stored, new, keys, seq_col=None)
        put = _put(new, root)
        _commit(spark, root, n, {**parts, **put}, put)


def replace_keyed(batch: DataFrame, root: str, date_col: str = "quote_date", symbol_col: str = "symbol") -> None:
    """K3 on disk: ``replace_range`` on the months between the batch's first and last date; a month that
    is left without rows is not in the new version."""
    spark = batch.sparkSession
    with staging(spark):
        n, parts = current_version(spark, root)
        batch = cut_lineage(batch.withColumn(PART, _month(date_col)))
        dated = F.when(F.col(PART) != "none", F.col(PART))
        lo, hi = batch.agg(F.min(dated), F.max(dated)).first()
        if not parts:
            put = _put(batch, root)
            _commit(spark, root, n, put, put)
        elif lo is not None:
            between = {m: b for m, b in parts.items() if lo <= m <= hi}
            stored = _rows_of(spark, root, between)
            put = _put(replace_range(stored, batch, date_col, symbol_col) if stored is not None else batch, root)
            kept = {m: b for m, b in parts.items() if m not in between}
            _commit(spark, root, n, {**kept, **put}, put)


# ---------------------------------------------------------------- ordered output (T4)

def write_ordered(df: DataFrame, path: str, order: list, files: int | None = None) -> None:
    """T4: rows as sorted files whose names follow the order. Ranges are cut by ``order`` and a tie-breaker, so a
    value that many rows share is split over files. ``order``: columns, ascending or ``.desc()``."""
    tie = "_tie"
    keyed = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(files, *order, tie) if files else keyed.repartitionByRange(*order, tie)
    ranged.sortWithinPartitions(*order, tie).drop(tie).write.parquet(path)


def read_ordered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """The rows of ``write_ordered`` with their place from 1: by file name, then by row in the file."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, "_file").withColumn(position, F.col("_base") + F.col("_row") + 1).drop("_file", "_row", "_base")
