"""Spark session helpers.

``get_spark`` is for tests, benches and scripts: on a cluster the caller's
session is used as is. Checkpoint directory: read ``spark.checkpoint.dir``
from the session; only when it is unset (local tests) is a scratch folder set.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "chainsight") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory. Where the setting is unset, a scratch folder of this
    machine is set on a local master only; on a cluster executors could not share it, so it raises."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="chainsight-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


_staged = threading.local()


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``, whatever store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextmanager
def staging(spark: SparkSession):
    """The tables that ``cut_lineage`` writes inside (in this thread) are deleted at the end, after an error too.
    For steps whose result stands elsewhere by then: a merge, a micro-batch."""
    outer = getattr(_staged, "paths", None)
    _staged.paths = []
    try:
        yield
    finally:
        for path in _staged.paths:
            fs, p = file_system(spark, path)
            fs.delete(p, True)
        _staged.paths = outer


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared checkpoint directory and read it back.

    This cuts the lineage (a lost executor recomputes nothing upstream) with ONE
    computation of the plan; a reliable ``DataFrame.checkpoint`` would compute it
    twice (once for the count, once for the checkpoint files) unless persisted.
    The table read back also gets column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if getattr(_staged, "paths", None) is not None:
        _staged.paths.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
