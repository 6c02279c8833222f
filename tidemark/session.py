"""Spark session defaults and the shared scratch folder that jobs write intermediate tables to."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}

_fallback: dict[str, str] = {}


def get_spark(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine (tests, a laptop) a temporary
    folder is made and used; on a cluster executors wouldn't see it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _fallback[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's part of the shared folder, which :func:`sweep` deletes."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Delete every table and file that this application wrote to the shared folder.

    Results are lazy and read such tables, so only their owner knows when they are done with: call it once the last result
    has been written elsewhere. What a stopped application left is in a folder of its name and can be deleted whole.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: what comes after is computed from files that outlive any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`materialize` returned, once nothing reads it."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/tidemark/" in name:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


#: A table of keys and short columns may be broadcast up to so many rows.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, hinted for broadcast only if a count shows that it is within ``limit`` rows."""
    return F.broadcast(df) if row_count_at_most(df, limit) else df


#: Rows that one task is dealt: of a series before windows widen each row to a kilobyte or more, of a table of features.
SERIES_A_TASK, FEATURES_A_TASK = 131_072, 524_288


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` to so many tasks that each gets about ``rows`` rows, and no fewer than run at once.

    Adaptive execution joins the partitions of other shuffles until they hold 64 MB as compressed; where rows grow within
    the task that's gigabytes. It leaves a number that is given alone. Rows are counted first: read ``df`` from a table where it is costly.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
    # a shuffle below by the same keys to the same number would stand for this one, and its partitions be joined
    n += n == int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application, unless PYTHONPATH gives it to them already."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tidemark", "zip", root, "tidemark"))
    _shipped.add(app)
