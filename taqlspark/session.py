"""Session helpers: the shared folder, staged tables and the code that workers need."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session that names
    none gets a temporary folder of its own; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    set_by_caller = sc.getCheckpointDir()
    if set_by_caller:
        return set_by_caller.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="taqlspark-"))
    return sc.getCheckpointDir().rstrip("/")


def stage_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/taqlspark/{tag}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a plan once its result is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, tag: str, compact: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    compact: the rows are far smaller than what they were made from, so that each task has only a few of
    them; they are gathered into files of a useful size first.
    """
    spark = df.sparkSession
    path = stage_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.hint("rebalance") if compact else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(staged: DataFrame | None) -> None:
    """Remove the files of a table made by ``stage`` that nothing will read again; others are left alone."""
    path = getattr(staged, "_staged", None)
    if path is not None:
        hadoop = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_taqlspark_shipped", False):
        return
    fd, path = tempfile.mkstemp(prefix="taqlspark-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._taqlspark_shipped = True


def batches_of(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows and the bytes of an Arrow batch, so that a batch of very long texts still fits a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def size_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target: int = 128 << 20) -> int:
    """Shuffle partitions for ``df``: the session's number, or more for a large input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, min(200_000, -(-size_bytes(df) // target)))
