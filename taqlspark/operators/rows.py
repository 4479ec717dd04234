"""Dense row numbers of tables and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_path

#: Hidden columns: the position in the table or view, and that in the table a view was taken from.
ROWID, BASE_ROWID = "__rowid__", "__base_rowid__"


def read_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with row numbers, in the order of its files' names and of rows within them.

    The position within a file comes with the scan. Files before it are added up from row counts, one
    number per file, so no row is moved.
    """
    df = spark.read.parquet(path)
    names = columns or df.columns
    files = df.inputFiles()
    here = F.col("_metadata.row_index")
    if len(files) <= 1:
        return df.select(*[F.col(f"`{c}`") for c in names], here.cast("bigint").alias(ROWID))
    counts = df.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, at = [], 0
    for f, n in sorted(counts):
        starts.append(Row(__file=f, __start=at))
        at += n
    # one row per file of the table; whether that is sent to all tasks is left to Spark's size check
    offsets = spark.createDataFrame(starts, T.StructType([T.StructField("__file", T.StringType()), T.StructField("__start", T.LongType())]))
    own = df.select(*[F.col(f"`{c}`") for c in names], here.alias("__index"), F.col("_metadata.file_path").alias("__file"))
    return own.join(offsets, "__file").select(*[F.col(f"`{c}`") for c in names], (F.col("__index") + F.col("__start")).alias(ROWID))


def number(df: DataFrame, name: str = ROWID) -> DataFrame:
    """Number the rows of ``df`` from 0 in its order (partition after partition).

    The rows are written to the shared folder first: files are named in the order of partitions, so
    their positions are fixed whatever plan reads them, and no task sees all rows.
    """
    spark = df.sparkSession
    path = stage_path(spark, "numbered")
    kept = df.withColumnRenamed(ROWID, "__kept__") if ROWID in df.columns and name != ROWID else df.drop(ROWID)
    kept.write.parquet(path)
    rows = read_rows(spark, path, kept.columns)
    if name != ROWID:
        rows = rows.withColumnRenamed(ROWID, name)
        if "__kept__" in rows.columns:
            rows = rows.withColumnRenamed("__kept__", ROWID)
    return rows


def ordered_number(df: DataFrame, keys: list, name: str = ROWID) -> DataFrame:  # noqa: ANN001
    """Sort by keys (a range-partitioned sort) and number from 0."""
    return number(df.orderBy(*keys), name)
