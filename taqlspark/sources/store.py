"""Table directories: Parquet data beside a JSON file that says what the table is.

``_table.json`` names the current data folder, the columns' descriptions, keywords and info. A change
writes a new data folder and then replaces that file, so readers of the old state are not disturbed
and a failed change leaves nothing but an unused folder. Row numbers are stored with the rows.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import ROWID, number, read_rows
from ..types import TaqlError, default_value
from .files import Files

META = "_table.json"


def clean(path: str) -> str:
    """A path as given or as a keyword names it."""
    if path.startswith("Table: "):
        path = path[7:]
    if "::" in path:
        path, _, sub = path.partition("::")
        path = f"{path.rstrip('/')}/{sub}" if sub else path
    return path.rstrip("/") or "/"


def is_table(spark: SparkSession, path: str) -> bool:
    return Files(spark).exists(f"{clean(path)}/{META}")


def load_meta(spark: SparkSession, path: str) -> dict[str, Any]:
    """The description of a table directory; a plain Parquet file or folder has an empty one."""
    path, files = clean(path), Files(spark)
    if files.exists(f"{path}/{META}"):
        return json.loads(files.read(f"{path}/{META}"))
    return {"keywords": {}, "column_keywords": {}, "columns": {}, "info": {}}


def save_meta(spark: SparkSession, path: str, meta: dict[str, Any]) -> None:
    Files(spark).write(f"{clean(path)}/{META}", json.dumps(meta, indent=1).encode())


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ROWID."""
    path = clean(path)
    meta = load_meta(spark, path)
    if "data" in meta:
        schema = T.StructType.fromJson(meta["schema"])
        return spark.read.schema(T.StructType([*schema.fields, T.StructField(ROWID, T.LongType())])).parquet(f"{path}/{meta['data']}")
    if not Files(spark).exists(path):
        raise TaqlError(f"no table at {path}")
    return read_rows(spark, path)


def save(spark: SparkSession, path: str, df: DataFrame, meta: dict[str, Any] | None = None) -> None:
    """Make ``df`` (with ROWID, dense from 0) the table's rows."""
    path, files = clean(path), Files(spark)
    new = dict(meta if meta is not None else load_meta(spark, path))
    old, data = new.get("data"), f"data-{uuid.uuid4().hex}"
    files.make_dir(path)
    df.write.parquet(f"{path}/{data}")
    names = [c for c in df.columns if not c.startswith("__")]
    own = new.get("columns", {})
    fields = [f.jsonValue() | {"metadata": f.metadata or own.get(f.name, {})} for f in df.select(*[F.col(f"`{c}`") for c in names]).schema]
    new |= {"data": data, "schema": {"type": "struct", "fields": fields}}
    for key in ("keywords", "column_keywords", "columns", "info"):
        new.setdefault(key, {})
    save_meta(spark, path, new)
    if old:
        files.delete(f"{path}/{old}")


def save_new(spark: SparkSession, path: str, df: DataFrame, meta: dict[str, Any] | None = None) -> None:
    """A new table of a result's rows in their order."""
    save(spark, path, number(df), meta or {"keywords": {}, "column_keywords": {}, "columns": {}, "info": {}})


def empty_rows(spark: SparkSession, schema: T.StructType, n: int) -> DataFrame:
    """n rows of default values."""
    rows = spark.range(n).select(F.col("id").alias(ROWID))
    columns = []
    for f in schema:
        shape = f.metadata.get("shape") if f.metadata else None
        if isinstance(f.dataType, T.ArrayType) and shape:
            size = 1
            for s in shape:
                size *= int(s)
            value = F.array_repeat(default_value(f.dataType.elementType), size).cast(f.dataType)
        else:
            value = default_value(f.dataType)
        columns.append(value.alias(f.name, metadata=f.metadata or {}))
    return rows.select(*columns, ROWID)


def variable(element: T.DataType) -> T.StructType:
    """Type of a cell that holds an array of any shape: null where undefined."""
    return T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(element))])
