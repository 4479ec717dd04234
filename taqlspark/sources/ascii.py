"""Tables as text: a line of names, a line of types, then rows of values between white space."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import real_text
from ..operators.rows import ROWID, number
from ..plans.binder import quoted
from ..types import COMPLEX
from . import store
from .files import Files

if TYPE_CHECKING:
    from ..table import Table

#: Type letters: integer, real, double, complex, string.
LETTERS = {"I": T.IntegerType(), "R": T.FloatType(), "D": T.DoubleType(), "X": COMPLEX, "S": T.StringType()}


def read_ascii(spark: SparkSession, path: str, target: str) -> Table:
    """Make a table of a text file. A complex value takes two fields; what can't be read as a number is 0, missing text is empty."""
    from ..table import Table

    lines = spark.read.text(path).where(F.trim("value") != "")
    head = [r["value"].split() for r in lines.limit(2).collect()]
    names, letters = head[0], head[1]
    rows = number(lines).where(F.col(ROWID) >= 2)
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    columns, at = [], 0
    for name, letter in zip(names, letters, strict=True):
        t = LETTERS[letter[0].upper()]

        def field(i: int, kind: str) -> Column:
            return F.coalesce(F.get(parts, F.lit(i)).try_cast(kind), F.lit(0).cast(kind))

        if isinstance(t, T.StructType):
            columns.append(F.struct(field(at, "double").alias("re"), field(at + 1, "double").alias("im")).alias(name))
            at += 2
        elif isinstance(t, T.StringType):
            columns.append(F.coalesce(F.get(parts, F.lit(at)), F.lit("")).alias(name))
            at += 1
        else:
            columns.append(field(at, t.simpleString()).alias(name))
            at += 1
    store.save(spark, target, rows.select(*columns, (F.col(ROWID) - 2).alias(ROWID)), {"keywords": {}, "column_keywords": {}, "columns": {}, "info": {}})
    return Table(spark, store.clean(target))


def _text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return F.when(c, "1").otherwise("0")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return real_text(c.cast("double"))
    if isinstance(t, T.StructType) and t.fieldNames() == ["re", "im"]:
        return F.concat(F.lit("("), real_text(c["re"].cast("double")), F.lit(","), real_text(c["im"].cast("double")), F.lit(")"))
    if isinstance(t, T.StructType) and t.fieldNames() == ["shape", "data"]:
        return _text(c["data"], t["data"].dataType)
    if isinstance(t, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _text(x, t.elementType)), ", "), F.lit("]"))
    return c.cast("string")


def write_ascii(table: Table, path: str, columns: list[str], sep: str = " ") -> None:
    """One text file: names, then rows in order. Booleans are 1 and 0.

    A text file has one writer, so rows pass through a single sorted task; for large tables write Parquet.
    """
    df = table.df()
    types = {f.name: f.dataType for f in df.schema}
    line = F.concat_ws(sep, *[_text(quoted(c), types[c]) for c in columns])
    rows = df.select(ROWID, line.alias("value"))
    head = table.spark.createDataFrame([(-1, sep.join(columns))], rows.schema)
    passing = f"{path}.parts"
    head.unionByName(rows).coalesce(1).sortWithinPartitions(ROWID).select("value").write.mode("overwrite").text(passing)
    files = Files(table.spark)
    [part] = [n for n in files.children(passing) if n.startswith("part-")]
    files.copy(f"{passing}/{part}", path)
    files.delete(passing)
