"""Value kinds of the query language, and column types by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOL, INT, FLOAT, STR, CPLX, ARR, REGEX = "bool", "int", "float", "str", "complex", "array", "regex"

COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
COMPLEX32 = T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())])

#: Column types by name and by the codes of CREATE TABLE. Fixed values.
TYPE_NAMES: dict[str, T.DataType] = {
    "b": T.BooleanType(), "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "u1": T.ShortType(), "uchar": T.ShortType(), "char": T.ShortType(), "byte": T.ShortType(),
    "i2": T.ShortType(), "short": T.ShortType(), "sh": T.ShortType(), "smallint": T.ShortType(),
    "ushort": T.IntegerType(), "usmallint": T.IntegerType(),
    "i4": T.IntegerType(), "int": T.IntegerType(), "i": T.IntegerType(), "integer": T.IntegerType(),
    "u4": T.LongType(), "uint": T.LongType(), "uinteger": T.LongType(),
    "i8": T.LongType(), "int64": T.LongType(),
    "r4": T.FloatType(), "float": T.FloatType(), "f": T.FloatType(),
    "r8": T.DoubleType(), "double": T.DoubleType(), "d": T.DoubleType(),
    "c4": COMPLEX32, "complex": COMPLEX32, "fcomplex": COMPLEX32, "c": COMPLEX32, "cf": COMPLEX32,
    "c8": COMPLEX, "dcomplex": COMPLEX, "cd": COMPLEX,
    "s": T.StringType(), "string": T.StringType(), "record": T.StringType(),
}


class TaqlError(ValueError):
    """A statement that can't be parsed or bound."""


@dataclass
class Val:
    """A typed expression. elem: kind of an array's elements. const: its value if known when planning. pick: an array's
    element at a place, null outside, without the other elements."""

    col: Column
    kind: str
    elem: str | None = None
    const: Any = None
    pick: Callable[[Column], Column] | None = None


def kind_of(t: T.DataType) -> tuple[str, str | None]:
    if isinstance(t, T.BooleanType):
        return BOOL, None
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT, None
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return FLOAT, None
    if isinstance(t, T.ArrayType):
        return ARR, kind_of(t.elementType)[0]
    if isinstance(t, T.StructType) and t.fieldNames() == ["re", "im"]:
        return CPLX, None
    if isinstance(t, T.StructType) and t.fieldNames() == ["shape", "data"]:
        return ARR, kind_of(t["data"].dataType.elementType)[0]
    return STR, None


def spark_type(kind: str, elem: str | None = None) -> str:
    base = {BOOL: "boolean", INT: "bigint", FLOAT: "double", STR: "string", CPLX: "struct<re:double,im:double>"}
    return f"array<{base[elem or FLOAT]}>" if kind == ARR else base[kind]


MJD_EPOCH = 40587


def mjd_of(c: Column, t: T.DataType) -> Column:
    """Modified Julian date (days) of a date or timestamp column, without regard to the session's zone."""
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) + MJD_EPOCH
    if isinstance(t, T.DateType):
        return days.cast("double")
    second = F.date_part(F.lit("SECOND"), c).cast("double")
    return days + (F.hour(c) * 3600 + F.minute(c) * 60 + second) / 86400.0


def promoted(c: Column, t: T.DataType) -> Val:
    """A column as the language sees it: integers as 64-bit, reals as double, times as MJD."""
    kind, elem = kind_of(t)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Val(mjd_of(c, t), FLOAT)
    if kind == ARR:
        data = c["data"] if isinstance(t, T.StructType) else c
        return Val(data.cast(spark_type(ARR, elem)), ARR, elem)
    if kind == STR and not isinstance(t, T.StringType):
        return Val(F.to_json(c) if isinstance(t, (T.StructType, T.MapType)) else c.cast("string"), STR)
    return Val(c.cast(spark_type(kind)), kind, elem)


def default_value(t: T.DataType) -> Any:
    """What an unset cell reads as."""
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.StructType) and t.fieldNames() == ["re", "im"]:
        return F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")).cast(t)
    if isinstance(t, (T.ArrayType, T.StructType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(None).cast(t)
    return F.lit(0).cast(t)


def zero(kind: str, elem: str | None = None) -> Column:
    """The typed zero of a missing value."""
    if kind == ARR:
        return F.array().cast(spark_type(ARR, elem))
    return {BOOL: F.lit(False), INT: F.lit(0).cast("bigint"), FLOAT: F.lit(0.0), STR: F.lit("")}.get(
        kind, F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    )
