"""Statements that write. Each evaluates on the table as it was, then replaces its rows at once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import text, truth
from ..operators.rows import ROWID, number, ordered_number
from ..sources import store
from ..types import ARR, BOOL, CPLX, FLOAT, INT, STR, TYPE_NAMES, TaqlError, Val, default_value, promoted
from . import ast as A
from .binder import Binder, Scope, quoted
from .planner import Lookups, Resolve, plan_rows, plan_select

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}


def coerced(v: Val, to: T.DataType) -> Column:
    """A value as a column's type: reals lose their fraction, integers wrap, anything becomes text, text becomes 0."""
    if isinstance(to, T.StringType):
        return text(v)
    if isinstance(to, T.BooleanType):
        return truth(v)
    if isinstance(to, T.ArrayType):
        return (v.col if v.kind == ARR else F.array(v.col)).cast(to)
    if isinstance(to, T.StructType):
        if to.fieldNames() == ["re", "im"]:
            c = v.col if v.kind == CPLX else F.struct(coerced(v, T.DoubleType()).alias("re"), F.lit(0.0).alias("im"))
            return c.cast(to)
        if to.fieldNames() == ["shape", "data"] and v.kind == ARR:
            return F.struct(F.array(F.size(v.col)).alias("shape"), v.col.alias("data")).cast(to)
        raise TaqlError("a value of this kind can't be stored in the column")
    if v.kind in (STR, ARR, CPLX):
        return F.lit(0).cast(to)
    number = v.col.cast("bigint") if v.kind == BOOL else v.col
    if isinstance(to, (T.FloatType, T.DoubleType)):
        return number.cast(to)
    if v.kind == FLOAT:
        inside = F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))
        number = inside
    bits = _BITS.get(type(to))
    if bits:
        half = 1 << (bits - 1)
        number = F.pmod(number.bitwiseAND(F.lit((1 << bits) - 1)) + half, F.lit(1 << bits)) - half
    return number.cast(to)


def _target(stmt_table: A.TableRef, paths: dict[int, str]) -> str:
    if stmt_table.path is not None:
        return store.clean(stmt_table.path)
    path = paths.get(stmt_table.position or 0)
    if path is None:
        raise TaqlError("only a table with a path of its own can be written, not a view or a frame")
    return path


def update(spark: SparkSession, stmt: A.Update, resolve: Resolve, paths: dict[int, str]) -> str:
    """Right sides see the old values, so a swap works. Values take the columns' types."""
    path = _target(stmt.table, paths)
    source = resolve(stmt.table)
    scope = Scope(source.schema, source.keywords)
    types = {f.name: f.dataType for f in source.schema}
    for c, _ in stmt.sets:
        if c not in types:
            raise TaqlError(f"no column {c}")
    df = source.df
    if stmt.limit is None and not stmt.offset:
        w = Lookups(resolve, "w")
        keep = Binder(scope, lookup=w).predicate(stmt.where) if stmt.where is not None else F.lit(True)
        df = w.apply(df).withColumn("__chosen", keep)
    else:
        chosen, _ = plan_rows(stmt, source, resolve)
        flags = chosen.select(F.col(ROWID), F.lit(True).alias("__flag"))
        df = df.join(flags, ROWID, "left").withColumn("__chosen", F.coalesce("__flag", F.lit(False)))
    lookups = Lookups(resolve, "u")
    binder = Binder(scope, lookup=lookups)
    new = {c: coerced(binder.bind(e), types[c]) for c, e in stmt.sets}
    df = lookups.apply(df)
    df = df.select(
        *[(F.when(F.col("__chosen"), new[c]).otherwise(quoted(c)).alias(c) if c in new else quoted(c)) for c in source.columns], ROWID
    )
    store.save(spark, path, df)
    return path


def delete(spark: SparkSession, stmt: A.Delete, resolve: Resolve, paths: dict[int, str]) -> str:
    """Without WHERE all rows go. The rest are numbered anew."""
    path = _target(stmt.table, paths)
    source = resolve(stmt.table)
    chosen, _ = plan_rows(stmt, source, resolve)
    left = source.df.join(chosen.select(ROWID), ROWID, "left_anti").select(*[quoted(c) for c in source.columns], ROWID)
    store.save(spark, path, ordered_number(left, [F.col(ROWID)]))
    return path


def insert(spark: SparkSession, stmt: A.Insert, resolve: Resolve, paths: dict[int, str]) -> str:
    """By position or by name; columns that aren't given take defaults."""
    path = _target(stmt.table, paths)
    source = resolve(stmt.table)
    result = plan_select(stmt.select, resolve)
    targets = stmt.columns or source.columns[: len(result.names)]
    if len(result.names) > len(source.columns) or stmt.columns is not None and len(targets) != len(result.names):
        raise TaqlError("more values than columns")
    types = {f.name: f.dataType for f in source.schema}
    if missing := [c for c in targets if c not in types]:
        raise TaqlError(f"no column {missing[0]}")
    rows = result.df.orderBy(*(result.order or [F.col(ROWID)])) if result.order or ROWID in result.df.columns else result.df
    rows = number(rows.select(*[quoted(n) for n in result.names]))
    n = source.df.count()
    given = dict(zip(targets, result.names, strict=True))
    out = []
    for c in source.columns:
        if c in given:
            t = rows.schema[given[c]].dataType
            col = quoted(given[c]) if t == types[c] else coerced(promoted(quoted(given[c]), t), types[c])
        else:
            col = default_value(types[c])
        out.append(col.cast(types[c]).alias(c))
    more = rows.select(*out, (F.col(ROWID) + n).alias(ROWID))
    store.save(spark, path, source.df.select(*[quoted(c) for c in source.columns], ROWID).unionByName(more))
    return path


def field_of(spec: A.ColumnSpec) -> T.StructField:
    base = TYPE_NAMES.get(spec.type.lower())
    if base is None:
        raise TaqlError(f"unknown type {spec.type}")
    kind = base
    if spec.shape is not None:
        kind = T.ArrayType(base)
    elif spec.ndim is not None and spec.ndim >= 0:
        kind = store.variable(base)
    meta: dict[str, Any] = {"valueType": spec.type.lower(), "comment": spec.comment, "option": spec.options, "maxlen": spec.maxlen}
    if spec.shape is not None:
        meta |= {"shape": spec.shape, "ndim": len(spec.shape)}
    elif spec.ndim is not None:
        meta["ndim"] = spec.ndim
    return T.StructField(spec.name, kind, True, meta)


def create(spark: SparkSession, stmt: A.Create) -> str:
    path = store.clean(stmt.path)
    schema = T.StructType([field_of(c) for c in stmt.columns])
    if len(set(schema.names)) < len(schema.names):
        raise TaqlError("a column name is used twice")
    meta = {"keywords": dict(stmt.keywords), "column_keywords": {}, "columns": {f.name: f.metadata for f in schema}, "info": {}}
    store.save(spark, path, store.empty_rows(spark, schema, stmt.rows), meta)
    return path


def alter(spark: SparkSession, stmt: A.Alter, paths: dict[int, str]) -> str:
    """Each action is applied and stored before the next."""
    path = _target(stmt.table, paths)
    for action in stmt.actions:
        kind, *args = action
        meta = store.load_meta(spark, path)
        if kind in ("set", "remove"):
            if kind == "set":
                meta["keywords"][args[0]] = args[1]
            elif args[0] not in meta["keywords"]:
                raise TaqlError(f"no keyword {args[0]}")
            else:
                del meta["keywords"][args[0]]
            store.save_meta(spark, path, meta)
            continue
        df = store.load(spark, path)
        names = [c for c in df.columns if c != ROWID]
        if kind == "add":
            field = field_of(args[0])
            if field.name in names:
                raise TaqlError(f"column {field.name} exists")
            added = store.empty_rows(spark, T.StructType([field]), 1).drop(ROWID)
            value = added.first()[0]
            df = df.withColumn(field.name, F.lit(value).cast(field.dataType) if not isinstance(value, (list, tuple)) else default_cell(field))
            meta["columns"][field.name] = field.metadata
        else:
            if args[0] not in names:
                raise TaqlError(f"no column {args[0]}")
            if kind == "drop":
                df = df.drop(args[0])
                meta["columns"].pop(args[0], None)
                meta["column_keywords"].pop(args[0], None)
            else:
                if args[1] in names:
                    raise TaqlError(f"column {args[1]} exists")
                df = df.withColumnRenamed(args[0], args[1])
                for part in ("columns", "column_keywords"):
                    if args[0] in meta[part]:
                        meta[part][args[1]] = meta[part].pop(args[0])
        store.save(spark, path, df, meta)
    return path


def default_cell(field: T.StructField) -> Column:
    """The default of an array of fixed shape, or of a complex number."""
    if isinstance(field.dataType, T.ArrayType):
        size = 1
        for s in (field.metadata or {}).get("shape", []):
            size *= int(s)
        return F.array_repeat(default_value(field.dataType.elementType), size).cast(field.dataType)
    return default_value(field.dataType)


def drop(spark: SparkSession, stmt: A.Drop) -> list[str]:
    from ..sources.files import Files

    paths = [store.clean(p) for p in stmt.paths]
    for p in paths:
        if not store.is_table(spark, p):
            raise TaqlError(f"no table at {p}")
    for p in paths:
        Files(spark).delete(p)
    return paths


HELP = "SELECT, COUNT, CALC, UPDATE, INSERT, DELETE, CREATE TABLE, ALTER TABLE, DROPTABLE, SHOW TABLE"


def show(spark: SparkSession, stmt: A.Show) -> DataFrame:
    """A row per column: name, type, dimensions, shape and comment."""
    if stmt.path is None:
        return spark.createDataFrame([(HELP,)], "help string")
    meta, df = store.load_meta(spark, stmt.path), store.load(spark, stmt.path)
    rows = []
    for f in df.schema:
        if f.name.startswith("__"):
            continue
        own = meta["columns"].get(f.name, {})
        ndim = own.get("ndim", 1 if isinstance(f.dataType, T.ArrayType) else -1)
        rows.append((f.name, own.get("valueType", type_name(f.dataType)), int(ndim), str(own.get("shape", "")), own.get("comment", "")))
    return spark.createDataFrame(rows, "name string, datatype string, ndim int, shape string, comment string")


def type_name(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return type_name(t.elementType)
    if isinstance(t, T.StructType):
        return "dcomplex" if t.fieldNames() == ["re", "im"] else type_name(t["data"].dataType) if "data" in t.fieldNames() else "record"
    return {T.BooleanType: "bool", T.ShortType: "short", T.IntegerType: "int", T.LongType: "int64", T.FloatType: "float"}.get(
        type(t), "string" if isinstance(t, T.StringType) else "double"
    )
