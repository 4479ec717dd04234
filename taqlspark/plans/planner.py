"""From statements that read to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import NAMES as AGGREGATE_NAMES
from ..operators.rows import ROWID, number, ordered_number
from ..types import TaqlError, Val, promoted, zero
from . import ast as A
from .binder import Binder, GroupBinder, Scope, quoted


@dataclass
class Source:
    """A table: rows with ROWID, and its keywords."""

    df: DataFrame
    keywords: dict[str, Any] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema if not f.name.startswith("__")])


Resolve = Callable[[A.TableRef], Source]


@dataclass
class Result:
    """Rows of a SELECT with hidden columns, what they are sorted by, and their visible columns."""

    df: DataFrame
    names: list[str]
    order: list[Column]

    def frame(self, ordered: bool = True) -> DataFrame:
        df = self.df.orderBy(*self.order) if ordered and self.order else self.df
        return df.select(*[quoted(n) for n in self.names])


class Lookups:
    """Row lookups of one step: each adds a left join with the subquery's rows, numbered from 0.

    The reference position is an equi-join key, so the join is a broadcast or a shuffle as the size of
    the subquery's table decides. A position without a row gives the typed zero.
    """

    def __init__(self, resolve: Resolve, prefix: str) -> None:
        self.resolve, self.prefix, self.found = resolve, prefix, []

    def __call__(self, select: A.Select, at: Val) -> Val:
        name = f"__{self.prefix}_{len(self.found)}"
        result = plan_select(select, self.resolve)
        first = result.names[0]
        value = promoted(F.col(name), result.df.schema[first].dataType)
        plain = not (select.where or select.order or select.group or select.unique or select.limit is not None or select.offset)
        rows = result.df if plain else number(result.df.orderBy(*result.order) if result.order else result.df)
        self.found.append((name, at.col, rows.select(F.col(ROWID).alias(f"{name}_i"), quoted(first).alias(name))))
        return Val(F.coalesce(value.col, zero(value.kind, value.elem)), value.kind, value.elem)

    def apply(self, df: DataFrame) -> DataFrame:
        for name, at, rows in self.found:
            df = df.withColumn(f"{name}_at", at).join(rows, F.col(f"{name}_at") == F.col(f"{name}_i"), "left")
        self.found = []
        return df


def named(items: list[A.Item]) -> list[str]:
    """Output names: the alias, a bare column's own name, else col0, col1 and so on; repeats get a number."""
    out: list[str] = []
    unnamed = 0
    for item in items:
        if item.alias:
            name = item.alias
        elif isinstance(item.expr, A.Name):
            name = item.expr.name
        else:
            name, unnamed = f"col{unnamed}", unnamed + 1
        base, k = name, 1
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def sort_keys(keys: list[tuple[Column, bool]], tie: Column) -> list[Column]:
    """Ascending ties go by position. At the first descending key, ties go by position backwards and later keys don't count."""
    out: list[Column] = []
    for col, desc in keys:
        out.append(col.desc_nulls_last() if desc else col.asc_nulls_first())
        if desc:
            return [*out, tie.desc()]
    return [*out, tie.asc()]


def aggregates_in(e: Any) -> bool:
    """Whether an expression holds a group aggregate."""
    if isinstance(e, A.Call) and e.name in AGGREGATE_NAMES:
        return True
    if isinstance(e, A.Subquery):
        return False
    if isinstance(e, list):
        return any(map(aggregates_in, e))
    return any(aggregates_in(x) for x in vars(e).values()) if hasattr(e, "__dataclass_fields__") else False


def plan_rows(stmt: Any, source: Source, resolve: Resolve) -> tuple[DataFrame, list[Column]]:
    """WHERE, ORDERBY, OFFSET and LIMIT of a statement over rows: the chosen rows and their order."""
    scope = Scope(source.schema, source.keywords)
    df = source.df
    lookups = Lookups(resolve, "w")
    binder = Binder(scope, lookup=lookups)
    if stmt.where is not None:
        keep = binder.predicate(stmt.where)
        df = lookups.apply(df).where(keep)
    lookups = Lookups(resolve, "o")
    binder = Binder(scope, lookup=lookups)
    keys = [(binder.bind(k.expr).col, k.desc) for k in stmt.order]
    df = lookups.apply(df)
    for i, (c, _) in enumerate(keys):
        df = df.withColumn(f"__sort_{i}", c)
    order = sort_keys([(F.col(f"__sort_{i}"), d) for i, (_, d) in enumerate(keys)], F.col(ROWID)) if keys else []
    if stmt.limit is not None or stmt.offset:
        df = df.orderBy(*(order or [F.col(ROWID)]))
        if stmt.offset:
            df = df.offset(stmt.offset)
        if stmt.limit is not None:
            df = df.limit(stmt.limit)
        order = order or [F.col(ROWID).asc()]
    return df, order


def plan_select(stmt: A.Select, resolve: Resolve) -> Result:
    source = resolve(stmt.table)
    parts = [i.expr for i in stmt.items or []] + [k.expr for k in stmt.order] + [stmt.having]
    if stmt.group or any(map(aggregates_in, parts)):
        return plan_groups(stmt, source, resolve)
    if stmt.having is not None:
        raise TaqlError("HAVING needs GROUPBY")
    df, order = plan_rows(stmt, source, resolve)
    items = stmt.items if stmt.items is not None else [A.Item(A.Name(c)) for c in source.columns]
    names = named(items)
    scope = Scope(source.schema, source.keywords)
    lookups = Lookups(resolve, "s")
    binder = Binder(scope, lookup=lookups)
    out = []
    for name, item in zip(names, items, strict=True):
        bound = binder.bind(item.expr)
        out.append((quoted(item.expr.name) if isinstance(item.expr, A.Name) else bound.col).alias(name))
    df = lookups.apply(df)
    hidden = [F.col(c) for c in df.columns if c == ROWID or c.startswith("__sort_")]
    df = df.select(*out, *hidden)
    if stmt.unique:
        return unique(df, names, order)
    return Result(df, names, order)


def unique(df: DataFrame, names: list[str], order: list[Column]) -> Result:
    """Distinct rows, in the order in which each is first seen."""
    if order:
        df = ordered_number(df, order, "__place__")
    else:
        df = df.withColumn("__place__", F.col(ROWID))
    df = df.groupBy(*[quoted(n) for n in names]).agg(F.min("__place__").alias(ROWID))
    return Result(df, names, [F.col(ROWID).asc()])


def plan_groups(stmt: A.Select, source: Source, resolve: Resolve) -> Result:
    """WHERE, groups, HAVING, ORDERBY, OFFSET, LIMIT, projection. UNIQUE changes nothing here.

    Groups are in the order of their first rows, of which the smallest position is kept.
    """
    if stmt.items is None and not stmt.group:
        raise TaqlError("aggregates need a list of columns")
    scope = Scope(source.schema, source.keywords)
    rows = A.Select(None, stmt.table, where=stmt.where)
    df, _ = plan_rows(rows, source, resolve)
    lookups = Lookups(resolve, "g")
    keys = [Binder(scope, lookup=lookups).bind(e) for e in stmt.group]
    df = lookups.apply(df)
    native = [quoted(e.name) if isinstance(e, A.Name) else k.col for e, k in zip(stmt.group, keys, strict=True)]
    key_names = [f"__key_{i}" for i in range(len(keys))]
    for n, c in zip(key_names, native, strict=True):
        df = df.withColumn(n, c)

    after = Lookups(resolve, "a")
    binder = KeyedBinder(scope, stmt.group, keys, after)
    having = binder.predicate(stmt.having) if stmt.having is not None else None
    sort = [(binder.bind(k.expr).col, k.desc) for k in stmt.order]
    items = stmt.items if stmt.items is not None else [A.Item(A.Name(c)) for c in source.columns]
    names = named(items)
    out = []
    for name, item in zip(names, items, strict=True):
        bound = binder.bind(item.expr)
        if item.expr in stmt.group and isinstance(item.expr, A.Name):
            bound = Val(F.col(key_names[stmt.group.index(item.expr)]), bound.kind)
        elif isinstance(item.expr, A.Name):
            bound = Val(bound.col.cast(scope_type(scope, item.expr.name)) if castable(scope, item.expr.name) else bound.col, bound.kind)
        out.append(bound.col.alias(name))
    df = df.groupBy(*key_names).agg(*binder.columns(), F.min(ROWID).alias(ROWID))
    if not stmt.group:
        df = df.where(F.col(ROWID).isNotNull())  # no rows, no group
    df = after.apply(df)
    if having is not None:
        df = df.where(having)
    for i, (c, _) in enumerate(sort):
        df = df.withColumn(f"__sort_{i}", c)
    order = sort_keys([(F.col(f"__sort_{i}"), d) for i, (_, d) in enumerate(sort)], F.col(ROWID))
    if stmt.limit is not None or stmt.offset:
        df = df.orderBy(*order)
        if stmt.offset:
            df = df.offset(stmt.offset)
        if stmt.limit is not None:
            df = df.limit(stmt.limit)
    hidden = [F.col(c) for c in df.columns if c == ROWID or c.startswith("__sort_")]
    return Result(df.select(*out, *hidden), names, order)


def scope_type(scope: Scope, name: str) -> T.DataType:
    return scope.fields[name]


def castable(scope: Scope, name: str) -> bool:
    """Whether the first row's value can go back to the column's own type."""
    return isinstance(scope.fields[name], (T.NumericType, T.BooleanType, T.StringType))


class KeyedBinder(GroupBinder):
    """A group binder that takes grouping expressions from the keys."""

    def __init__(self, scope: Scope, group: list[Any], keys: list[Val], lookup: Lookups) -> None:
        super().__init__(scope, lookup=lookup)
        self.group, self.keys = group, keys

    def bind(self, e: Any) -> Val:
        if e in self.group:
            i = self.group.index(e)
            if isinstance(e, A.Name):
                return promoted(F.col(f"__key_{i}"), self.scope.fields[e.name])
            return Val(F.col(f"__key_{i}"), self.keys[i].kind, self.keys[i].elem)
        return super().bind(e)


def plan_count(stmt: A.Count, resolve: Resolve) -> DataFrame:
    source = resolve(stmt.table)
    df, _ = plan_rows(A.Select(None, stmt.table, where=stmt.where), source, resolve)
    return df.agg(F.count(F.lit(1)).alias("count"))


def plan_calc(stmt: A.Calc, resolve: Resolve) -> DataFrame:
    """Expressions at row 0."""
    source = resolve(stmt.table)
    first = Source(source.df.where(F.col(ROWID) == 0), source.keywords)
    return plan_select(A.Select([A.Item(i.expr, i.alias or f"col{k}") for k, i in enumerate(stmt.items)], stmt.table), lambda ref: first if ref == stmt.table else resolve(ref)).frame()
