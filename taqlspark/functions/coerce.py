"""Conversions between kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ARR, BOOL, CPLX, FLOAT, INT, STR, TaqlError, Val

INF, NAN = float("inf"), float("nan")


def number(v: Val) -> Val:
    """A number; booleans count as 0 and 1, strings and arrays are errors."""
    if v.kind == BOOL:
        return Val(v.col.cast("bigint"), INT, const=None if v.const is None else int(v.const))
    if v.kind in (INT, FLOAT):
        return v
    raise TaqlError(f"a number is needed, not a value of kind {v.kind}")


def real(v: Val) -> Column:
    v = number(v)
    return v.col.cast("double") if v.kind == INT else v.col


def whole(v: Val) -> Column:
    """A 64-bit integer, cut off toward zero."""
    v = number(v)
    return v.col if v.kind == INT else v.col.cast("bigint")


def truth(v: Val) -> Column:
    """Truth: a number that isn't 0 (NaN too), any string or array."""
    if v.kind == BOOL:
        return v.col
    if v.kind == INT:
        return v.col != 0
    if v.kind == FLOAT:
        return v.col != 0.0
    return F.lit(True)


def text(v: Val) -> Column:
    """As written: whole reals without a point, no exponents, true and false."""
    if v.kind == STR:
        return v.col
    if v.kind in (INT, BOOL):
        return v.col.cast("string")
    if v.kind == FLOAT:
        return real_text(v.col)
    return F.lit("[array]")


def real_text(x: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", x), "0+$", ""), r"\.$", "")
    short = x.cast("string")
    exact = F.when(short.contains("E"), F.regexp_replace(F.regexp_replace(short.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")).otherwise(short)
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == INF, "inf")
        .when(x == -INF, "-inf")
        .when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string"))
        .when(x == F.floor(x), F.format_string("%.0f", x))
        .when((F.abs(x) < 1e19) & (F.abs(x) > 1e-17), exact)
        .otherwise(plain)
    )


def elements(v: Val) -> tuple[Column, str]:
    """Array and kind of its elements; a scalar is an array of one, a complex number one of two."""
    if v.kind == ARR:
        return v.col, v.elem or FLOAT
    if v.kind == CPLX:
        return F.array(v.col["re"], v.col["im"]), FLOAT
    return F.array(v.col), v.kind


def together(args: list[Val]) -> tuple[Column, str]:
    """All elements of all arguments, in one kind."""
    parts = [elements(a) for a in args]
    kinds = {k for _, k in parts}
    if len(kinds) == 1:
        kind = kinds.pop()
    elif kinds <= {INT, FLOAT, BOOL}:
        kind = FLOAT if FLOAT in kinds else INT
    else:
        raise TaqlError("strings and numbers can't be elements of one array")
    sql = {BOOL: "array<boolean>", INT: "array<bigint>", FLOAT: "array<double>", STR: "array<string>"}[kind]
    cast = [c.cast(sql) for c, _ in parts]
    return (cast[0] if len(cast) == 1 else F.concat(*cast)), kind


def numbers(args: list[Val]) -> tuple[Column, str]:
    col, kind = together(args)
    if kind == BOOL:
        return col.cast("array<bigint>"), INT
    if kind == STR:
        raise TaqlError("numbers are needed")
    return col, kind


def common(a: Val, b: Val) -> tuple[Val, Val]:
    """Two values in one kind."""
    if a.kind == b.kind and a.elem == b.elem:
        return a, b
    if {a.kind, b.kind} <= {BOOL, INT, FLOAT}:
        if FLOAT in (a.kind, b.kind):
            return Val(real(a), FLOAT), Val(real(b), FLOAT)
        return Val(whole(a), INT), Val(whole(b), INT)
    if ARR in (a.kind, b.kind):
        col, kind = together([a, b])
        del col
        sql = {INT: "array<bigint>", FLOAT: "array<double>", STR: "array<string>", BOOL: "array<boolean>"}[kind]
        return Val(elements(a)[0].cast(sql), ARR, kind), Val(elements(b)[0].cast(sql), ARR, kind)
    return Val(text(a), STR), Val(text(b), STR)
