"""Group aggregates. Each builds an aggregate expression of a typed column; rid is the row's position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ARR, BOOL, FLOAT, INT, TaqlError, Val, spark_type
from .coerce import number, real, truth


def _values(v: Val) -> Val:
    """Numbers to aggregate."""
    if v.kind == ARR:
        raise TaqlError("this aggregate takes numbers; of an array, aggregate a statistic of it")
    return number(v)


def _whole(v: Val, f: Callable[[Column], Column]) -> Val:
    v = _values(v)
    return Val(f(v.col).cast("bigint" if v.kind == INT else "double"), v.kind)


def _real(f: Callable[[Column], Column]) -> Callable[[Val, Column, float], Val]:
    return lambda v, rid, q: Val(f(real(_values(v))), FLOAT)


def _product(v: Val, rid: Column, q: float) -> Val:
    return _whole(v, F.product)


def _all_values(v: Val, rid: Column, q: float) -> Val:
    """Values in row order. Holds a whole group in memory, as its result does."""
    pairs = F.array_sort(F.collect_list(F.struct(rid.alias("r"), v.col.alias("v"))))
    return Val(F.transform(pairs, lambda s: s["v"]), ARR, v.kind)


def _percentile(v: Val, rid: Column, q: float) -> Val:
    if not 0 <= q <= 1:
        raise TaqlError("a fractile's fraction lies from 0 to 1")
    return Val(F.percentile(real(_values(v)), F.lit(q)), FLOAT)


def _lead(f: Callable[[Column, Column], Column]) -> Callable[[Val, Column, float], Val]:
    return lambda v, rid, q: Val(f(v.col, rid), v.kind, v.elem)


#: name -> (value, row id, fraction) -> aggregate.
AGGREGATES: dict[str, Callable[[Val, Column, float], Val]] = {
    "GMIN": lambda v, rid, q: _whole(v, F.min),
    "GMAX": lambda v, rid, q: _whole(v, F.max),
    "GSUM": lambda v, rid, q: _whole(v, F.sum),
    "GSUMSQR": lambda v, rid, q: _whole(v, lambda c: F.sum(c * c)),
    "GPRODUCT": _product,
    "GMEAN": _real(F.avg),
    "GAVG": _real(F.avg),
    "GVARIANCE": _real(F.var_pop),
    "GSTDDEV": _real(F.stddev_pop),
    "GRMS": _real(lambda c: F.sqrt(F.avg(c * c))),
    "GMEDIAN": lambda v, rid, q: _percentile(v, rid, 0.5),
    "GFRACTILE": _percentile,
    "GFIRST": _lead(F.min_by),
    "GLAST": _lead(F.max_by),
    "GANY": lambda v, rid, q: Val(F.bool_or(truth(v)), BOOL),
    "GALL": lambda v, rid, q: Val(F.bool_and(truth(v)), BOOL),
    "GNTRUE": lambda v, rid, q: Val(F.count_if(truth(v)), INT),
    "GNFALSE": lambda v, rid, q: Val(F.count_if(~truth(v)), INT),
    "GAGGR": _all_values,
}

#: Aggregates without a column.
def count() -> Val:
    return Val(F.count(F.lit(1)), INT)


def rows(rid: Column) -> Val:
    """Positions of the group's rows, ascending."""
    return Val(F.array_sort(F.collect_list(rid)), ARR, INT)


NAMES = {*AGGREGATES, "GCOUNT", "GROWID"}

__all__ = ["AGGREGATES", "NAMES", "count", "rows", "spark_type"]
