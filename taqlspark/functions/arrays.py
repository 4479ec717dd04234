"""Array functions on flat arrays, as higher-order expressions inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ARR, BOOL, FLOAT, INT, STR, TaqlError, Val
from . import constant, register
from .coerce import elements, number, numbers, text, together, truth

register("ARRAY")(lambda a, s: Val(together(a)[0], ARR, together(a)[1]) if a else Val(F.array().cast("array<double>"), ARR, FLOAT))
register("FLATTEN", "ARRAYFLATTEN", least=1)(lambda a, s: Val(together(a)[0], ARR, together(a)[1]))
register("SHAPE", least=1, most=1)(
    lambda a, s: Val((F.array(F.size(a[0].col).cast("bigint")) if a[0].kind == ARR else F.array().cast("array<bigint>")), ARR, INT)
)
register("NDIM", least=1, most=1)(lambda a, s: Val(F.lit(int(a[0].kind == ARR)).cast("bigint"), INT))
register("TRANSPOSE", least=1, most=1)(lambda a, s: a[0])
register("REVERSEARRAY", "AREVERSE", least=1, most=1)(lambda a, s: Val(F.reverse(elements(a[0])[0]), ARR, elements(a[0])[1]))


@register("NELEMENTS", "COUNT", least=1, most=1)
def _nelements(args: list[Val], safe: bool) -> Val:
    v = args[0]
    n = F.size(v.col) if v.kind == ARR else F.char_length(v.col) if v.kind == STR else F.lit(1)
    return Val(n.cast("bigint"), INT)


def _real(a: Column) -> Column:
    return a.cast("array<double>")


def _or_zero(a: Column, x: Column, z: float | int = 0.0) -> Column:
    return F.when(F.size(a) == 0, F.lit(z)).otherwise(x)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x. A lambda's body computes again for each element what it is given; this binds x, which is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(a: Column, kind: str) -> Column:
    start = F.lit(0).cast("bigint") if kind == INT else F.lit(0.0)
    return F.aggregate(a, start, lambda x, y: x + y)


def product(a: Column, kind: str) -> Column:
    start = F.lit(1).cast("bigint") if kind == INT else F.lit(1.0)
    return F.aggregate(a, start, lambda x, y: x * y)


def sum_squares(a: Column, kind: str) -> Column:
    start = F.lit(0).cast("bigint") if kind == INT else F.lit(0.0)
    return F.aggregate(a, start, lambda x, y: x + y * y)


def mean(a: Column) -> Column:
    a = _real(a)
    return _or_zero(a, total(a, FLOAT) / F.greatest(F.size(a), F.lit(1)))


def variance(a: Column, sample: bool = False) -> Column:
    """Two passes; 0 where too few elements."""
    a = _real(a)
    n = F.size(a) - int(sample)
    squares = _once(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.when(n < 1, 0.0).otherwise(squares / F.greatest(n, F.lit(1)))


def mean_deviation(a: Column) -> Column:
    a = _real(a)
    deviations = _once(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x - m)))
    return _or_zero(a, deviations / F.greatest(F.size(a), F.lit(1)))


def rms(a: Column) -> Column:
    a = _real(a)
    return F.sqrt(mean(F.transform(a, lambda x: x * x)))


def fractile(a: Column, f: float) -> Column:
    """Linear interpolation at f * (n - 1) of the sorted elements."""
    if not 0 <= f <= 1:
        raise TaqlError("a fractile's fraction lies from 0 to 1")
    s = F.array_sort(_real(a))
    at = F.lit(f) * (F.size(s) - 1)
    lo = F.floor(at).cast("int")
    low = F.get(s, lo)
    high = F.coalesce(F.get(s, lo + 1), low)
    return _or_zero(a, low + (high - low) * (at - lo))


def any_of(a: Column, kind: str) -> Column:
    return F.exists(a, lambda x: truth(Val(x, kind)))


def all_of(a: Column, kind: str) -> Column:
    return (F.size(a) > 0) & F.forall(a, lambda x: truth(Val(x, kind)))


def count_true(a: Column, kind: str) -> Column:
    return F.size(F.filter(a, lambda x: truth(Val(x, kind)))).cast("bigint")


def _keep(f: Callable[[Column, str], Column]) -> Callable[[Column, str, float], tuple[Column, str]]:
    return lambda a, kind, _: (f(a, kind), kind)


def _float(f: Callable[[Column], Column]) -> Callable[[Column, str, float], tuple[Column, str]]:
    return lambda a, kind, _: (f(a), FLOAT)


#: Statistic of an array: (array, kind of its elements, fraction) -> (value, its kind).
STATISTICS: dict[str, Callable[[Column, str, float], tuple[Column, str]]] = {
    "SUM": _keep(total),
    "PRODUCT": _keep(product),
    "SUMSQR": _keep(sum_squares),
    "MIN": _keep(lambda a, kind: F.coalesce(F.array_min(a), F.lit(0).cast("bigint" if kind == INT else "double"))),
    "MAX": _keep(lambda a, kind: F.coalesce(F.array_max(a), F.lit(0).cast("bigint" if kind == INT else "double"))),
    "MEAN": _float(mean),
    "AVG": _float(mean),
    "VARIANCE": _float(variance),
    "SAMPLEVARIANCE": _float(lambda a: variance(a, True)),
    "STDDEV": _float(lambda a: F.sqrt(variance(a))),
    "SAMPLESTDDEV": _float(lambda a: F.sqrt(variance(a, True))),
    "AVDEV": _float(mean_deviation),
    "RMS": _float(rms),
    "MEDIAN": _float(lambda a: fractile(a, 0.5)),
    "FRACTILE": lambda a, kind, f: (fractile(a, f), FLOAT),
    "ANY": lambda a, kind, _: (any_of(a, kind), BOOL),
    "ALL": lambda a, kind, _: (all_of(a, kind), BOOL),
    "NTRUE": lambda a, kind, _: (count_true(a, kind), INT),
    "NFALSE": lambda a, kind, _: (F.size(a).cast("bigint") - count_true(a, kind), INT),
}
_TRUTHS = {"ANY", "ALL", "NTRUE", "NFALSE"}


def _input(name: str, args: list[Val]) -> tuple[Column, str, float]:
    fraction = 0.5
    if name == "FRACTILE":
        if len(args) > 1:
            fraction = float(constant(number(args[-1]), "a fractile's fraction"))
            args = args[:-1]
    col, kind = together(args) if name in _TRUTHS else numbers(args)
    return col, kind, fraction


def _statistic(name: str) -> None:
    def build(args: list[Val], safe: bool) -> Val:
        col, kind = STATISTICS[name](*_input(name, args))
        return Val(col, kind)

    register(name, least=1)(build)

    def running(args: list[Val], safe: bool) -> Val:
        """The statistic of each prefix."""
        whole, kind, _ = _input(name, args)
        out_kind = STATISTICS[name](whole, kind, 0.5)[1]
        sql = {INT: "array<bigint>", FLOAT: "array<double>", BOOL: "array<boolean>"}[out_kind]

        def prefix(a: Column, k: Column) -> Column:
            return _once(F.slice(a, F.lit(1), k), lambda p: STATISTICS[name](p, kind, 0.5)[0])

        def prefixes(a: Column) -> Column:
            ends = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)))
            return F.when(F.size(a) == 0, F.array().cast(sql)).otherwise(F.transform(ends, lambda k: prefix(a, k)))

        def pick(at: Column) -> Column:
            def one(a: Column) -> Column:
                place = F.when(at < 0, at + F.size(a)).otherwise(at).cast("int")
                return F.when((place >= 0) & (place < F.size(a)), prefix(a, place + 1))

            return _once(whole, one)

        return Val(_once(whole, prefixes), ARR, out_kind, pick=pick)

    if name != "FRACTILE":
        register(f"RUNNING{name}", f"BOXED{name}", least=1)(running)


for _name in STATISTICS:
    _statistic(_name)

#: Element-wise statistics across arrays. Fixed values.
PLURALS = {
    "SUMS": "SUM", "PRODUCTS": "PRODUCT", "SUMSQRS": "SUMSQR", "MINS": "MIN", "MAXS": "MAX", "MEANS": "MEAN", "AVGS": "AVG",
    "VARIANCES": "VARIANCE", "SAMPLEVARIANCES": "SAMPLEVARIANCE", "STDDEVS": "STDDEV", "SAMPLESTDDEVS": "SAMPLESTDDEV", "AVDEVS": "AVDEV",
    "RMSS": "RMS", "MEDIANS": "MEDIAN", "FRACTILES": "FRACTILE", "ANYS": "ANY", "ALLS": "ALL", "NTRUES": "NTRUE", "NFALSES": "NFALSE",
}


def _plural(name: str, of: str) -> None:
    def build(args: list[Val], safe: bool) -> Val:
        fraction = 0.5
        if of == "FRACTILE" and len(args) > 1 and args[-1].kind != ARR and args[-1].const is not None:
            fraction, args = float(args[-1].const), args[:-1]
        arrays = [a for a in args if a.kind == ARR]
        if not arrays:
            col, kind, _ = _input(of, args)
            out, kind = STATISTICS[of](col, kind, fraction)
            return Val(out, kind)
        kinds = {elements(a)[1] for a in args}
        kind = FLOAT if FLOAT in kinds else INT if INT in kinds or of not in _TRUTHS else BOOL
        sql = {INT: "array<bigint>", FLOAT: "array<double>", BOOL: "array<boolean>"}[kind]
        n = F.size(arrays[0].col)
        cast = [(elements(a)[0].cast(sql), a.kind == ARR) for a in args]
        same = F.lit(True)
        for a in arrays[1:]:
            same = same & (F.size(a.col) == n)

        def one(i: Column) -> Column:
            return STATISTICS[of](F.array(*[F.get(c, i if many else F.lit(0)) for c, many in cast]), kind, fraction)[0]

        out_kind = STATISTICS[of](cast[0][0], kind, fraction)[1]
        out_sql = {INT: "array<bigint>", FLOAT: "array<double>", BOOL: "array<boolean>"}[out_kind]
        body = F.when(n == 0, F.array().cast(out_sql)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one))
        wrong = F.lit(None).cast(out_sql) if safe else F.raise_error(F.lit(f"{name}: arrays of different lengths")).cast(out_sql)
        return Val(F.when(same, body).otherwise(wrong), ARR, out_kind)

    register(name, least=1)(build)


for _name, _of in PLURALS.items():
    _plural(_name, _of)

__all__ = ["STATISTICS", "text"]
