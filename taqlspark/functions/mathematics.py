"""Mathematical functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, CPLX, FLOAT, INT, Val
from . import register
from .coerce import INF, NAN, common, elements, number, real, truth, whole

_MOST, _LEAST = 2**63 - 1, -(2**63)


def _fixed(name: str, value: float) -> None:
    register(name, most=0)(lambda args, safe: Val(F.lit(value), FLOAT, const=value))


_fixed("PI", math.pi)
_fixed("E", math.e)
_fixed("C", 299792458.0)


@register("ABS", least=1, most=1)
def _abs(args: list[Val], safe: bool) -> Val:
    v = number(args[0])
    return Val(F.abs(v.col), v.kind)


@register("NORM", least=1, most=1)
def _norm(args: list[Val], safe: bool) -> Val:
    v = args[0]
    if v.kind == CPLX:
        return Val(F.hypot(v.col["re"], v.col["im"]), FLOAT)
    v = number(v)
    return Val(F.abs(v.col), v.kind)


@register("SIGN", least=1, most=1)
def _sign(args: list[Val], safe: bool) -> Val:
    x = number(args[0]).col
    return Val(F.when(F.isnan(x.cast("double")), 0).when(x > 0, 1).when(x < 0, -1).otherwise(0).cast("bigint"), INT)


def _power(v: Val, n: int) -> Val:
    """v to the power n; integers stay within 64 bits."""
    v = number(v)
    if v.kind == FLOAT:
        out = v.col
        for _ in range(n - 1):
            out = out * v.col
        return Val(out, FLOAT)
    out = v.col
    for _ in range(n - 1):
        out = F.try_multiply(out, v.col)
    top = F.lit(_MOST) if n % 2 == 0 else F.when(v.col > 0, F.lit(_MOST)).otherwise(F.lit(_LEAST))
    return Val(F.when(v.col.isNull(), None).otherwise(F.coalesce(out, top)), INT)


register("SQUARE", "SQR", least=1, most=1)(lambda a, s: _power(a[0], 2))
register("CUBE", least=1, most=1)(lambda a, s: _power(a[0], 3))
register("INT", "INTEGER", least=1, most=1)(lambda a, s: Val(whole(a[0]), INT))


def _step(f):  # noqa: ANN001, ANN202
    def build(args: list[Val], safe: bool) -> Val:
        v = number(args[0])
        if v.kind == INT:
            return v
        # the builtin gives integers, which hold no NaN and no large reals
        large = F.isnan(v.col) | (F.abs(v.col) >= 2.0**52)
        return Val(F.when(large, v.col).otherwise(f(F.when(large, 0.0).otherwise(v.col)).cast("double")), FLOAT)

    return build


register("FLOOR", least=1, most=1)(_step(F.floor))
register("CEIL", least=1, most=1)(_step(F.ceil))
register("ROUND", least=1, most=1)(_step(lambda x: F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))))


def _real1(name: str, f) -> None:  # noqa: ANN001
    register(*name.split(), least=1, most=1)(lambda args, safe: Val(f(real(args[0])), FLOAT))


def _log(f):  # noqa: ANN001, ANN202
    return lambda x: F.when(x == 0, -INF).when(x < 0, NAN).otherwise(f(x))


for _name, _f in {
    "SQRT": F.sqrt, "CBRT": F.cbrt, "EXP": F.exp, "LN LOG": _log(F.ln), "LOG10": _log(F.log10), "SIN": F.sin, "COS": F.cos, "TAN": F.tan,
    "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan, "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh,
}.items():
    _real1(_name, _f)

register("ATAN2", least=2, most=2)(lambda a, s: Val(F.atan2(real(a[0]), real(a[1])), FLOAT))
register("POW", least=2, most=2)(lambda a, s: Val(F.pow(real(a[0]), real(a[1])), FLOAT))


@register("FMOD", least=2, most=2)
def _fmod(args: list[Val], safe: bool) -> Val:
    a, b = real(args[0]), real(args[1])
    return Val(F.when(b == 0, NAN).otherwise(a % F.when(b == 0, 1.0).otherwise(b)), FLOAT)


def _test(name: str, plain: bool, f) -> None:  # noqa: ANN001
    register(name, least=1, most=1)(
        lambda args, safe: Val(f(args[0].col) if args[0].kind == FLOAT else F.lit(plain), BOOL)
    )


_test("ISNAN", False, F.isnan)
_test("ISINF", False, lambda x: F.abs(x) == INF)
_test("ISFINITE", True, lambda x: ~(F.isnan(x) | (F.abs(x) == INF)))
register("ISNULL", least=1, most=1)(lambda a, s: Val(F.lit(False), BOOL))
register("ISDEFINED", least=1, most=1)(lambda a, s: Val(F.lit(True), BOOL))


@register("IIF", least=3, most=3)
def _iif(args: list[Val], safe: bool) -> Val:
    a, b = common(args[1], args[2])
    return Val(F.when(truth(args[0]), a.col).otherwise(b.col), a.kind, a.elem)


def divided(a: Column, b: Column) -> Column:
    """Real division as IEEE has it: a zero divisor gives an infinity or NaN."""
    by_zero = F.when(F.isnan(a) | (a == 0), NAN).otherwise(F.signum(a) * INF)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def euclid(a: Column, b: Column, safe: bool) -> Column:
    """Integer division whose remainder is never negative; a zero divisor is an error, or null."""
    d = F.when(b == 0, None).otherwise(b) if safe else b
    return F.call_function("div", a - F.pmod(a, F.abs(d)), d)


__all__ = ["divided", "elements", "euclid"]
