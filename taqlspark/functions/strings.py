"""String functions, and angles as text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ARR, INT, REGEX, STR, Val
from . import constant, register
from .coerce import elements, real, text, whole
from .patterns import from_glob, from_regex, from_sql

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def raised(c: Column) -> Column:
    return F.translate(c, _LOW, _UP)


register("STRLENGTH", "LEN", least=1, most=1)(lambda a, s: Val(F.char_length(text(a[0])).cast("bigint"), INT))
register("UPCASE", "UPPER", "TOUPPER", "TO_UPPER", least=1, most=1)(lambda a, s: Val(raised(text(a[0])), STR))
register("DOWNCASE", "LOWER", "TOLOWER", "TO_LOWER", least=1, most=1)(lambda a, s: Val(lowered(text(a[0])), STR))
register("REVERSESTRING", "SREVERSE", least=1, most=1)(lambda a, s: Val(F.reverse(text(a[0])), STR))
register("STR", "STRING", least=1, most=1)(lambda a, s: Val(text(a[0]), STR))
register("REPLACE", least=3, most=3)(lambda a, s: Val(F.replace(text(a[0]), text(a[1]), text(a[2])), STR))


@register("CAPITALIZE", least=1, most=1)
def _capitalize(args: list[Val], safe: bool) -> Val:
    t = text(args[0])
    return Val(F.concat(raised(t.substr(F.lit(1), F.lit(1))), lowered(t.substr(F.lit(2), F.char_length(t)))), STR)


def _trimmer(left: bool, right: bool):  # noqa: ANN202
    def build(args: list[Val], safe: bool) -> Val:
        out = text(args[0])
        if len(args) == 2:
            cut = text(args[1])
            if left:
                out = F.ltrim(out, cut)
            if right:
                out = F.rtrim(out, cut)
        else:
            if left:
                out = F.regexp_replace(out, r"(?U)^\s+", "")
            if right:
                out = F.regexp_replace(out, r"(?U)\s+$", "")
        return Val(out, STR)

    return build


register("TRIM", least=1, most=2)(_trimmer(True, True))
register("LTRIM", least=1, most=2)(_trimmer(True, False))
register("RTRIM", least=1, most=2)(_trimmer(False, True))


@register("SUBSTR", "SUBSTRING", least=2, most=3)
def _substr(args: list[Val], safe: bool) -> Val:
    """Characters from start to end, both included and counted from 0, or from the end if negative."""
    t = text(args[0])
    n = F.char_length(t).cast("bigint")

    def place(v: Val) -> Column:
        i = whole(v)
        i = F.when(i < 0, i + n).otherwise(i)
        return F.greatest(F.lit(0).cast("bigint"), F.least(i, n - 1))

    a = place(args[1])
    b = place(args[2]) if len(args) == 3 else n - 1
    return Val(F.when((n == 0) | (a > b), "").otherwise(t.substr((a + 1).cast("int"), (b - a + 1).cast("int"))), STR)


def _pattern(name: str, translate) -> None:  # noqa: ANN001
    register(name, least=1, most=1)(lambda a, s: Val(a[0].col, REGEX, const=translate(str(constant(a[0], name)))))


_pattern("REGEX", from_regex)
_pattern("PATTERN", from_glob)
_pattern("SQLPATTERN", from_sql)


def sexagesimal(v: Column, first: str, width: int, signed: Column | None) -> Column:
    """Whole units, minutes and seconds to a thousandth, of a value that isn't negative."""
    d = F.floor(v)
    m = F.floor((v - d) * 60.0)
    s = (v - d) * 3600.0 - m * 60.0
    body = F.concat(F.lpad(d.cast("string"), width, "0"), F.lit(first), F.format_string("%02d", m), F.lit("m"), F.format_string("%06.3f", s))
    return body if signed is None else F.concat(F.when(signed, "-").otherwise("+"), body)


def hms(x: Column) -> Column:
    """Radians as hours in [0, 24)."""
    h = x * (12.0 / math.pi) % 24.0
    return sexagesimal(F.when(h < 0, h + 24.0).otherwise(h), "h", 2, None)


def dms(x: Column) -> Column:
    return sexagesimal(F.abs(x) * (180.0 / math.pi), "d", 3, x < 0)


def _angle(name: str, f) -> None:  # noqa: ANN001
    def build(args: list[Val], safe: bool) -> Val:
        if args[0].kind == ARR:
            return Val(F.transform(elements(args[0])[0].cast("array<double>"), f), ARR, STR)
        return Val(f(real(args[0])), STR)

    register(name, least=1, most=1)(build)


_angle("HMS", hms)
_angle("DMS", dms)


@register("HDMS", least=1, most=1)
def _hdms(args: list[Val], safe: bool) -> Val:
    """Degrees of every element."""
    return Val(F.transform(elements(args[0])[0].cast("array<double>"), dms), ARR, STR)
