"""Dates and times as modified Julian dates (days since 1858-11-17)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FLOAT, INT, STR, Val
from . import register
from .coerce import real

_ZERO = "1858-11-17"


def mjd(v: Val, safe: bool) -> Column:
    """A number as it is, or an ISO date (dashes or slashes) with an optional time."""
    if v.kind != STR:
        return real(v)
    s = F.translate(F.trim(v.col), "/T", "- ")
    cast = "try_cast" if safe else "cast"
    day = getattr(F.regexp_extract(s, r"^[^ ]+", 0), cast)("date")
    clock = F.split(F.regexp_extract(s, r" +(.*)$", 1), ":")

    def part(i: int) -> Column:
        p = F.coalesce(F.get(clock, i), F.lit(""))
        return F.when(p == "", 0.0).otherwise(getattr(F.when(p == "", "0").otherwise(p), cast)("double"))

    return F.datediff(day, F.lit(_ZERO).cast("date")) + (part(0) * 3600 + part(1) * 60 + part(2)) / 86400.0


def day_of(m: Column) -> Column:
    return F.date_add(F.lit(_ZERO).cast("date"), F.floor(m).cast("int"))


def weekday(m: Column) -> Column:
    """1 on Monday to 7 on Sunday."""
    return (F.pmod(F.floor(m) + 2, F.lit(7)) + 1).cast("bigint")


def week(m: Column) -> Column:
    """Week by its Thursday; days before the first week are in week 0."""
    return F.floor((F.dayofyear(day_of(m)) - weekday(m) + 10) / 7).cast("bigint")


def clock(m: Column) -> Column:
    """HH:MM:SS.mmm of the day's fraction, to the nearest millisecond."""
    ms = F.round((m - F.floor(m)) * 86_400_000.0).cast("bigint")
    return F.concat(
        F.format_string("%02d:%02d:", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000)),
        F.format_string("%02d.%03d", F.floor(ms % 60_000 / 1000), ms % 1000),
    )


def _date(names: str, f, kind: str) -> None:  # noqa: ANN001
    register(*names.split(), least=1, most=1)(lambda args, safe: Val(f(mjd(args[0], safe)), kind))


_date("MJD MJDTODATE DATETIME", lambda m: m, FLOAT)
_date("DATE", lambda m: F.floor(m).cast("double"), FLOAT)
_date("TIME", lambda m: (m - F.floor(m)) * (2 * math.pi), FLOAT)
_date("YEAR", lambda m: F.year(day_of(m)).cast("bigint"), INT)
_date("MONTH", lambda m: F.month(day_of(m)).cast("bigint"), INT)
_date("DAY", lambda m: F.dayofmonth(day_of(m)).cast("bigint"), INT)
_date("WEEKDAY DOW", weekday, INT)
_date("WEEK", week, INT)
_date("CMONTH", lambda m: F.date_format(day_of(m), "MMM"), STR)
_date("CWEEKDAY CDOW", lambda m: F.date_format(day_of(m), "E"), STR)
_date("CDATE", lambda m: F.date_format(day_of(m), "dd-MMM-yyyy"), STR)
_date("CTIME", clock, STR)
_date("CDATETIME CTOD", lambda m: F.concat(F.date_format(day_of(m), "yyyy/MM/dd/"), clock(m)), STR)
