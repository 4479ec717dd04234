"""Quantities: unit algebra when a plan is made, plain column arithmetic when it runs."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.strings import sexagesimal

#: Base dimensions: metre, kilogram, second, ampere, kelvin, mole, candela, radian.
DIMS = ("m", "kg", "s", "A", "K", "mol", "cd", "rad")


def _u(scale: float, **dims: int) -> tuple[float, tuple[int, ...]]:
    return scale, tuple(dims.get(d, 0) for d in DIMS)


_DEG = math.pi / 180
#: Scale to SI and dimensions of each unit. Fixed values.
UNITS: dict[str, tuple[float, tuple[int, ...]]] = {
    "m": _u(1, m=1), "g": _u(1e-3, kg=1), "s": _u(1, s=1), "A": _u(1, A=1), "K": _u(1, K=1), "mol": _u(1, mol=1), "cd": _u(1, cd=1), "rad": _u(1, rad=1),
    "sr": _u(1, rad=2), "deg": _u(_DEG, rad=1), "arcmin": _u(_DEG / 60, rad=1), "arcsec": _u(_DEG / 3600, rad=1), "as": _u(_DEG / 3600, rad=1),
    "'": _u(_DEG / 60, rad=1), '"': _u(_DEG / 3600, rad=1), "min": _u(60, s=1), "h": _u(3600, s=1), "d": _u(86400, s=1), "a": _u(31557600, s=1), "yr": _u(31557600, s=1), "cy": _u(3155760000, s=1),
    "Hz": _u(1, s=-1), "N": _u(1, m=1, kg=1, s=-2), "Pa": _u(1, m=-1, kg=1, s=-2), "J": _u(1, m=2, kg=1, s=-2), "W": _u(1, m=2, kg=1, s=-3),
    "C": _u(1, s=1, A=1), "V": _u(1, m=2, kg=1, s=-3, A=-1), "F": _u(1, m=-2, kg=-1, s=4, A=2), "Ohm": _u(1, m=2, kg=1, s=-3, A=-2), "S": _u(1, m=-2, kg=-1, s=3, A=2),
    "Wb": _u(1, m=2, kg=1, s=-2, A=-1), "T": _u(1, kg=1, s=-2, A=-1), "H": _u(1, m=2, kg=1, s=-2, A=-2), "lm": _u(1, cd=1, rad=2), "lx": _u(1, m=-2, cd=1, rad=2),
    "Jy": _u(1e-26, kg=1, s=-2), "eV": _u(1.60217733e-19, m=2, kg=1, s=-2), "erg": _u(1e-7, m=2, kg=1, s=-2), "dyn": _u(1e-5, m=1, kg=1, s=-2), "G": _u(1e-4, kg=1, s=-2, A=-1),
    "pc": _u(3.0856775814913674e16, m=1), "AU": _u(149597870659.0, m=1), "lyr": _u(9.4607304725808e15, m=1), "ly": _u(9.4607304725808e15, m=1), "Angstrom": _u(1e-10, m=1),
    "in": _u(0.0254, m=1), "ft": _u(0.3048, m=1), "mile": _u(1609.344, m=1), "u": _u(1.6605402e-27, kg=1), "lb": _u(0.45359237, kg=1), "t": _u(1000, kg=1), "l": _u(1e-3, m=3), "bar": _u(1e5, m=-1, kg=1, s=-2), "atm": _u(101325, m=-1, kg=1, s=-2),
    "beam": _u(1), "pixel": _u(1), "count": _u(1), "lambda": _u(1), "%": _u(0.01), "": _u(1),
}
#: Prefixes; longer ones are tried first.
PREFIXES: dict[str, float] = {
    "da": 1e1, "E": 1e18, "G": 1e9, "M": 1e6, "P": 1e15, "T": 1e12, "Y": 1e24, "Z": 1e21, "a": 1e-18, "c": 1e-2, "d": 1e-1, "f": 1e-15,
    "h": 1e2, "k": 1e3, "m": 1e-3, "n": 1e-9, "p": 1e-12, "u": 1e-6, "y": 1e-24, "z": 1e-21,
}
#: Physical constants as (value, unit).
CONSTANTS: dict[str, tuple[float, str]] = {"pi": (math.pi, ""), "ee": (math.e, ""), "c": (299792458.0, "m/s"), "G": (6.67259e-11, "N.m2/kg2"), "h": (6.6260755e-34, "J.s"), "k": (1.380658e-23, "J/K"), "e": (1.60217733e-19, "C")}


class UnitError(ValueError):
    """Unknown units, or units that don't conform."""


@dataclass(frozen=True)
class Unit:
    """What is shown, and the scale and dimensions in SI."""

    text: str
    scale: float
    dims: tuple[int, ...]

    def conforms(self, other: Unit) -> bool:
        return self.dims == other.dims

    @property
    def is_angle(self) -> bool:
        return self.dims == UNITS["rad"][1]

    @property
    def is_time(self) -> bool:
        return self.dims == UNITS["s"][1]

    @property
    def plain(self) -> bool:
        return not any(self.dims)


_PART = re.compile(r"\s*(?:(?P<name>[A-Za-z'\"%]+)(?:\^|\*\*)?(?P<power>[+-]?\d+)?|(?P<op>[./*()]))")


def unit(text: str) -> Unit:
    """Parse names with prefixes, exponents, ``.`` or ``*``, ``/`` and brackets. A known name wins over a prefix and a name."""
    at = 0

    def token() -> re.Match[str] | None:
        return _PART.match(text, at) if text[at:].strip() else None

    def one(name: str) -> tuple[float, tuple[int, ...]]:
        if name in UNITS:
            return UNITS[name]
        for p in sorted(PREFIXES, key=lambda x: -len(x)):
            if name.startswith(p) and name[len(p) :] in UNITS and name != p:
                scale, dims = UNITS[name[len(p) :]]
                return PREFIXES[p] * scale, dims
        raise UnitError(f"unknown unit {name!r} in {text!r}")

    def product(close: bool) -> tuple[float, tuple[int, ...]]:
        nonlocal at
        scale, dims, sign = 1.0, (0,) * len(DIMS), 1
        while m := token():
            if m["op"]:
                if m["op"] == ")":
                    if not close:
                        raise UnitError(f"unexpected ) in {text!r}")
                    at = m.end()
                    return scale, dims
                at = m.end()
                if m["op"] == "(":
                    s, d = product(True)
                    if p := re.match(r"(?:\^|\*\*)?([+-]?\d+)", text[at:]):
                        at += p.end()
                        s, d = s ** int(p[1]), tuple(x * int(p[1]) for x in d)
                elif m["op"] == "/":
                    sign = -1
                    continue
                else:
                    sign = 1
                    continue
            else:
                at = m.end()
                s, d = one(m["name"])
                p = int(m["power"] or 1)
                s, d = s**p, tuple(x * p for x in d)
            scale *= s**sign
            dims = tuple(a + sign * b for a, b in zip(dims, d, strict=True))
            sign = 1
        if close:
            raise UnitError(f"missing ) in {text!r}")
        if text[at:].strip():
            raise UnitError(f"can't read {text[at:]!r} in {text!r}")
        return scale, dims

    scale, dims = product(False)
    return Unit(text.strip(), scale, dims)


def _powered(name: str, n: int) -> str:
    return name if n == 1 else f"{name}{n}"


def si_text(dims: tuple[int, ...]) -> str:
    return ".".join(_powered(d, n) for d, n in zip(DIMS, dims, strict=True) if n)


def general(value: float, digits: int) -> str:
    """``%g`` with a decimal exponent of two digits at least."""
    if value == 0:
        return "0"
    return f"{value:.{digits}g}"


@dataclass(frozen=True)
class Quantity:
    """A number or a column with a unit."""

    value: Any
    unit: Unit

    def _same(self, other: Quantity) -> Any:
        if not self.unit.conforms(other.unit):
            raise UnitError(f"{other.unit.text!r} does not conform to {self.unit.text!r}")
        return other.value * (other.unit.scale / self.unit.scale)

    def get_value(self, to: str = "") -> Any:
        """In another unit (or its own)."""
        return self.value if not to else self.get(to).value

    def get(self, to: str = "") -> Quantity:
        """Converted; without a unit to SI."""
        target = unit(to) if to else Unit(si_text(self.unit.dims), 1.0, self.unit.dims)
        if not self.unit.conforms(target):
            raise UnitError(f"{self.unit.text!r} does not conform to {to!r}")
        return Quantity(self.value * (self.unit.scale / target.scale), target)

    convert = get

    def canonical(self) -> Quantity:
        return self.get()

    def conforms(self, other: Quantity) -> bool:
        return self.unit.conforms(other.unit)

    def __add__(self, other: Any) -> Quantity:
        return Quantity(self.value + self._same(quantity(other)), self.unit)

    def __sub__(self, other: Any) -> Quantity:
        return Quantity(self.value - self._same(quantity(other)), self.unit)

    def __neg__(self) -> Quantity:
        return Quantity(-self.value, self.unit)

    def __mul__(self, other: Any) -> Quantity:
        o = quantity(other)
        text = f"{self.unit.text}.{o.unit.text}" if self.unit.text and o.unit.text else self.unit.text or o.unit.text
        return Quantity(self.value * o.value, Unit(text, self.unit.scale * o.unit.scale, tuple(a + b for a, b in zip(self.unit.dims, o.unit.dims, strict=True))))

    def __truediv__(self, other: Any) -> Quantity:
        o = quantity(other)
        text = f"{self.unit.text}/({o.unit.text})" if o.unit.text else self.unit.text
        return Quantity(self.value / o.value, Unit(text, self.unit.scale / o.unit.scale, tuple(a - b for a, b in zip(self.unit.dims, o.unit.dims, strict=True))))

    def __pow__(self, n: int) -> Quantity:
        text = f"({self.unit.text}){n}" if self.unit.text else ""
        value = F.pow(self.value, F.lit(n)) if isinstance(self.value, Column) else self.value**n
        return Quantity(value, Unit(text, self.unit.scale**n, tuple(d * n for d in self.unit.dims)))

    def root(self, n: int) -> Quantity:
        """The n-th root, in SI."""
        if any(d % n for d in self.unit.dims):
            raise UnitError(f"{self.unit.text!r} has no root of order {n}")
        dims = tuple(d // n for d in self.unit.dims)
        si = self.value * self.unit.scale
        value = F.pow(si, F.lit(1 / n)) if isinstance(si, Column) else si ** (1 / n)
        return Quantity(value, Unit(si_text(dims), 1.0, dims))

    def sqrt(self) -> Quantity:
        return self.root(2)

    def _own(self, name: str) -> Quantity:
        if isinstance(self.value, Column):
            return Quantity(getattr(F, name)(self.value), self.unit)
        return Quantity(abs(self.value) if name == "abs" else float(getattr(math, name)(self.value)), self.unit)

    def abs(self) -> Quantity:
        return self._own("abs")

    def ceil(self) -> Quantity:
        return self._own("ceil")

    def floor(self) -> Quantity:
        return self._own("floor")

    def _plain(self, name: str, angle: bool) -> Quantity:
        if not (self.unit.plain or angle and self.unit.is_angle):
            raise UnitError(f"{name} needs {'an angle or ' if angle else ''}a plain number, not {self.unit.text!r}")
        x = self.value * self.unit.scale
        return Quantity(getattr(F if isinstance(x, Column) else math, name)(x), unit(""))

    def sin(self) -> Quantity:
        return self._plain("sin", True)

    def cos(self) -> Quantity:
        return self._plain("cos", True)

    def tan(self) -> Quantity:
        return self._plain("tan", True)

    def exp(self) -> Quantity:
        return self._plain("exp", False)

    def log(self) -> Quantity:
        return self._plain("log", False)

    def log10(self) -> Quantity:
        return self._plain("log10", False)

    def _angle(self, name: str) -> Quantity:
        return Quantity(self._plain(name, False).value, unit("rad"))

    def asin(self) -> Quantity:
        return self._angle("asin")

    def acos(self) -> Quantity:
        return self._angle("acos")

    def atan(self) -> Quantity:
        return self._angle("atan")

    def atan2(self, other: Quantity) -> Quantity:
        y, x = self.value * self.unit.scale, other.value * other.unit.scale
        return Quantity((F.atan2(y, x) if isinstance(y, Column) else math.atan2(y, x)), unit("rad"))

    def near(self, other: Any, tolerance: float = 1e-13) -> Any:
        """Whether they differ by at most the share ``tolerance`` of the larger."""
        a, b = self.value, self._same(quantity(other))
        if isinstance(a, Column) or isinstance(b, Column):
            return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
        return abs(a - b) <= tolerance * max(abs(a), abs(b))

    def nearabs(self, other: Any, tolerance: float = 1e-13) -> Any:
        a, b = self.value, self._same(quantity(other))
        return (F.abs(a - b) if isinstance(a, Column) or isinstance(b, Column) else abs(a - b)) <= tolerance

    def equals(self, other: Any) -> Any:
        o = quantity(other)
        return self.unit.conforms(o.unit) and self.value == self._same(o)

    def __str__(self) -> str:
        return f"{general(self.value, 5)} {self.unit.text}"

    def formatted(self) -> str:
        """Angles as +DDD.MM.SS, times as HH:MM:SS, others with six digits."""
        if self.unit.is_time:
            total = round(self.get_value("s") % 86400)
            return f"{total // 3600:02d}:{total // 60 % 60:02d}:{total % 60:02d}"
        if self.unit.is_angle:
            total = round(abs(self.get_value("deg")) * 3600)
            return f"{'-' if self.value < 0 else '+'}{total // 3600:03d}.{total // 60 % 60:02d}.{total % 60:02d}"
        return f"{general(self.value, 6)} {self.unit.text}"

    __repr__ = formatted

    def formatted_column(self) -> Column:
        """The same of a column."""
        if self.unit.is_time:
            total = F.pmod(F.round(self.get_value("s")), F.lit(86400.0)).cast("bigint")
            return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60)
        if self.unit.is_angle:
            total = F.round(F.abs(self.get_value("deg")) * 3600).cast("bigint")
            sign = F.when(self.value < 0, "-").otherwise("+")
            return F.concat(sign, F.format_string("%03d.%02d.%02d", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60))
        return F.concat(F.format_string("%.6g", self.value), F.lit(f" {self.unit.text}"))

    def to_unix_time(self) -> Any:
        """Seconds since 1970 of a modified Julian date."""
        return (self.get_value("d") - 40587.0) * 86400.0

    def to_dict(self) -> dict[str, Any]:
        return {"value": self.value, "unit": self.unit.text}


def from_dict(d: dict[str, Any]) -> Quantity:
    return Quantity(d["value"], unit(d["unit"]))


_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(.*)$")
_DATE = re.compile(r"\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T/ ](\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?\s*$")


def quantity(value: Any, text: str | None = None) -> Quantity:
    """A quantity from a number or column and a unit, from text such as ``1.5 Jy``, or from a date (as MJD days)."""
    if isinstance(value, Quantity):
        return value
    if text is not None:
        return Quantity(value if isinstance(value, Column) else float(value), unit(text))
    if isinstance(value, str):
        if m := _DATE.match(value):
            import datetime

            day = datetime.date(int(m[1]), int(m[2]), int(m[3])).toordinal() - datetime.date(1858, 11, 17).toordinal()
            return Quantity(day + (int(m[4] or 0) * 3600 + int(m[5] or 0) * 60 + float(m[6] or 0)) / 86400, unit("d"))
        if m := _NUMBER.match(value):
            return Quantity(float(m[1]), unit(m[2]))
        raise UnitError(f"can't read {value!r}")
    return Quantity(value, unit(""))


__all__ = ["Quantity", "Unit", "UnitError", "quantity", "sexagesimal", "unit"]
