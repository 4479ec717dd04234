"""Complex numbers, as structs of two reals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ARR, CPLX, FLOAT, Val
from . import register
from .coerce import real


def parts(v: Val) -> tuple[Column, Column]:
    """Real and imaginary part; a pair in an array counts as a complex number, a number as (x, 0)."""
    if v.kind == CPLX:
        return v.col["re"].cast("double"), v.col["im"].cast("double")
    if v.kind == ARR:
        return F.coalesce(F.get(v.col, 0).cast("double"), F.lit(0.0)), F.coalesce(F.get(v.col, 1).cast("double"), F.lit(0.0))
    return real(v), F.lit(0.0)


def made(re: Column, im: Column) -> Val:
    return Val(F.struct(re.alias("re"), im.alias("im")), CPLX)


register("REAL", least=1, most=1)(lambda a, s: Val(parts(a[0])[0], FLOAT))
register("IMAG", least=1, most=1)(lambda a, s: Val(parts(a[0])[1], FLOAT))
register("AMPL", "AMPLITUDE", least=1, most=1)(lambda a, s: Val(F.hypot(*parts(a[0])), FLOAT))
register("ARG", "PHASE", least=1, most=1)(lambda a, s: Val(F.atan2(parts(a[0])[1], parts(a[0])[0]), FLOAT))
register("CONJ", least=1, most=1)(lambda a, s: made(parts(a[0])[0], -parts(a[0])[1]))
register("COMPLEX", "FORMCOMPLEX", least=2, most=2)(lambda a, s: made(real(a[0]), real(a[1])))
