"""Slices of array cells."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import TaqlError


def flat_indices(shape: list[int], blc: list[int], trc: list[int], inc: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Row-major places of the cells from blc to trc (both included) in steps of inc, and the slice's shape."""
    steps = inc or [1] * len(shape)
    if not len(shape) == len(blc) == len(trc) == len(steps):
        raise TaqlError("a slice needs a value for each axis")
    for n, b, t, s in zip(shape, blc, trc, steps, strict=True):
        if not (0 <= b <= t < n) or s < 1:
            raise TaqlError(f"slice {b}..{t} step {s} is outside an axis of {n}")
    strides = [1] * len(shape)
    for i in range(len(shape) - 2, -1, -1):
        strides[i] = strides[i + 1] * shape[i + 1]
    axes = [range(b, t + 1, s) for b, t, s in zip(blc, trc, steps, strict=True)]
    return [sum(i * s for i, s in zip(p, strides, strict=True)) for p in product(*axes)], [len(a) for a in axes]


def take(data: Column, places: list[int]) -> Column:
    """The elements at fixed places, inside the JVM."""
    return F.transform(F.array(*[F.lit(p) for p in places]), lambda i: F.get(data, i))


def overlay(data: Column, places: list[int], values: Column) -> Column:
    """The array with the elements at fixed places replaced."""
    at = F.map_from_arrays(F.array(*[F.lit(p) for p in places]), values)
    return F.transform(data, lambda x, i: F.coalesce(F.try_element_at(at, i), x))


def take_shaped(cell: Column, blc: list[int], trc: list[int], inc: list[int] | None = None) -> Column:
    """A slice of a cell of any shape (struct of shape and data): strides come from its own shape."""
    steps = inc or [1] * len(blc)
    shape, data = cell["shape"], cell["data"]
    n = len(blc)
    strides = [F.lit(1)] * n
    for i in range(n - 2, -1, -1):
        strides[i] = strides[i + 1] * F.get(shape, i + 1)
    fits = F.size(shape) == n
    for i in range(n):
        fits = fits & (F.lit(0) <= blc[i]) & (F.get(shape, i) > trc[i])
    places = F.array(F.lit(0))
    for i in range(n):
        axis = F.array(*[F.lit(p) for p in range(blc[i], trc[i] + 1, steps[i])])
        stride = strides[i]
        places = F.flatten(F.transform(places, lambda p, a=axis, s=stride: F.transform(a, lambda x: p + x * s)))
    out = F.struct(
        F.array(*[F.lit(len(range(blc[i], trc[i] + 1, steps[i]))) for i in range(n)]).alias("shape"),
        F.transform(places, lambda p: F.get(data, p)).alias("data"),
    )
    return F.when(fits, out).otherwise(F.raise_error(F.lit("a slice is outside its cell")))
