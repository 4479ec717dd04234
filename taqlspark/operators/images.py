"""Images: pixels as rows, world coordinates as column expressions, and regridding as a join.

An image has a shape (slowest axis first), a frame of pixels (``pix`` long: the flat row-major place;
``value`` float) and coordinates. Pixels that are zero may be left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from itertools import product
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import TaqlError


@dataclass(frozen=True)
class Axis:
    """A linear axis, or one of the two of a direction. crpix counts from 0."""

    name: str
    crval: float
    cdelt: float
    crpix: float
    unit: str = ""


@dataclass(frozen=True)
class Coordinates:
    """Axes, fastest first. direction: places of longitude and latitude, in radians (SIN projection), or None; pc mixes them."""

    axes: tuple[Axis, ...]
    direction: tuple[int, int] | None = None
    pc: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 1.0)

    def to_world(self, pixel: list[Any]) -> list[Any]:
        """Pixel to world, of numbers or columns; null (of numbers an error) off the projection."""
        self._check(pixel)
        out = [a.crval + (p - a.crpix) * a.cdelt for a, p in zip(self.axes, pixel, strict=True)]
        if self.direction is None:
            return out
        i, j = self.direction
        x, y = ((pixel[k] - self.axes[k].crpix) * self.axes[k].cdelt for k in (i, j))
        p = self.pc
        x, y = p[0] * x + p[1] * y, p[2] * x + p[3] * y
        lon0, lat0 = self.axes[i].crval, self.axes[j].crval
        c = _functions(x)
        rest = 1 - x * x - y * y
        if not isinstance(rest, Column) and rest < 0:
            raise TaqlError("the pixel is off the projection")
        z = c.sqrt(F.when(rest < 0, None).otherwise(rest) if isinstance(rest, Column) else rest)
        s = z * math.sin(lat0) + y * math.cos(lat0)
        out[j] = c.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)) if isinstance(s, Column) else max(-1.0, min(1.0, s)))
        out[i] = lon0 + c.atan2(x, z * math.cos(lat0) - y * math.sin(lat0))
        return out

    def to_pixel(self, world: list[Any]) -> list[Any]:
        """The inverse; the far side of the sphere has no pixel."""
        self._check(world)
        out = [a.crpix + (w - a.crval) / a.cdelt for a, w in zip(self.axes, world, strict=True)]
        if self.direction is None:
            return out
        i, j = self.direction
        lon0, lat0 = self.axes[i].crval, self.axes[j].crval
        d, lat = world[i] - lon0, world[j]
        c = _functions(lat)
        x = c.cos(lat) * c.sin(d)
        y = c.sin(lat) * math.cos(lat0) - c.cos(lat) * math.sin(lat0) * c.cos(d)
        front = c.sin(lat) * math.sin(lat0) + c.cos(lat) * math.cos(lat0) * c.cos(d)
        if isinstance(front, Column):
            x, y = F.when(front < 0, None).otherwise(x), F.when(front < 0, None).otherwise(y)
        elif front < 0:
            raise TaqlError("the direction is off the projection")
        p = self.pc
        det = p[0] * p[3] - p[1] * p[2]
        x, y = (p[3] * x - p[1] * y) / det, (p[0] * y - p[2] * x) / det
        out[i] = self.axes[i].crpix + x / self.axes[i].cdelt
        out[j] = self.axes[j].crpix + y / self.axes[j].cdelt
        return out

    def _check(self, values: list[Any]) -> None:
        if len(values) != len(self.axes):
            raise TaqlError(f"{len(values)} values for {len(self.axes)} axes")

    def with_axis(self, k: int, **changes: Any) -> Coordinates:
        axes = list(self.axes)
        axes[k] = replace(axes[k], **changes)
        return replace(self, axes=tuple(axes))

    # in the order of the shape, slowest first
    def referencevalue(self) -> list[float]:
        return [a.crval for a in self.axes[::-1]]

    def referencepixel(self) -> list[float]:
        return [a.crpix for a in self.axes[::-1]]

    def increment(self) -> list[float]:
        return [a.cdelt for a in self.axes[::-1]]

    def dict(self) -> dict[str, Any]:
        return {"axes": [vars(a).copy() for a in self.axes], "direction": self.direction, "pc": list(self.pc)}


class _Math:
    sqrt, asin, atan2, sin, cos = staticmethod(math.sqrt), staticmethod(math.asin), staticmethod(math.atan2), staticmethod(math.sin), staticmethod(math.cos)


class _Columns:
    sqrt, asin, atan2, sin, cos = staticmethod(F.sqrt), staticmethod(F.asin), staticmethod(F.atan2), staticmethod(F.sin), staticmethod(F.cos)


def _functions(x: Any) -> Any:
    return _Columns if isinstance(x, Column) else _Math


def default_coordinates(ndim: int) -> Coordinates:
    """By rank: spectral alone; direction; direction and spectral; direction, polarisation and spectral; then plain axes."""
    lon, lat = Axis("Right Ascension", 0.0, -math.pi / 10800, 0.0, "rad"), Axis("Declination", 0.0, math.pi / 10800, 0.0, "rad")
    stokes, spectral = Axis("Stokes", 1.0, 1.0, 0.0), Axis("Frequency", 1.415e9, 1000.0, 0.0, "Hz")
    if ndim == 1:
        return Coordinates((spectral,))
    axes = [lon, lat, *([stokes, spectral] if ndim >= 4 else [spectral])][:ndim]
    axes += [Axis(f"linear{k}", 0.0, 1.0, 0.0) for k in range(len(axes), ndim)]
    return Coordinates(tuple(axes), (0, 1))


@dataclass
class Image:
    """Pixels, shape, coordinates, and records about them."""

    pixels: DataFrame
    shape: tuple[int, ...]
    coordinates: Coordinates
    unit: str = ""
    info: dict[str, Any] = field(default_factory=dict)
    misc: dict[str, Any] = field(default_factory=dict)

    def getdata(self) -> np.ndarray:
        """All pixels on the driver."""
        out = np.zeros(int(np.prod(self.shape)), np.float32)
        rows = self.pixels.select("pix", "value").toArrow()
        out[rows["pix"].to_numpy()] = rows["value"].to_numpy()
        return out.reshape(self.shape)

    def toworld(self, pixel: list[float]) -> list[float]:
        """Pixel and world values go slowest axis first."""
        return self.coordinates.to_world([float(p) for p in pixel][::-1])[::-1]

    def topixel(self, world: list[float]) -> list[float]:
        return self.coordinates.to_pixel([float(w) for w in world][::-1])[::-1]

    def save(self, path: str) -> None:
        """A Parquet table of pixels; the coordinates are in its first column's metadata."""
        meta = {"shape": list(self.shape), "coordinates": self.coordinates.dict(), "unit": self.unit, "info": self.info, "misc": self.misc}
        self.pixels.select("pix", F.col("value").cast("float").alias("value")).withMetadata("pix", meta).write.mode("overwrite").parquet(path)


def open_image(spark: SparkSession, path: str) -> Image:
    df = spark.read.parquet(path)
    meta = df.schema["pix"].metadata
    c = meta["coordinates"]
    coords = Coordinates(tuple(Axis(**a) for a in c["axes"]), tuple(c["direction"]) if c.get("direction") else None, tuple(c["pc"]))  # type: ignore[arg-type]
    return Image(df, tuple(meta["shape"]), coords, meta.get("unit", ""), meta.get("info", {}), meta.get("misc", {}))


def from_array(spark: SparkSession, data: np.ndarray, coordinates: Coordinates | None = None, unit: str = "") -> Image:
    a = np.asarray(data, np.float32)
    rows = spark.createDataFrame(list(enumerate(map(float, a.ravel()))), "pix long, value float")
    return Image(rows, a.shape, coordinates or default_coordinates(a.ndim), unit)


def new_image(spark: SparkSession, shape: tuple[int, ...], coordinates: Coordinates | None = None) -> Image:
    """All zero."""
    return Image(spark.createDataFrame([], "pix long, value float"), tuple(shape), coordinates or default_coordinates(len(shape)))


def regrid(source: Image, axes: list[int], target: Coordinates, shape: tuple[int, ...]) -> Image:
    """Sample an image on another grid: linear over ``axes``, nearest on the others, zero outside.

    Each output pixel's place in the source is a column expression, so the grid is made in parallel from a
    range. Its 2^k corners are rows that meet the source's pixels in an equi-join, and their weighted
    values are summed by output pixel. Half a pixel beyond the edge still counts as inside.
    """
    n = len(source.shape)
    if len(shape) != n:
        raise TaqlError(f"the output needs {n} axes")
    if any(not 0 <= a < n for a in axes):
        raise TaqlError("no such axis")
    own = sorted(set(axes))
    spark = source.pixels.sparkSession
    strides = [int(np.prod(shape[k + 1 :])) for k in range(n)]
    from_strides = [int(np.prod(source.shape[k + 1 :])) for k in range(n)]
    grid = spark.range(int(np.prod(shape))).withColumnRenamed("id", "out")
    index = [(F.floor(F.col("out") / strides[k]) % shape[k]).cast("double") for k in range(n)]
    world = target.to_world(index[::-1])
    place = source.coordinates.to_pixel(world)[::-1]
    grid = grid.select("out", *[p.alias(f"p{k}") for k, p in enumerate(place)])

    inside, low, share = F.lit(True), {}, {}
    for k in range(n):
        p, last = F.col(f"p{k}"), source.shape[k] - 1
        inside = inside & p.isNotNull()
        if k in own:
            inside = inside & (p >= -0.5) & (p <= last + 0.5)
            low[k] = F.greatest(F.lit(0), F.least(F.lit(last), F.floor(p)))
            share[k] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p - low[k]))
        else:
            low[k] = F.when(p >= 0, F.floor(p + 0.5)).otherwise(F.ceil(p - 0.5))
            inside = inside & (low[k] >= 0) & (low[k] <= last)
    corners = []
    for picks in product((0, 1), repeat=len(own)):
        pick, weight, flat = dict(zip(own, picks, strict=True)), F.lit(1.0), F.lit(0)
        for k in range(n):
            at = low[k]
            if k in own:
                weight = weight * (share[k] if pick[k] else 1 - share[k])
                if pick[k]:
                    at = F.least(at + 1, F.lit(source.shape[k] - 1))
            flat = flat + at * from_strides[k]
        corners.append(F.struct(flat.cast("bigint").alias("pix"), weight.alias("w")))
    rows = grid.where(inside).select("out", F.explode(F.array(*corners)).alias("c")).where("c.w <> 0").select("out", "c.pix", "c.w")
    values = source.pixels.select("pix", F.col("value").cast("double").alias("v"))
    summed = rows.join(values, "pix").groupBy("out").agg(F.sum(F.col("w") * F.col("v")).cast("float").alias("value"))
    return Image(summed.select(F.col("out").alias("pix"), "value"), tuple(shape), target, source.unit, source.info, source.misc)
