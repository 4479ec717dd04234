"""Quantities, measures and images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from taqlspark.operators import images, measures
from taqlspark.operators.quanta import UnitError, from_dict, quantity, unit
from taqlspark.sources.fits import read_fits, write_fits
from taqlspark.types import TaqlError

MEERKAT = (5109360.133, 2006852.586, -3238948.127)


def test_units():
    assert str(quantity("1.5 Jy").get()) == "1.5e-26 kg.s-2"
    assert quantity("45deg").formatted() == "+045.00.00"
    assert quantity("-1.5deg").formatted() == "-001.30.00"
    assert quantity("2h").formatted() == "02:00:00"
    assert unit("cd").dims == (0, 0, 0, 0, 0, 0, 1, 0)
    assert (quantity("1 km") / quantity("2 m")).unit.text == "km/(m)"
    assert (quantity("1 km") + quantity("5 m")).value == 1.005
    assert quantity("9 m2").sqrt().value == 3 and quantity("9 m2").sqrt().unit.text == "m"
    assert quantity("2000-01-01 12:00:00").value == 51544.5
    assert quantity("51544.5 d").to_unix_time() == 946728000.0
    assert quantity("90 deg").sin().value == pytest.approx(1)
    assert quantity("1 km").near("1000 m") and from_dict({"value": 2, "unit": "s"}).value == 2
    assert unit("km.m/s2").scale == 1000 and unit("m/(km)").scale == 1e-3
    for bad in ("1 m + s", "1 furlong"):
        with pytest.raises(UnitError):
            quantity(bad)
    with pytest.raises(UnitError):
        quantity("1 m") + quantity("1 s")
    with pytest.raises(UnitError):
        quantity("1 m").exp()


def test_column_quantities(spark):
    df = spark.createDataFrame([(90.0,), (-1.5,)], "a double")
    q = quantity(F.col("a"), "deg")
    assert [round(r[0], 9) for r in df.select(q.get_value("rad")).collect()] == [round(math.pi / 2, 9), round(-1.5 * math.pi / 180, 9)]
    assert [r[0] for r in df.select(q.formatted_column()).collect()] == ["+090.00.00", "-001.30.00"]


def test_epochs_and_positions(spark):
    df = spark.createDataFrame([(59444.5,), (57753.0,), (41316.0,)], "m double")
    got = df.select((measures.convert_epoch(F.col("m"), "UTC", "TAI") - F.col("m")) * 86400).collect()
    assert [round(r[0]) for r in got] == [37, 36, 0]
    back = df.select(measures.convert_epoch(measures.convert_epoch(F.col("m"), "UTC", "TDT"), "TT", "UTC") - F.col("m")).collect()
    assert max(abs(r[0]) for r in back) < 1e-9
    x, y, z = (F.lit(v) for v in MEERKAT)
    lon, lat, h = measures.itrf_to_wgs84(x, y, z)
    again = df.limit(1).select(*measures.wgs84_to_itrf(lon, lat, h)).first()
    assert np.allclose(again, MEERKAT, atol=1e-5)
    pa = df.limit(1).select(measures.position_angle(F.lit(0.0), F.lit(0.0), F.lit(0.1), F.lit(0.0))).first()[0]
    assert pa == pytest.approx(math.pi / 2)


def test_horizon(spark):
    """A published case, within an arcsecond."""
    x, y, z = (F.lit(v) for v in MEERKAT)
    site = tuple(spark.range(1).select(*measures.itrf_to_wgs84(x, y, z)).first())
    row = spark.createDataFrame([(0.5, -0.5, 57844.5)], "a double, b double, m double")
    az, alt = row.select(measures.to_horizon(F.col("a"), F.col("b"), F.col("m"), site, 0.48).alias("h")).select("h.*").first()
    off = math.hypot((math.degrees(az) + 47.701503) * math.cos(alt), math.degrees(alt) - 86.855931)
    assert off * 3600 < 1
    b = measures.horizon(np.array([az]), np.array([alt]), np.array([57844.5]), site, 0.48, back=True)
    assert np.allclose([b[0][0], b[1][0]], [0.5, -0.5], atol=1e-9)


def cube(spark):
    axes = (images.Axis("RA", 1.75, -2.5e-5, 5), images.Axis("DEC", -0.45, 3e-5, 4), images.Axis("Stokes", 1, 1, 1), images.Axis("Frequency", 1.4e9, 2e6, 1, "Hz"))
    image = images.from_array(spark, np.arange(480).reshape(3, 2, 8, 10), images.Coordinates(axes, (0, 1)), "Jy/beam")
    image.info = {"restoringbeam": {"major": {"value": 12.6, "unit": "arcsec"}, "minor": {"value": 9.0, "unit": "arcsec"}, "positionangle": {"value": 15.0, "unit": "deg"}}}
    return image


def test_world_coordinates(spark):
    im = cube(spark)
    assert im.toworld([1, 1, 4, 5]) == pytest.approx([1.4e9, 1, -0.45, 1.75])
    w = im.toworld([2, 0, 7, 1])
    assert im.topixel(w) == pytest.approx([2, 0, 7, 1])
    with pytest.raises(TaqlError):
        im.topixel([1.4e9, 1, 0.45, 1.75 + math.pi])
    with pytest.raises(TaqlError):
        im.toworld([1, 2])
    assert images.new_image(spark, (2, 3)).getdata().tolist() == [[0] * 3] * 2


def test_regrid(spark):
    im = cube(spark)
    assert np.allclose(images.regrid(im, [2, 3], im.coordinates, im.shape).getdata(), im.getdata(), atol=1e-3)
    shifted = im.coordinates.with_axis(0, crpix=5.5)
    out = images.regrid(im, [2, 3], shifted, im.shape).getdata()
    src = im.getdata()
    assert np.allclose(out[..., 1:], (src[..., :-1] + src[..., 1:]) / 2, atol=1e-2)
    smaller = images.regrid(im, [3], im.coordinates, (3, 2, 8, 4)).getdata()
    assert np.allclose(smaller, src[..., :4], atol=1e-3)
    far = im.coordinates.with_axis(0, crpix=500.0)
    assert not images.regrid(im, [2, 3], far, im.shape).getdata().any()
    with pytest.raises(TaqlError):
        images.regrid(im, [9], im.coordinates, im.shape)


def test_fits_and_parquet(spark, tmp_path):
    im = cube(spark)
    write_fits(im, f"{tmp_path}/c.fits")
    back = read_fits(spark, f"{tmp_path}/c.fits")
    assert back.shape == im.shape and np.array_equal(back.getdata(), im.getdata())
    assert back.toworld([2, 1, 3, 3]) == pytest.approx(im.toworld([2, 1, 3, 3]))
    assert back.unit == "Jy/beam" and back.info["restoringbeam"]["major"]["value"] == pytest.approx(12.6)
    im.save(f"{tmp_path}/c")
    assert np.array_equal(images.open_image(spark, f"{tmp_path}/c").getdata(), im.getdata())
    data = (tmp_path / "c.fits").read_bytes()
    (tmp_path / "short.fits").write_bytes(data[:3000])
    with pytest.raises(TaqlError):
        read_fits(spark, f"{tmp_path}/short.fits")
