"""Epochs, positions and directions, and conversions between their frames.

Simple conversions are column expressions. J2000 to the horizon needs precession, nutation, aberration
and sidereal time; it is computed with NumPy over Arrow batches. Precession is that of IAU 2006, nutation
keeps the largest terms (under 0.05 arcseconds are left out), the Earth's velocity comes from its mean
elements (0.02 arcseconds). UT1-UTC is an argument, 0 if it isn't given.
"""

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import TaqlError

#: First day (year, month) of each TAI-UTC from 10 s on, one second more each. Fixed values.
LEAP_SECONDS = (
    (1972, 1), (1972, 7), (1973, 1), (1974, 1), (1975, 1), (1976, 1), (1977, 1), (1978, 1), (1979, 1), (1980, 1), (1981, 7), (1982, 7), (1983, 7), (1985, 7),
    (1988, 1), (1990, 1), (1991, 1), (1992, 7), (1993, 7), (1994, 7), (1996, 1), (1997, 7), (1999, 1), (2006, 1), (2009, 1), (2012, 7), (2015, 7), (2017, 1),
)
_MONTH = {1: 0, 7: 181}
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
_AS = math.pi / 180 / 3600

EPOCHS = ("UTC", "TAI", "TDT", "TT", "UT1", "UT2", "UT")


def _leap_mjd(year: int, month: int) -> float:
    import datetime

    return float(datetime.date(year, month, 1).toordinal() - datetime.date(1858, 11, 17).toordinal())


_LEAPS = [(_leap_mjd(y, m), 10 + i) for i, (y, m) in enumerate(LEAP_SECONDS)]


def tai_minus_utc(mjd: np.ndarray) -> np.ndarray:
    """Seconds by UTC day; 0 before 1972."""
    days = np.array([d for d, _ in _LEAPS])
    at = np.searchsorted(days, np.asarray(mjd, float), side="right")
    return np.where(at == 0, 0, 9 + at).astype(float)


def tai_minus_utc_column(mjd: Column) -> Column:
    """The same as one expression: the number of table days that have come."""
    n = F.size(F.filter(F.array(*[F.lit(d) for d, _ in _LEAPS]), lambda d: d <= mjd))
    return F.when(n == 0, 0.0).otherwise((n + 9).cast("double"))


def convert_epoch(mjd: Column, of: str, to: str, dut1: Column | float = 0.0) -> Column:
    """MJD in days from one time scale to another. dut1: UT1-UTC in seconds."""
    of, to = of.upper(), to.upper()
    for name in (of, to):
        if name not in EPOCHS:
            raise TaqlError(f"no conversion for epochs in {name}")
    d = F.lit(dut1) if isinstance(dut1, (int, float)) else dut1
    same = {"TT": "TDT", "UT": "UT1", "UT2": "UT1"}

    def utc() -> Column:
        scale = same.get(of, of)
        if scale == "UTC":
            return mjd
        if scale == "UT1":
            return mjd - d / 86400.0
        tai = mjd if scale == "TAI" else mjd - 32.184 / 86400.0
        guess = tai - tai_minus_utc_column(tai) / 86400.0
        return tai - tai_minus_utc_column(guess) / 86400.0

    u, scale = utc(), same.get(to, to)
    if scale == "UTC":
        return u
    if scale == "UT1":
        return u + d / 86400.0
    tai = u + tai_minus_utc_column(u) / 86400.0
    return tai if scale == "TAI" else tai + 32.184 / 86400.0


def itrf_to_wgs84(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, geodetic latitude (radians) and height (metres) of geocentric metres, by an iteration that closes within micrometres."""
    p = F.hypot(x, y)
    lat = F.atan2(z, p * (1 - E2))
    for _ in range(6):
        s = F.sin(lat)
        n = A / F.sqrt(1 - E2 * s * s)
        lat = F.atan2(z + E2 * n * s, p)
    s = F.sin(lat)
    n = A / F.sqrt(1 - E2 * s * s)
    height = p * F.cos(lat) + (z + E2 * n * s) * s - n
    return F.atan2(y, x), lat, height


def wgs84_to_itrf(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    r = (n + height) * F.cos(lat)
    return r * F.cos(lon), r * F.sin(lon), (n * (1 - E2) + height) * F.sin(lat)


def position(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, geocentric latitude and distance."""
    return F.atan2(y, x), F.atan2(z, F.hypot(x, y)), F.sqrt(x * x + y * y + z * z)


def position_angle(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Angle at the first direction from north through east to the second, along the great circle."""
    d = lon1 - lon0
    return F.atan2(F.cos(lat1) * F.sin(d), F.cos(lat0) * F.sin(lat1) - F.sin(lat0) * F.cos(lat1) * F.cos(d))


def separation(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    d = lon1 - lon0
    y = F.hypot(F.cos(lat1) * F.sin(d), F.cos(lat0) * F.sin(lat1) - F.sin(lat0) * F.cos(lat1) * F.cos(d))
    return F.atan2(y, F.sin(lat0) * F.sin(lat1) + F.cos(lat0) * F.cos(lat1) * F.cos(d))


# The horizon model, on arrays.
#: Largest terms of nutation: multiples of (l, l', F, D, Omega), longitude and obliquity in 0.1 mas. Fixed values.
_NUTATION = np.array([
    [0, 0, 0, 0, 1, -172064.161, 92052.331], [0, 0, 2, -2, 2, -13170.906, 5730.336], [0, 0, 2, 0, 2, -2276.413, 978.459], [0, 0, 0, 0, 2, 2074.554, -897.492],
    [0, 1, 0, 0, 0, 1475.877, 73.871], [0, 1, 2, -2, 2, -516.821, 224.386], [1, 0, 0, 0, 0, 711.159, -6.750], [0, 0, 2, 0, 1, -387.298, 200.728],
    [1, 0, 2, 0, 2, -301.461, 129.025], [0, -1, 2, -2, 2, 215.829, -95.929], [0, 0, 2, -2, 1, 128.227, -68.982], [-1, 0, 2, 0, 2, 123.457, -53.311],
    [-1, 0, 0, 2, 0, 156.994, -1.235], [1, 0, 0, 0, 1, 63.110, -33.228], [-1, 0, 0, 0, 1, -57.976, 31.429], [-1, 0, 2, 2, 2, -59.641, 25.543],
])


def _rx(a: np.ndarray) -> np.ndarray:
    c, s, o, i = np.cos(a), np.sin(a), np.zeros_like(a), np.ones_like(a)
    return np.stack([np.stack([i, o, o], -1), np.stack([o, c, s], -1), np.stack([o, -s, c], -1)], -2)


def _rz(a: np.ndarray) -> np.ndarray:
    c, s, o, i = np.cos(a), np.sin(a), np.zeros_like(a), np.ones_like(a)
    return np.stack([np.stack([c, s, o], -1), np.stack([-s, c, o], -1), np.stack([o, o, i], -1)], -2)


def _poly(t: np.ndarray, *c: float) -> np.ndarray:
    return sum(k * t**i for i, k in enumerate(c))  # type: ignore[return-value]


def nutation(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In longitude and obliquity (radians), t in Julian centuries of TT since 2000."""
    args = np.stack([
        _poly(t, 485868.249036, 1717915923.2178, 31.8792), _poly(t, 1287104.793048, 129596581.0481, -0.5532), _poly(t, 335779.526232, 1739527262.8478, -12.7512),
        _poly(t, 1072260.703692, 1602961601.2090, -6.3706), _poly(t, 450160.398036, -6962890.5431, 7.4722),
    ], -1) * _AS
    phase = args @ _NUTATION[:, :5].T
    return np.sin(phase) @ _NUTATION[:, 5] * 1e-4 * _AS, np.cos(phase) @ _NUTATION[:, 6] * 1e-4 * _AS


def obliquity(t: np.ndarray) -> np.ndarray:
    return _poly(t, 84381.406, -46.836769, -0.0001831, 0.00200340) * _AS


def to_date(t: np.ndarray) -> np.ndarray:
    """Matrices from J2000 (GCRS, with the frame bias) to the true equator and equinox of date."""
    gamma = _poly(t, -0.052928, 10.556378, 0.4932044, -0.00031238) * _AS
    phi = _poly(t, 84381.412819, -46.811016, 0.0511268, 0.00053289) * _AS
    psi = _poly(t, -0.041775, 5038.481484, 1.5584175, -0.00018522) * _AS
    dpsi, deps = nutation(t)
    return _rx(-(obliquity(t) + deps)) @ _rz(-(psi + dpsi)) @ _rx(phi) @ _rz(gamma)


def earth_velocity(t: np.ndarray) -> np.ndarray:
    """In units of light's, along J2000 axes: from the sun's longitude, with the orbit's eccentricity."""
    rad = math.pi / 180
    mean, anomaly = _poly(t, 280.46646, 36000.76983, 0.0003032) * rad, _poly(t, 357.52911, 35999.05029, -0.0001537) * rad
    sun = mean + (_poly(t, 1.914602, -0.004817) * np.sin(anomaly) + 0.019993 * np.sin(2 * anomaly)) * rad - 1.396971 * rad * t
    ecc, perihelion = _poly(t, 0.016708634, -0.000042037), _poly(t, 102.93735, 1.71946) * rad - 1.396971 * rad * t
    k = 20.49552 * _AS
    vx, vy = k * (np.sin(sun) - ecc * np.sin(perihelion)), -k * (np.cos(sun) - ecc * np.cos(perihelion))
    eps = obliquity(np.zeros_like(t))
    return np.stack([vx, vy * np.cos(eps), vy * np.sin(eps)], -1)


def sidereal_time(ut1: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Greenwich mean sidereal time in radians."""
    days = ut1 - 51544.5
    era = 2 * math.pi * ((0.7790572732640 + 0.00273781191135448 * days + days % 1.0) % 1.0)
    return (era + _poly(t, 0.014506, 4612.156534, 1.3915817, -0.00000044) * _AS) % (2 * math.pi)


def horizon(lon: np.ndarray, lat: np.ndarray, mjd_utc: np.ndarray, site: tuple[float, float, float], dut1: float = 0.0, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """J2000 to azimuth (from north through east) and altitude, or back. site: longitude, geodetic latitude, height."""
    lon, lat, mjd = (np.asarray(x, float) for x in np.broadcast_arrays(lon, lat, mjd_utc))
    tt = mjd + (tai_minus_utc(mjd) + 32.184) / 86400
    t = (tt - 51544.5) / 36525
    ut1 = mjd + dut1 / 86400
    dpsi, deps = nutation(t)
    gast = sidereal_time(ut1, t) + dpsi * np.cos(obliquity(t) + deps)
    slon, slat, h = site
    n = A / math.sqrt(1 - E2 * math.sin(slat) ** 2)
    v = earth_velocity(t)
    local = gast + slon
    # the site's own motion, eastwards
    turn = 7.292115e-5 * (n + h) * math.cos(slat) / 299792458.0
    m = to_date(t)
    spin = turn * np.stack([-np.sin(local), np.cos(local), np.zeros_like(local)], -1)
    v = v + np.einsum("...ji,...j->...i", m, spin)
    unit = lambda a, b: np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], -1)
    if back:
        e, no, up = np.cos(lat) * np.sin(lon), np.cos(lat) * np.cos(lon), np.sin(lat)
        x, z = -math.sin(slat) * no + math.cos(slat) * up, math.cos(slat) * no + math.sin(slat) * up
        d = np.stack([x * np.cos(local) - e * np.sin(local), x * np.sin(local) + e * np.cos(local), z], -1)
        p = np.einsum("...ji,...j->...i", m, d)
        q = p - v
        for _ in range(3):  # take the aberration out
            q = p / _stretch(q, v)[..., None] - _shift(q, v)
            q /= np.linalg.norm(q, axis=-1, keepdims=True)
        return np.arctan2(q[..., 1], q[..., 0]), np.arcsin(np.clip(q[..., 2], -1, 1))
    p = unit(lon, lat)
    q = (p + _shift(p, v)) * _stretch(p, v)[..., None]
    q /= np.linalg.norm(q, axis=-1, keepdims=True)
    d = np.einsum("...ij,...j->...i", m, q)
    x = d[..., 0] * np.cos(local) + d[..., 1] * np.sin(local)
    e = -d[..., 0] * np.sin(local) + d[..., 1] * np.cos(local)
    no, up = -math.sin(slat) * x + math.cos(slat) * d[..., 2], math.cos(slat) * x + math.sin(slat) * d[..., 2]
    return np.arctan2(e, no), np.arcsin(np.clip(up, -1, 1))


def _shift(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """First and second order of aberration, to be added to a unit vector."""
    dot = (p * v).sum(-1, keepdims=True)
    return v * (1 - dot / 2)


def _stretch(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    return 1 / np.linalg.norm(p + _shift(p, v), axis=-1)


def to_horizon(lon: Column, lat: Column, mjd_utc: Column, site: tuple[float, float, float], dut1: float = 0.0, back: bool = False) -> Column:
    """struct<lon, lat> of ``horizon`` for columns, in Arrow batches."""

    @F.pandas_udf("lon double, lat double")
    def run(a: pd.Series, b: pd.Series, m: pd.Series) -> pd.DataFrame:
        x, y = horizon(a.to_numpy(), b.to_numpy(), m.to_numpy(), site, dut1, back)
        return pd.DataFrame({"lon": x, "lat": y})

    return run(lon, lat, mjd_utc)


__all__ = ["Callable", "convert_epoch", "horizon", "itrf_to_wgs84", "position", "position_angle", "separation", "to_horizon", "wgs84_to_itrf"]
