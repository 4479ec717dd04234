"""FITS images: the primary array of a file, read in parallel by rows of its fastest axis, and written."""

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.images import Axis, Coordinates, Image
from ..session import ship
from ..types import TaqlError
from .files import Files

BLOCK, CARD = 2880, 80
_KINDS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def parse_header(data: bytes) -> tuple[dict[str, Any], int]:
    """Cards of the primary header, and where its data begins."""
    cards: dict[str, Any] = {}
    for at in range(0, len(data) - CARD + 1, CARD):
        card = data[at : at + CARD].decode("ascii", "replace")
        key = card[:8].strip()
        if key == "END":
            return cards, -(-(at + CARD) // BLOCK) * BLOCK
        if card[8:10] != "= " or not key:
            continue
        body = card[10:].strip()
        if body.startswith("'"):
            end = 1
            while end < len(body) and (body[end] != "'" or body[end + 1 : end + 2] == "'"):
                end += 2 if body[end] == "'" else 1
            cards[key] = body[1:end].replace("''", "'").rstrip()
        else:
            text = body.split("/")[0].strip()
            if text in ("T", "F"):
                cards[key] = text == "T"
            elif text:
                try:
                    cards[key] = int(text)
                except ValueError:
                    cards[key] = float(text.replace("D", "E"))
    raise TaqlError("a FITS header without END")


def _coordinates(c: dict[str, Any], n: int) -> Coordinates:
    axes, direction = [], {}
    for k in range(1, n + 1):
        kind, unit = str(c.get(f"CTYPE{k}", "")), str(c.get(f"CUNIT{k}", ""))
        name = kind.split("-")[0]
        is_lon, is_lat = name in ("RA", "GLON"), name in ("DEC", "GLAT")
        scale = math.pi / 180 if (is_lon or is_lat) and unit in ("", "deg") else 1.0
        axes.append(Axis(name or f"linear{k}", float(c.get(f"CRVAL{k}", 0)) * scale, float(c.get(f"CDELT{k}", 1)) * scale, float(c.get(f"CRPIX{k}", 1)) - 1, "rad" if scale != 1 else unit))
        if is_lon:
            direction["lon"] = k - 1
        if is_lat:
            direction["lat"] = k - 1
    if len(direction) < 2:
        return Coordinates(tuple(axes))
    i, j = direction["lon"], direction["lat"]
    pc = tuple(float(c.get(f"PC{a + 1}_{b + 1}", c.get(f"PC{a + 1:02d}_{b + 1:02d}", float(a == b)))) for a, b in ((i, i), (i, j), (j, i), (j, j)))
    return Coordinates(tuple(axes), (i, j), pc)  # type: ignore[arg-type]


def read_fits(spark: SparkSession, path: str) -> Image:
    """The primary array. Other units, random groups and files that are cut short are refused."""
    ship(spark)
    head = spark.read.format("binaryFile").load(path).select("length", F.substring("content", 1, 40 * BLOCK).alias("head")).first()
    c, begin = parse_header(bytes(head["head"]))
    n = int(c.get("NAXIS", 0))
    if c.get("GROUPS") is True or n == 0:
        raise TaqlError("no primary image in the file")
    shape = tuple(int(c[f"NAXIS{k}"]) for k in range(n, 0, -1))
    kind = _KINDS.get(int(c["BITPIX"]))
    if kind is None:
        raise TaqlError(f"BITPIX {c['BITPIX']}")
    item = abs(int(c["BITPIX"])) // 8
    if head["length"] < begin + int(np.prod(shape)) * item:
        raise TaqlError("the file is cut short")
    width = shape[-1]
    scale, zero = float(c.get("BSCALE", 1)), float(c.get("BZERO", 0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = int(np.prod(shape)) // max(width, 1)
        for b in batches:
            for content in b.column(0):
                view = memoryview(content.as_buffer())
                for r in range(0, count, 256):
                    k = min(256, count - r)
                    data = np.frombuffer(view, kind, k * width, begin + r * width * item).astype(np.float64) * scale + zero
                    yield pa.record_batch([pa.array(np.arange(r * width, (r + k) * width)), pa.array(data.astype(np.float32))], names=["pix", "value"])

    pixels = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "pix long, value float")
    info = {}
    if "BMAJ" in c:
        info = {"restoringbeam": {"major": {"value": float(c["BMAJ"]) * 3600, "unit": "arcsec"}, "minor": {"value": float(c["BMIN"]) * 3600, "unit": "arcsec"}, "positionangle": {"value": float(c.get("BPA", 0)), "unit": "deg"}}}
    used = {"SIMPLE", "BITPIX", "NAXIS", "EXTEND", "BSCALE", "BZERO", "BUNIT", "BMAJ", "BMIN", "BPA"}
    misc = {k: v for k, v in c.items() if k not in used and not k[-1].isdigit()}
    return Image(pixels, shape, _coordinates(c, n), str(c.get("BUNIT", "")), info, misc)


def _card(key: str, value: Any) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int):
        text = f"{value:>20}"
    elif isinstance(value, float):
        text = f"{value:>20.12E}"
    else:
        text = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'"
    return f"{key:<8}= {text}".ljust(CARD)[:CARD].encode("ascii")


def write_fits(image: Image, path: str) -> None:
    """BITPIX -32 with coordinates and beam. A FITS file has one writer: the pixels pass through the driver."""
    n = len(image.shape)
    cards = [_card("SIMPLE", True), _card("BITPIX", -32), _card("NAXIS", n)]
    cards += [_card(f"NAXIS{k + 1}", int(s)) for k, s in enumerate(image.shape[::-1])]
    if image.unit:
        cards.append(_card("BUNIT", image.unit))
    d = image.coordinates.direction
    for k, a in enumerate(image.coordinates.axes, 1):
        turn = d is not None and k - 1 in d
        scale = 180 / math.pi if turn else 1.0
        kind = ("RA---SIN" if d and k - 1 == d[0] else "DEC--SIN") if turn else {"Frequency": "FREQ", "Stokes": "STOKES"}.get(a.name, a.name)
        cards += [_card(f"CTYPE{k}", kind), _card(f"CRVAL{k}", a.crval * scale), _card(f"CDELT{k}", a.cdelt * scale), _card(f"CRPIX{k}", a.crpix + 1), _card(f"CUNIT{k}", "deg" if turn else a.unit)]
    if d is not None:
        i, j = d
        cards += [_card(f"PC{a + 1}_{b + 1}", v) for (a, b), v in zip(((i, i), (i, j), (j, i), (j, j)), image.coordinates.pc, strict=True)]
    if beam := image.info.get("restoringbeam"):
        cards += [_card("BMAJ", beam["major"]["value"] / 3600), _card("BMIN", beam["minor"]["value"] / 3600), _card("BPA", float(beam["positionangle"]["value"]))]
    head = b"".join([*cards, b"END".ljust(CARD)])
    data = image.getdata().astype(">f4").tobytes()
    out = head.ljust(-(-len(head) // BLOCK) * BLOCK) + data + b"\0" * (-len(data) % BLOCK)
    Files(image.pixels.sparkSession).write(path, out)
