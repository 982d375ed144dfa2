"""Distances and boxes on the sphere as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; metres in a unit of a query's radius; units in a metre for output.
EARTH = 6372797.560856
RADIUS_UNITS = {"km": 1000.0, "mi": 1609.344, "ft": 0.3048, "f": 0.3048, "m": 1.0}
OUTPUT_UNITS = {"m": 1.0, "km": 0.001, "mi": 0.000621371, "ft": 3.28084, "f": 3.28084}
#: Fixed value: the latitude beyond which cells do not reach.
CELL_LATITUDE = 85.05112878


def distance(lat: Column, lon: Column, origin: tuple[float, float]) -> Column:
    """Metres from a fixed point: haversine by its chord, 2 R asin(sqrt(u^2 + cos cos v^2))."""
    here_lat, here_lon = (math.radians(x) for x in origin)
    u = F.sin((F.radians(lat) - F.lit(here_lat)) / 2)
    v = F.sin((F.radians(lon) - F.lit(here_lon)) / 2)
    return F.lit(2.0 * EARTH) * F.asin(F.sqrt(u * u + F.cos(F.radians(lat)) * F.lit(math.cos(here_lat)) * v * v))


def box(lat: Column, lon: Column, origin: tuple[float, float], metres: float) -> Column | None:
    """A test that every point within the radius passes, on bare columns, for the scan to prune by;
    None where the circle reaches a pole or spans all longitudes."""
    reach = metres / EARTH * (1 + 1e-9) + 1e-9
    phi = math.radians(origin[0])
    if reach + abs(phi) >= math.pi / 2:
        return None
    up = math.degrees(reach)
    side = math.degrees(math.asin(min(1.0, math.sin(reach) / math.cos(phi)))) + 1e-9
    test = (lat >= origin[0] - up) & (lat <= origin[0] + up)
    west, east = origin[1] - side, origin[1] + side
    if east - west >= 360:
        return test
    if west < -180:
        return test & ((lon >= west + 360) | (lon <= east))
    if east > 180:
        return test & ((lon >= west) | (lon <= east - 360))
    return test & (lon >= west) & (lon <= east)


#: The bits that stay when the bits of a number are spread out by 16, 8, 4, 2 and 1.
SPREAD = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


def _spread(v: Column) -> Column:
    """The lower 32 bits at the even places."""
    for shift, mask in SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _gathered(v: Column) -> Column:
    """The bits at the even places as a number."""
    v = v.bitwiseAND(F.lit(SPREAD[-1][1]))
    masks = [mask for _, mask in SPREAD[-2::-1]] + [0x00000000FFFFFFFF]
    for (shift, _), mask in zip(SPREAD[::-1], masks):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))
    return v


def cell_place(code: Column) -> tuple[Column, Column]:
    """Row (of latitude) and column (of longitude) of a cell."""
    return _gathered(code), _gathered(F.shiftrightunsigned(code, 1))


def cell_centre(code: Column, steps: int = 31) -> Column:
    """The point, struct lat and lon, in the middle of a cell."""
    row, column = cell_place(code)
    size = float(1 << steps)
    lat = (row + 0.5) / size * (2 * CELL_LATITUDE) - CELL_LATITUDE
    return F.struct(lat.alias("lat"), ((column + 0.5) / size * 360.0 - 180.0).alias("lon"))


def cell(lat: Column, lon: Column, steps: int = 31) -> Column:
    """Interleaved bits of latitude and longitude: a clustering key in which near points are near.
    Points beyond the cells' latitude have cell 0."""
    size = float(1 << steps)
    x = F.floor((lat + CELL_LATITUDE) / (2 * CELL_LATITUDE) * size).cast("long")
    y = F.floor((lon + 180.0) / 360.0 * size).cast("long")

    code = _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))
    return F.when(F.abs(lat) <= CELL_LATITUDE, code).otherwise(F.lit(0).cast("long"))
