"""Azimuthal equidistant projection on the WGS84 ellipsoid, and what builds on it.

Forward is the inverse geodesic problem, inverse the direct one; both are
Vincenty's series, iterated on whole Arrow batches until every row has settled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84.
MAJOR = 6_378_137.0
FLATTENING = 1 / 298.257223563
MINOR = MAJOR * (1 - FLATTENING)
ROUNDS = 200


def _series(cos2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = cos2 * (MAJOR**2 - MINOR**2) / MINOR**2
    return 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))


def _bend(b: np.ndarray, sin_s: np.ndarray, cos_s: np.ndarray, mid: np.ndarray) -> np.ndarray:
    return b * sin_s * (mid + b / 4 * (cos_s * (2 * mid**2 - 1) - b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))


def _correction(sin_a: np.ndarray, s: np.ndarray, sin_s: np.ndarray, cos_s: np.ndarray, mid: np.ndarray) -> np.ndarray:
    cos2 = 1 - sin_a**2
    c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
    return (1 - c) * FLATTENING * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))


def forward(lon: np.ndarray, lat: np.ndarray, lon0: float, lat0: float) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north of (lon0, lat0)."""
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat0)))
    u2 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat)))
    gap = np.radians((np.asarray(lon) - lon0 + 180) % 360 - 180)
    turn = gap.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(ROUNDS):
            sin_s = np.hypot(c2 * np.sin(turn), c1 * s2 - s1 * c2 * np.cos(turn))
            cos_s = s1 * s2 + c1 * c2 * np.cos(turn)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * np.sin(turn) / np.where(sin_s == 0, 1, sin_s))
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 == 0, 0.0, cos_s - 2 * s1 * s2 / np.where(cos2 == 0, 1, cos2))
            after = gap + _correction(sin_a, s, sin_s, cos_s, mid)
            settled = np.all(np.abs(after - turn) < 1e-13)
            turn = after
            if settled:
                break
        a, b = _series(cos2)
        metres = MINOR * a * (s - _bend(b, sin_s, cos_s, mid))
        azimuth = np.arctan2(c2 * np.sin(turn), c1 * s2 - s1 * c2 * np.cos(turn))
    return metres * np.sin(azimuth), metres * np.cos(azimuth)


def inverse(x: np.ndarray, y: np.ndarray, lon0: float, lat0: float) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of a point so many metres east and north of (lon0, lat0)."""
    metres, azimuth = np.hypot(x, y), np.arctan2(x, y)
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat0)))
    sin_a = np.cos(u1) * np.sin(azimuth)
    a, b = _series(1 - sin_a**2)
    s1 = np.arctan2(np.tan(u1), np.cos(azimuth))
    s = metres / (MINOR * a)
    for _ in range(ROUNDS):
        mid = np.cos(2 * s1 + s)
        after = metres / (MINOR * a) + _bend(b, np.sin(s), np.cos(s), mid)
        settled = np.all(np.abs(after - s) < 1e-13)
        s = after
        if settled:
            break
    mid, sin_s, cos_s = np.cos(2 * s1 + s), np.sin(s), np.cos(s)
    north = np.sin(u1) * sin_s - np.cos(u1) * cos_s * np.cos(azimuth)
    lat = np.arctan2(np.sin(u1) * cos_s + np.cos(u1) * sin_s * np.cos(azimuth), (1 - FLATTENING) * np.hypot(sin_a, north))
    turn = np.arctan2(sin_s * np.sin(azimuth), np.cos(u1) * cos_s - np.sin(u1) * sin_s * np.cos(azimuth))
    lon = np.degrees(turn - _correction(sin_a, s, sin_s, cos_s, mid)) + lon0
    return (lon + 180) % 360 - 180, np.degrees(lat)


Anchor = float | Column


def _column(value: Anchor) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def to_metres(lon: Column, lat: Column, lon0: Anchor, lat0: Anchor) -> Column:
    """struct(x, y) about an anchor, one for all rows or each row its own."""

    @F.pandas_udf("x double, y double")
    def projected(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = forward(*(c.to_numpy(float) for c in batch))
            yield pd.DataFrame({"x": x, "y": y})

    return projected(lon, lat, _column(lon0), _column(lat0))


def to_degrees(x: Column, y: Column, lon0: Anchor, lat0: Anchor) -> Column:
    """struct(lon, lat) about an anchor, one for all rows or each row its own."""

    @F.pandas_udf("lon double, lat double")
    def unprojected(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lon, lat = inverse(*(c.to_numpy(float) for c in batch))
            yield pd.DataFrame({"lon": lon, "lat": lat})

    return unprojected(x, y, _column(lon0), _column(lat0))


def grid_position(x: Column, y: Column, width: int, scale: float) -> tuple[Column, Column]:
    """Fractional column and row of a point in metres about the grid's centre; rows count downwards."""
    return x / scale + (width - 1) / 2, F.lit((width - 1) / 2) - y / scale


def metres_per_degree(lat: Column) -> Column:
    """Of longitude, at a latitude."""
    return F.cos(F.radians(lat)) * (MAJOR * math.pi / 180)


def parse_lonlat(text: str) -> tuple[float, float]:
    """Longitude and latitude from "lon,lat"."""
    parts = text.split(",")
    if len(parts) != 2:
        raise ValueError("wanted lon,lat")
    lon, lat = (float(p.strip()) for p in parts)
    return lon, lat


def projection_strings(lon0: float, lat0: float) -> tuple[str, str]:
    """Of degrees, and of metres about an anchor."""
    return "+proj=latlong +datum=WGS84", f"+proj=aeqd +lat_0={lat0} +lon_0={lon0} +units=m +datum=WGS84 +no_defs +over"


def reanchored(x: np.ndarray, y: np.ndarray, old: tuple[float, float], new: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Metres about one anchor as metres about another."""
    return forward(*inverse(x, y, *old), *new)


def lonlat_to_dem_id(lon: Column, lat: Column, width: int, scale: float, centre: tuple[float, float]) -> Column:
    """The library helper's id: offset (width + 1) / 2, cut off."""
    at = to_metres(lon, lat, *centre)
    half = F.lit((width + 1) / 2)
    return (F.floor(half - at["y"] / scale) * width + F.floor(at["x"] / scale + half)).cast("long")


def dem_id_to_lonlat(dem_id: Column, width: int, scale: float, centre: tuple[float, float]) -> Column:
    """struct(lon, lat) of a cell, with the library helper's offset."""
    half = (width + 1) / 2
    return to_degrees((dem_id % width - half) * scale, (F.lit(half) - F.floor(dem_id / width)) * scale, *centre)
