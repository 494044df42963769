"""Distances and destinations on the WGS-84 ellipsoid (Vincenty), for whole Arrow batches in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ellipsoid, and when the iteration ends.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
MINOR = MAJOR * (1 - FLATTENING)
ROUNDS, CLOSE = 10, 1e-13


def _series(cos2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u2 = cos2 * (MAJOR**2 - MINOR**2) / MINOR**2
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _correction(b, sin_s, cos_s, cos2m):
    return b * sin_s * (cos2m + b / 4 * (cos_s * (-1 + 2 * cos2m**2) - b / 6 * cos2m * (-3 + 4 * sin_s**2) * (-3 + 4 * cos2m**2)))


def distance(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres between points given in degrees (arrays); 0 for equal points."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    u1, u2, across = np.arctan((1 - FLATTENING) * np.tan(lat1)), np.arctan((1 - FLATTENING) * np.tan(lat2)), lon2 - lon1
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = across.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(ROUNDS):
            sin_s = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cos_s = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, c1 * c2 * np.sin(lam) / sin_s, 0.0)
            cos2 = 1 - sin_a**2
            cos2m = np.where(cos2 > 0, cos_s - 2 * s1 * s2 / cos2, 0.0)
            c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
            new = across + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (cos2m + c * cos_s * (-1 + 2 * cos2m**2)))
            done = np.abs(new - lam) <= CLOSE * np.maximum(1.0, np.abs(lam))
            lam = new
            if done.all():
                break
        a, b = _series(cos2)
        return np.where(sin_s > 0, MINOR * a * (sigma - _correction(b, sin_s, cos_s, cos2m)), 0.0)


def destination(lat, lon, bearing, metres) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) in degrees of the points that lie metres away in the direction of bearing."""
    lat, lon, bearing = (np.radians(np.asarray(x, float)) for x in (lat, lon, bearing))
    metres = np.asarray(metres, float)
    tan_u = (1 - FLATTENING) * np.tan(lat)
    cos_u = 1 / np.sqrt(1 + tan_u**2)
    sin_u = tan_u * cos_u
    start = np.arctan2(tan_u, np.cos(bearing))
    sin_a = cos_u * np.sin(bearing)
    cos2 = 1 - sin_a**2
    a, b = _series(cos2)
    sigma = first = metres / (MINOR * a)
    for _ in range(ROUNDS):
        new = first + _correction(b, np.sin(sigma), np.cos(sigma), np.cos(2 * start + sigma))
        done = np.abs(new - sigma) <= CLOSE
        sigma = new
        if done.all():
            break
    sin_s, cos_s, cos2m = np.sin(sigma), np.cos(sigma), np.cos(2 * start + sigma)
    end = np.arctan2(sin_u * cos_s + cos_u * sin_s * np.cos(bearing), (1 - FLATTENING) * np.hypot(sin_a, sin_u * sin_s - cos_u * cos_s * np.cos(bearing)))
    lam = np.arctan2(sin_s * np.sin(bearing), cos_u * cos_s - sin_u * sin_s * np.cos(bearing))
    c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
    across = lam - (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (cos2m + c * cos_s * (-1 + 2 * cos2m**2)))
    return np.degrees(end), np.degrees(lon + across)


@F.pandas_udf(T.DoubleType())
def ellipsoidal_distance(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(distance(lat1, lon1, lat2, lon2))


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def ellipsoidal_destination(lat: pd.Series, lon: pd.Series, bearing: pd.Series, metres: pd.Series) -> pd.DataFrame:
    end = destination(lat, lon, bearing, metres)
    return pd.DataFrame({"lat": end[0], "lon": end[1]})
