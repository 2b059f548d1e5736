"""Column expressions on coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def valid_extent(extent) -> tuple[float, float, float, float]:
    """West, south, east, north as finite numbers in order, or an error."""
    if len(extent) != 4:
        raise ValueError("an extent is west, south, east, north")
    west, south, east, north = map(float, extent)
    if not all(map(math.isfinite, (west, south, east, north))) or west >= east or south >= north:
        raise ValueError("an extent needs finite west < east and south < north")
    return west, south, east, north


def in_extent(df: DataFrame, extent, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows inside the box, edges included; the two ranges reach the scan."""
    west, south, east, north = valid_extent(extent)
    return df.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def aspect_parts(df: DataFrame, aspect: str, prefix: str | None = None) -> DataFrame:
    """Sine and cosine of an aspect in degrees."""
    name = prefix or aspect
    return df.withColumns({f"{name}_sin": F.sin(F.radians(aspect)), f"{name}_cos": F.cos(F.radians(aspect))})


def finite(x) -> Column:
    x = _col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def complete_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows whose features are all finite."""
    if not features:
        raise ValueError("at least one feature is needed")
    keep = F.lit(True)
    for f in features:
        keep = keep & F.coalesce(finite(f), F.lit(False))
    return df.filter(keep)


def block_key(lat, lon, degrees: float) -> Column:
    """``floor(lat/b):floor(lon/b)`` (P5)."""
    return F.concat_ws(":", *(F.floor(_col(x) / degrees).cast("string") for x in (lat, lon)))


def area_name(x) -> Column:
    """Lower-cased, trimmed area text (P25)."""
    return F.lower(F.trim(_col(x).cast("string")))


def id_token(x) -> Column:
    """Text safe in identifiers: other characters become dashes, outer dashes go, nothing becomes 1 (P25)."""
    token = F.regexp_replace(F.regexp_replace(_col(x).cast("string"), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(token == "", "1").otherwise(token)
