"""Geodesic column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius (km) for the great-circle distance, metres per degree for
# the download box and for the map extent, and the cosine floor of the extent.
EARTH_RADIUS_KM = 6371.0
M_PER_DEG_BOX = 111320.0
M_PER_DEG_MAP = 111000.0
COS_FLOOR = 1e-6


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance (km) between two points given in degrees."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bbox_half_extent(lat, radius_m, m_per_deg: float = M_PER_DEG_BOX):
    """(half height, half width) in degrees of a square box of the given radius."""
    dlat = _c(radius_m) / F.lit(m_per_deg)
    dlon = _c(radius_m) / (F.lit(m_per_deg) * F.greatest(F.cos(F.radians(_c(lat))), F.lit(COS_FLOOR)))
    return dlat, dlon


def round5(c: Column) -> Column:
    """Round to 5 decimals on the binary value (round(x * 1e5) / 1e5)."""
    return F.round(c * F.lit(1e5)) / F.lit(1e5)


def bbox_cols(lat, lon, radius_m) -> dict[str, Column]:
    """West, south, east, north (5 dp) and the 'W,S,E,N' text used by the area request."""
    dlat, dlon = bbox_half_extent(lat, radius_m)
    west = round5(_c(lon) - dlon)
    south = round5(_c(lat) - dlat)
    east = round5(_c(lon) + dlon)
    north = round5(_c(lat) + dlat)
    return {"west": west, "south": south, "east": east, "north": north}
