"""Positions on the sky: separation and the cells used to join by position.

The sky is cut into declination zones of equal height. Each zone is cut into as
many equal right-ascension cells as fit without making a cell narrower than the
zone height anywhere in the zone, so a circle of half that height meets only a
few cells. Degrees everywhere but in radii, which are arc seconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = 3600.0


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine, exact enough at sub-arcsecond scale."""
    half_dec = F.sin(F.radians(dec2 - dec1) / 2)
    half_ra = F.sin(F.radians(ra2 - ra1) / 2)
    h = half_dec * half_dec + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half_ra * half_ra
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))) * ARCSEC


def zone_height(radius_arcsec: float) -> float:
    """Zone height in degrees: four radii, and never so small that indexes overflow."""
    return max(4 * radius_arcsec / ARCSEC, 1e-6)


def zone(dec: Column, height: float) -> Column:
    return F.floor((dec + 90) / F.lit(height)).cast("bigint")


def zone_cells(z: Column, height: float) -> Column:
    """Number of right-ascension cells in a zone; at least one."""
    low, high = z * F.lit(height) - 90, (z + 1) * F.lit(height) - 90
    widest = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
    cells = F.floor(F.lit(360.0) * F.cos(F.radians(widest)) / F.lit(height))
    return F.greatest(cells, F.lit(1)).cast("bigint")


def cell(ra: Column, z: Column, height: float) -> Column:
    """Cell of a right ascension within zone z."""
    n = zone_cells(z, height)
    turn = F.pmod(ra, F.lit(360.0)) / 360
    return F.least(F.floor(turn * n).cast("bigint"), n - 1)


def _reach(radius_arcsec: float) -> float:
    """The radius in degrees, slightly too large, so that rounding never loses a cell."""
    return radius_arcsec / ARCSEC * (1 + 1e-6) + 1e-9


def zones_around(dec: Column, radius_arcsec: float, height: float) -> Column:
    """Array of the zones a circle around the declination can reach."""
    r = _reach(radius_arcsec)
    south, north = F.greatest(dec - r, F.lit(-90.0)), F.least(dec + r, F.lit(90.0))
    return F.sequence(zone(south, height), zone(north, height))


def cells_around(ra: Column, dec: Column, z: Column, radius_arcsec: float, height: float) -> Column:
    """Array of running cell numbers of zone z the circle can reach, to be taken modulo the zone's cells."""
    r = _reach(radius_arcsec)
    # Half width in right ascension; a circle that holds a pole reaches all around.
    spread = F.sin(F.radians(F.lit(r))) / F.cos(F.radians(dec))
    half = F.when((F.abs(dec) + r >= 90) | (spread >= 1), F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(spread, F.lit(1.0)))) + 1e-9
    )
    n = zone_cells(z, height)
    first = F.floor((ra - half) / 360 * n).cast("bigint")
    last = F.floor((ra + half) / 360 * n).cast("bigint")
    # A turn or more is every cell once.
    return F.sequence(first, F.least(last, first + n - 1))
