"""Distances, angles and rates between two consecutive rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_M


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; NULL if any coordinate is missing."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    bounded = F.when(chord > 1.0, 1.0).when(chord < 0.0, 0.0).otherwise(chord)
    return F.asin(F.sqrt(bounded)) * (2.0 * EARTH_RADIUS_M)


def turn_deg(heading: Column, previous: Column) -> Column:
    """Signed heading change in [-180, 180)."""
    return F.pmod(heading - previous + 540.0, F.lit(360.0)) - 180.0


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds, negative where time runs backwards."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def per_second(change: Column, seconds: Column) -> Column:
    """A rate; NULL where no time has passed."""
    return F.try_divide(change, seconds)
