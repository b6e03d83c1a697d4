"""Distances and grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the radius' unit; degrees in."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def snap_coordinate(v: Column, resolution: float) -> Column:
    """The nearest multiple of the resolution, halves to the even one."""
    return F.round(F.bround(v / resolution) * resolution, 6)


def cell_id(lat: Column, lon: Column, resolution: float) -> Column:
    """Name of the grid cell that a point falls in."""
    return F.concat(F.format_string("%.4f", snap_coordinate(lat, resolution)), F.lit("_"), F.format_string("%.4f", snap_coordinate(lon, resolution)))


def lattice(low: Column, high: Column, resolution: float) -> Column:
    """Indexes of all grid lines that cover [low, high] with half a cell on both sides."""
    return F.sequence(F.floor((low - resolution / 2) / resolution).cast("int"), F.ceil((high + resolution / 2) / resolution).cast("int"))


def geocell_name(lat: Column, lon: Column) -> Column:
    """The one-degree cell by its south-west corner, e.g. N45_E006."""
    a, o = F.floor(lat), F.floor(lon)
    return F.concat(F.when(a >= 0, "N").otherwise("S"), F.lpad(F.abs(a).cast("string"), 2, "0"), F.lit("_"), F.when(o >= 0, "E").otherwise("W"), F.lpad(F.abs(o).cast("string"), 3, "0"))
