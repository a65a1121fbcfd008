"""Planar geometry as column functions over ``array<array<struct<lon,lat>>>`` (rings of a shape).

Null shapes give null; empty shapes, and rings of under three vertices where an area is meant, give 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the earth's radius in metres that the measures use.
EARTH_M = 6371000.0
RAD = math.pi / 180.0


def project_m(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Local metres east and north of (lon0, lat0), equirectangular."""
    return (lon - lon0) * (RAD * EARTH_M) * F.cos(lat0 * RAD), (lat - lat0) * (RAD * EARTH_M)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle metres; rounding beyond the antipode is clamped."""
    half = lambda x: F.pow(F.sin(x * (RAD / 2)), F.lit(2.0))
    a = half(lat2 - lat1) + F.cos(lat1 * RAD) * F.cos(lat2 * RAD) * half(lon2 - lon1)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def rotate(ring: Column) -> Column:
    """The ring from its second vertex on, with its first at the end."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def ring_area_m2(ring: Column, lat0: Column) -> Column:
    """Signed area: positive for anticlockwise rings; a ring closes itself."""
    lon0 = F.get(ring, F.lit(0))["lon"]

    def cross(p: Column, q: Column) -> Column:
        (px, py), (qx, qy) = project_m(p["lon"], p["lat"], lon0, lat0), project_m(q["lon"], q["lat"], lon0, lat0)
        return px * qy - qx * py

    return F.when(F.size(ring) >= 3, total(F.zip_with(ring, rotate(ring), cross)) / 2).otherwise(F.lit(0.0))


def polygon_area_m2(rings: Column) -> Column:
    """Area of all rings: holes run against their outer ring and take theirs away."""
    lat0 = F.get(F.get(rings, F.lit(0)), F.lit(0))["lat"]
    return F.abs(total(F.transform(rings, lambda r: ring_area_m2(r, lat0))))


def signed_area_deg(ring: Column) -> Column:
    """Signed area in square degrees."""
    cross = F.zip_with(ring, rotate(ring), lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    return total(cross) / 2


def bbox(rings: Column) -> Column:
    """struct<lon_min, lat_min, lon_max, lat_max> over all vertices."""
    vertices = F.flatten(rings)
    lon, lat = F.transform(vertices, lambda v: v["lon"]), F.transform(vertices, lambda v: v["lat"])
    return F.struct(F.array_min(lon).alias("lon_min"), F.array_min(lat).alias("lat_min"), F.array_max(lon).alias("lon_max"), F.array_max(lat).alias("lat_max"))


def in_box(lon: Column, lat: Column, box: Column, pad: float = 0.0) -> Column:
    """Edges included."""
    return lon.between(box["lon_min"] - pad, box["lon_max"] + pad) & lat.between(box["lat_min"] - pad, box["lat_max"] + pad)


def vertex_mean(rings: Column) -> Column:
    """struct<lon, lat>: the mean of all vertices (a closing vertex counts twice); (0, 0) if none."""
    vertices = F.flatten(rings)
    n = F.size(vertices)
    mean = lambda k: F.when(n > 0, total(F.transform(vertices, lambda v: v[k])) / n).otherwise(F.lit(0.0))
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def segment_distance_m(lon: Column, lat: Column, p: Column, q: Column) -> Column:
    """Metres from a point to the segment from p to q, projected about the point."""
    (ax, ay), (bx, by) = project_m(p["lon"], p["lat"], lon, lat), project_m(q["lon"], q["lat"], lon, lat)
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / length))).otherwise(F.lit(0.0))
    return F.hypot(ax + t * dx, ay + t * dy)


def distance_to_boundary_m(lon: Column, lat: Column, rings: Column) -> Column:
    """The least distance to the segments between neighbouring vertices as written (a ring is not
    closed here); infinity where there is none."""
    per_ring = F.transform(rings, lambda r: F.array_min(F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda p, q: segment_distance_m(lon, lat, p, q))))
    return F.coalesce(F.array_min(per_ring), F.lit(float("inf")))


#: The map frame's steps in degrees.
STEP_LON, STEP_LAT = 0.25, 1.0 / 6.0


def snap(value: Column, step: float) -> Column:
    """The nearest multiple of the step (halves to even), to six places."""
    return F.round(F.bround(value / F.lit(step)) * F.lit(step), 6)


def snap_box(box: Column) -> Column:
    return F.struct(*[snap(box[k], STEP_LON if k.startswith("lon") else STEP_LAT).alias(k) for k in ("lon_min", "lat_min", "lon_max", "lat_max")])


def sample_line(lat1: Column, lon1: Column, lat2: Column, lon2: Column, step_m: float = 50.0) -> Column:
    """array<struct<i, lon, lat>>: equal parts of the line, at most ``step_m`` long, two at least."""
    n = F.greatest(F.lit(2), F.floor(haversine_m(lon1, lat1, lon2, lat2) / step_m).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("i"), (lon1 + (lon2 - lon1) * i / n).alias("lon"), (lat1 + (lat2 - lat1) * i / n).alias("lat")))


def polygons(rings: Column) -> Column:
    """array<array<ring>>: rings grouped to polygons.  A clockwise ring, or the first, opens a polygon;
    others are holes of the latest.  Rings of under three vertices are left out."""
    full = F.filter(rings, lambda r: F.size(r) >= 3)
    empty = F.slice(F.array(full), 1, 0)

    def add(done: Column, ring: Column) -> Column:
        opens = (F.size(done) == 0) | (signed_area_deg(ring) < 0)
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.array(ring))))
        return F.when(opens, F.concat(done, F.array(F.array(ring)))).otherwise(grown)

    return F.aggregate(full, empty, add)


#: The type numbers of shapes that are polygons, and lines (plain, with Z, with M).
POLYGON_TYPES, LINE_TYPES = (5, 15, 25), (3, 13, 23)


def is_polygon(shape_type: Column) -> Column:
    return F.coalesce(shape_type.isin(*POLYGON_TYPES), F.lit(False))


def is_line(shape_type: Column) -> Column:
    return F.coalesce(shape_type.isin(*LINE_TYPES), F.lit(False))
