"""Distances, boxes and polygons as Column expressions (WGS84 degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres, and metres of a degree of latitude as the prefilter takes it (fixed values).
EARTH_RADIUS_M = 6_371_008.8
KM_PER_DEGREE = 110.0


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle metres; null if a coordinate is null."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    chord = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def coordinate(value: Column, low: float, high: float) -> Column:
    """A finite number within bounds, else null; booleans are no numbers."""
    x = value.cast("string").try_cast("double")
    return F.when(F.isnan(x) | ~x.between(low, high), None).otherwise(x)


def latitude(value: Column) -> Column:
    return coordinate(value, -90.0, 90.0)


def longitude(value: Column) -> Column:
    return coordinate(value, -180.0, 180.0)


def degree_deltas(lat: Column, radius_km: Column) -> tuple[Column, Column]:
    """Half height and half width in degrees of a box that holds a circle, also near a pole and for wide circles."""
    dlat = radius_km / KM_PER_DEGREE
    near = radius_km / (KM_PER_DEGREE * F.greatest(F.lit(1e-9), F.cos(F.radians(lat))))
    angle = F.least(radius_km * 1000 / EARTH_RADIUS_M, F.lit(1.5707963))
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.greatest(F.lit(1e-9), F.cos(F.radians(lat))))))
    return dlat, F.when(F.abs(lat) + dlat >= 90, 180.0).otherwise(F.greatest(near, wide))


def in_box(lat: Column, lon: Column, lat0: Column, lon0: Column, radius_km: Column) -> Column:
    """A superset of the radius filter by plain ranges, also across the antimeridian."""
    dlat, dlon = degree_deltas(lat0, radius_km)
    west, east = lon0 - dlon, lon0 + dlon
    inside = F.when(dlon >= 180, F.lit(True)).when(west < -180, (lon >= west + 360) | (lon <= east)).when(east > 180, (lon >= west) | (lon <= east - 360)).otherwise(lon.between(west, east))
    return lat.between(lat0 - dlat, lat0 + dlat) & inside


def within_radius(lat: Column, lon: Column, lat0: Column, lon0: Column, radius_km: Column) -> Column:
    return in_box(lat, lon, lat0, lon0, radius_km) & (haversine_m(lat, lon, lat0, lon0) <= radius_km * 1000)


def grid_cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def quadrants(south: Column, west: Column, north: Column, east: Column) -> Column:
    """The four equal parts of a box."""
    lat, lon = (south + north) / 2, (west + east) / 2
    part = lambda s, w, n, e: F.struct(s.alias("south"), w.alias("west"), n.alias("north"), e.alias("east"))
    return F.array(part(south, west, lat, lon), part(south, lon, lat, east), part(lat, west, north, lon), part(lat, lon, north, east))


def point_in_polygons(lon: str, lat: str, polygons: str) -> Column:
    """Whether a point lies in one of the polygons: array of polygons, each an array of rings of [lon, lat], the first outer, others holes.

    Boundaries count as inside a ring (so a hole's boundary is outside); rings of fewer than four points contain nothing.
    """
    pairs = "zip_with(ring, concat(slice(ring, 2, size(ring)), slice(ring, 1, 1)), (a, b) -> named_struct('a', a, 'b', b))"
    edge = (
        f"exists({pairs}, e -> abs(({lon} - e.a[0]) * (e.b[1] - e.a[1]) - ({lat} - e.a[1]) * (e.b[0] - e.a[0])) < 1e-12D "
        f"and {lon} between least(e.a[0], e.b[0]) and greatest(e.a[0], e.b[0]) and {lat} between least(e.a[1], e.b[1]) and greatest(e.a[1], e.b[1]))"
    )
    crossings = f"size(filter({pairs}, e -> (e.a[1] > {lat}) <> (e.b[1] > {lat}) and {lon} < (e.b[0] - e.a[0]) * ({lat} - e.a[1]) / nullif(e.b[1] - e.a[1], 0D) + e.a[0]))"
    inside = lambda ring: f"exists(array({ring}), ring -> size(ring) >= 4 and ({edge} or {crossings} % 2 = 1))"
    polygon = f"size(p) > 0 and {inside('p[0]')} and not exists(slice(p, 2, greatest(size(p) - 1, 0)), h -> {inside('h')})"
    return F.expr(f"exists({polygons}, p -> {polygon})")
