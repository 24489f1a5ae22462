"""Points in polygons by a cover of cells.

A region's polygons are covered by the cells of a grid: ``inner`` cells lie wholly in a polygon, so their points need no test;
``border`` cells are crossed by an edge, so their points are tested exactly.  Points and cover meet in an equi-join on the cell,
and the cover is built from edges alone: an edge names the cells it crosses, and a row of cells is inside between the crossings of its middle line.

Polygons that cross the antimeridian (two successive points more than 180 degrees apart) are unrolled to 0..360 degrees, points
with them; cells count modulo a full turn, so both sides name the same cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.geo import point_in_polygons
from vacantia.operators.storage import checkpoint

#: Degrees of a cell; a divisor of 360.
CELL = 0.5
#: Widens an edge, so that rounding cannot leave out a cell it touches.
_EPS = 1e-9


def _unrolled(regions: DataFrame, key: str, polygons: str) -> DataFrame:
    """(region, p, wraps, polygon): one polygon a row; rings of fewer than four points contain nothing and are left out with their polygon's others."""
    p = regions.select(F.col(key).alias("region"), F.posexplode(polygons).alias("p", "polygon")).filter(F.size("polygon") > 0).filter(F.size(F.col("polygon")[0]) >= 4)
    p = p.withColumn("polygon", F.filter("polygon", lambda r: F.size(r) >= 4))
    steps = lambda r: F.zip_with(F.slice(r, 2, F.size(r)), F.slice(r, 1, F.size(r) - 1), lambda a, b: F.abs(a[0] - b[0]) > 180)
    p = p.withColumn("wraps", F.exists("polygon", lambda r: F.exists(steps(r), lambda x: x)))
    turned = F.transform("polygon", lambda r: F.transform(r, lambda x: F.array(F.when(x[0] < 0, x[0] + 360).otherwise(x[0]), x[1])))
    return p.withColumn("polygon", F.when(F.col("wraps"), turned).otherwise(F.col("polygon")))


def _edges(unrolled: DataFrame) -> DataFrame:
    """(region, p, ax, ay, bx, by): every edge of every ring, closed."""
    rings = unrolled.select("region", "p", F.explode("polygon").alias("ring"))
    pairs = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))
    return rings.select("region", "p", F.explode(pairs).alias("e")).select("region", "p", "e.*").filter("not (ax = bx and ay = by)")


def cell_cover(regions: DataFrame, *, key: str = "region", polygons: str = "polygons", size: float = CELL) -> DataFrame:
    """(region, cx, cy, inner) of every cell that a region reaches; a cell within one of its polygons is inner even if another's edge crosses it."""
    e = checkpoint(_edges(_unrolled(regions, key, polygons)), "edges")
    columns = round(360 / size)
    # The columns an edge passes, and in each the rows between where it comes in and goes out.
    west, east = F.least("ax", "bx") - _EPS, F.greatest("ax", "bx") + _EPS
    over = e.withColumn("cx", F.explode(F.sequence(F.floor(west / size), F.floor(east / size))))
    at = lambda x: F.col("ay") + (F.greatest(F.least(x, F.greatest("ax", "bx")), F.least("ax", "bx")) - F.col("ax")) * (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    left, right = at(F.col("cx") * size - _EPS), at((F.col("cx") + 1) * size + _EPS)
    low, high = F.coalesce(F.least(left, right), F.least("ay", "by")) - _EPS, F.coalesce(F.greatest(left, right), F.greatest("ay", "by")) + _EPS
    border = over.select("region", "p", "cx", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))).alias("cy")).distinct()
    # Middle lines of rows that an edge crosses (half open, so that a vertex counts once), and the cells between pairs of crossings.
    first, last = F.ceil(F.least("ay", "by") / size - 0.5), F.ceil(F.greatest("ay", "by") / size - 0.5) - 1
    crossed = e.filter(first <= last).withColumn("cy", F.explode(F.sequence(first, last)))
    x = F.col("ax") + ((F.col("cy") + 0.5) * size - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    lines = crossed.withColumn("x", x).groupBy("region", "p", "cy").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    spans = lines.select("region", "p", "cy", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.col("xs")[2 * k].alias("a"), F.col("xs")[2 * k + 1].alias("b")))).alias("s"))
    begin, end = F.ceil(F.col("s.a") / size - 0.5), F.floor(F.col("s.b") / size - 0.5)
    within = spans.filter(begin <= end).select("region", "p", F.explode(F.sequence(begin, end)).alias("cx"), "cy").join(border, ["region", "p", "cx", "cy"], "left_anti")
    both = border.withColumn("inner", F.lit(False)).unionByName(within.withColumn("inner", F.lit(True)))
    return both.groupBy("region", F.pmod("cx", F.lit(columns)).alias("cx"), "cy").agg(F.max("inner").alias("inner"))


def join_regions(points: DataFrame, regions: DataFrame, *, lon: str = "lon", lat: str = "lat", key: str = "region", polygons: str = "polygons", size: float = CELL) -> DataFrame:
    """``points`` with ``key``, a row for each region that a point lies in.

    polygons: array of polygons, each an array of rings of [lon, lat], the first outer, others holes.  Boundaries are inside a ring, so a
    hole's boundary is outside.  Points without a coordinate lie nowhere; a region without polygons holds nothing; repeated points are
    points of their own.
    """
    columns = round(360 / size)
    cover = checkpoint(cell_cover(regions, key=key, polygons=polygons, size=size), "cover")
    shapes = checkpoint(_unrolled(regions, key, polygons).groupBy("region").agg(F.collect_list(F.struct("wraps", "polygon")).alias("shapes")), "shapes")
    placed = points.withColumns({"__cx": F.pmod(F.floor(F.col(lon) / size), F.lit(columns)), "__cy": F.floor(F.col(lat) / size)})
    met = placed.join(cover.select(F.col("region").alias("__region"), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("inner").alias("__inner")), ["__cx", "__cy"])
    sure = met.filter("__inner")
    tested = met.filter("not __inner").join(shapes.select(F.col("region").alias("__region"), "shapes"), "__region")
    plain, turned = (F.transform(F.filter("shapes", lambda s: s["wraps"] == w), lambda s: s["polygon"]) for w in (False, True))
    tested = tested.withColumns({"__plain": plain, "__turned": turned, "__x": F.col(lon), "__t": F.when(F.col(lon) < 0, F.col(lon) + 360).otherwise(F.col(lon)), "__y": F.col(lat)})
    hit = tested.filter(point_in_polygons("__x", "__y", "__plain") | point_in_polygons("__t", "__y", "__turned"))
    return sure.select(*points.columns, F.col("__region").alias(key)).unionByName(hit.select(*points.columns, F.col("__region").alias(key)))
