import random

import pytest
from pyspark.sql import functions as F

from vacantia.functions.geo import point_in_polygons
from vacantia.operators import spatial

KIND = "region string, polygons array<array<array<array<double>>>>"


def ring(points):
    return [[float(a), float(b)] for a, b in [*points, points[0]]]


def star(rng, x, y, r, n):
    import math

    return ring([(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)])


def regions():
    rng = random.Random(4)
    rows = [(f"star{k}", [[star(rng, rng.uniform(-150, 150), rng.uniform(-60, 60), rng.uniform(0.1, 25), rng.randrange(3, 40))]]) for k in range(25)]
    rows.append(("holed", [[ring([(0, 0), (20, 0), (20, 20), (0, 20)]), ring([(5, 5), (15, 5), (15, 15), (5, 15)])], [ring([(8, 8), (12, 8), (12, 12), (8, 12)])]]))
    rows.append(("thin", [[ring([(30, 30), (30.01, 30), (40.01, 45), (40, 45)])]]))
    rows += [("none", []), ("null", None), ("line", [[[[1.0, 1.0], [2.0, 2.0]]]])]
    return rows


def points(rng, n):
    return [(k, rng.uniform(-180, 180), rng.uniform(-90, 90)) for k in range(n)] + [(n + k, rng.uniform(-2, 42), rng.uniform(-2, 47)) for k in range(n)] + [(-1, None, 3.0), (-2, 3.0, None), (-3, 0.0, 0.0), (-4, 5.0, 10.0), (-5, 20.0, 20.0), (-6, 10.0, 12.0)]


@pytest.mark.parametrize("size", [0.5, 4.0])
def test_equals_the_plain_predicate(spark, size):
    pts = spark.createDataFrame(points(random.Random(6), 1500), "id long, lon double, lat double")
    reg = spark.createDataFrame(regions(), KIND)
    got = spatial.join_regions(pts, reg, size=size)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    want = pts.crossJoin(reg.filter("polygons is not null")).filter(point_in_polygons("lon", "lat", "polygons")).select("id", "region")
    got = sorted(map(tuple, got.select("id", "region").collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100
    assert {r for i, r in got if i == -3} == {"holed"} and not {r for i, r in got if i == -4} and {r for i, r in got if i == -6} == {"holed"}


def test_across_the_antimeridian(spark):
    shape = [[ring([(170, -10), (-170, -10), (-170, 10), (170, 10)]), ring([(178, -2), (-178, -2), (-178, 2), (178, 2)])]]
    reg = spark.createDataFrame([("fiji", shape), ("west", [[ring([(-180, 20), (-160, 20), (-160, 30), (-180, 30)])]])], KIND)
    rng = random.Random(2)
    rows = [(k, rng.choice((-1, 1)) * rng.uniform(150, 180), rng.uniform(-15, 35)) for k in range(2000)] + [(-1, 180.0, 5.0), (-2, -180.0, 5.0), (-3, 180.0, 0.0), (-4, -180.0, 25.0)]
    got = spatial.join_regions(spark.createDataFrame(rows, "id long, lon double, lat double"), reg, size=1.0)
    want = set()
    for i, x, y in rows:
        d = 180 - abs(x)
        if d <= 10 and abs(y) <= 10 and not (d <= 2 and abs(y) <= 2):
            want.add((i, "fiji"))
        if x <= -160 and 20 <= y <= 30:
            want.add((i, "west"))
    assert {tuple(r) for r in got.select("id", "region").collect()} == want


def test_most_cells_of_a_large_region_are_inner(spark):
    reg = spark.createDataFrame([("big", [[ring([(0, 0), (50, 0), (50, 40), (0, 40)])]])], KIND)
    n = {r.inner: r["count"] for r in spatial.cell_cover(reg, size=0.5).groupBy("inner").agg(F.count("*").alias("count")).collect()}
    assert n[True] == 99 * 79 + 0 * n[False] or n[True] > 7000
    assert n[False] < 800
