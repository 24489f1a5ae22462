import math
import random

from pyspark.sql import functions as F

from vacantia.sources import tiles
from vacantia.streaming.queues import VersionedTable


def recursive(areas, complete, size, most):
    out = set()

    def visit(area, s, w, n, e, depth):
        ok = complete((s, w, n, e))
        out.add((area, s, w, n, e, depth, "done" if ok else "failed" if depth >= most else "split"))
        if not ok and depth < most:
            y, x = (s + n) / 2, (w + e) / 2
            for q in ((s, w, y, x), (s, x, y, e), (y, w, n, x), (y, x, n, e)):
                visit(area, *q, depth + 1)

    for area, s, w, n, e in areas:
        for y in range(math.ceil((n - s) / size)):
            for x in range(math.ceil((e - w) / size)):
                visit(area, s + y * size, w + x * size, min(n, s + (y + 1) * size), min(e, w + (x + 1) * size), 0)
    return out


def test_equals_the_recursive_rule_and_resumes(spark, tmp_path):
    areas = [("a", 47.0, 5.0, 48.25, 6.0), ("b", 50.0, 8.0, 50.5, 8.5), ("none", 1.0, 1.0, 1.0, 2.0)]
    known = {}

    def complete(box):
        return known.setdefault(box, random.Random(str(box)).random() < 0.4)

    want = recursive(areas, complete, 0.5, 2)
    answers = spark.createDataFrame([(*b, ok) for b, ok in known.items()], "south double, west double, north double, east double, complete boolean")
    df = spark.createDataFrame(areas, "area string, south double, west double, north double, east double")
    table = VersionedTable(spark, str(tmp_path / "cursor"), tiles.CURSOR)
    first = tiles.inventory(df, answers, table, rounds=1)
    assert first.filter("depth = 1 and state = 'pending'").count() > 0
    got = tiles.inventory(df, answers, table)  # from the stored cursor
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    versions = len(table._versions())
    assert tiles.inventory(df, answers, table).count() == len(want) and len(table._versions()) == versions


def test_tiles_without_an_answer_stay_pending(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.5, 1.0)], "area string, south double, west double, north double, east double")
    answers = spark.createDataFrame([(0.0, 0.0, 0.5, 0.5, True), (0.0, 0.0, 0.5, 0.5, False)], "south double, west double, north double, east double, complete boolean")
    table = VersionedTable(spark, str(tmp_path / "c"), tiles.CURSOR)
    assert sorted(r.state for r in tiles.inventory(df, answers, table).collect()) == ["done", "pending"]
    later = answers.union(spark.createDataFrame([(0.0, 0.5, 0.5, 1.0, True)], answers.schema))
    assert tiles.inventory(df, later, table).filter(F.col("state") == "done").count() == 2


def test_answers_that_explode_out_of_few_rows_are_not_broadcast(spark, tmp_path):
    areas = spark.range(50).select(F.col("id").cast("string").alias("area"), F.lit(0.0).alias("south"), (F.col("id") * 2.0).alias("west"), F.lit(0.75).alias("north"), (F.col("id") * 2.0 + 1).alias("east"))
    first = tiles.first_tiles(areas)
    answers = first.select("south", "west", "north", "east", F.lit(True).alias("complete"))
    plan = tiles.advance(first, answers)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
