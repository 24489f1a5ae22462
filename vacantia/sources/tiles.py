"""Tiles of a map inventory: a quadtree that splits what a source cannot answer whole.

A tile is a box with a depth; one that was answered incompletely is split into its four quarters, down to ``MOST`` splits.
The cursor is a table of tiles with their states, written after each round: a stopped inventory goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.geo import quadrants
from vacantia.sources.feeds import state_tiles
from vacantia.streaming.queues import VersionedTable

#: Degrees of a first tile, and splits of it.
SIZE, MOST = 0.5, 2
CURSOR = "area string, south double, west double, north double, east double, depth int, state string"


def first_tiles(areas: DataFrame, size: float = SIZE) -> DataFrame:
    """``CURSOR`` rows of the grids that cover the areas' boxes (area, south, west, north, east), the last row and column cut at the edge; boxes without extent have no tile."""
    boxes = areas.filter("north > south and east > west").select(F.col("area").alias("state"), *[F.col(c).cast("double").alias(c) for c in ("south", "west", "north", "east")])
    return state_tiles(boxes, size=size).select(F.col("state").alias("area"), "south", "west", "north", "east", F.lit(0).alias("depth"), F.lit("pending").alias("state"))


def advance(cursor: DataFrame, answers: DataFrame, most: int = MOST) -> DataFrame:
    """The cursor after all pending tiles were looked up in ``answers`` (south, west, north, east, complete).

    Complete tiles are ``done``; incomplete ones give four pending quarters and are ``split``, at depth ``most`` they are ``failed`` and keep
    nothing; tiles without an answer stay pending.  An answer given twice counts as complete if one is.
    """
    box = ["south", "west", "north", "east"]
    # Boxes grow out of few rows by ``explode``, which the planner takes for small: it would broadcast them without the hint.
    known = answers.groupBy(*box).agg(F.max("complete").alias("complete")).hint("merge")
    waiting = cursor.filter("state = 'pending'").join(known, box, "left")
    state = F.when(F.col("complete"), "done").when(F.col("complete").isNull(), "pending").when(F.col("depth") >= most, "failed").otherwise("split")
    told = waiting.withColumn("state", state).select(cursor.columns)
    quarters = told.filter("state = 'split'").select("area", F.explode(quadrants(*map(F.col, box))).alias("q"), F.col("depth") + 1, F.lit("pending")).select("area", *[F.col(f"q.{c}").alias(c) for c in box], F.col("(depth + 1)").alias("depth"), F.col("pending").alias("state"))
    return cursor.filter("state <> 'pending'").unionByName(told).unionByName(quarters)


def inventory(areas: DataFrame, answers: DataFrame, table: VersionedTable, *, size: float = SIZE, most: int = MOST, rounds: int | None = None) -> DataFrame:
    """Rounds of ``advance`` from the stored cursor, or from the first tiles, until nothing changes (``most`` + 1 rounds, fewer if ``rounds`` says so).

    Each round is one version of ``table``; calling again goes on with the newest, and looks again only at what is pending.
    """
    number = (table._versions() or [-1])[-1]
    if number < 0:
        number = 0
        table.write(first_tiles(areas, size), number)
    for _ in range(most + 1 if rounds is None else rounds):
        now = table.read()
        open_ = now.filter("state = 'pending'").join(answers.hint("merge"), ["south", "west", "north", "east"], "left_semi")
        if open_.isEmpty():
            break
        number += 1
        table.write(advance(now, answers, most), number)
    return table.read()
