"""Inventory pages up to a high-water mark, and the queue of an embedding index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inventory_page(rows: DataFrame, owners: DataFrame, progress: DataFrame, now: Column, *, key: str, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """The next page (owner, key) of the owner that waits longest, and the progress after it.

    owners: owner, version.  progress: owner, version, cursor, high_water, advanced_at.  An owner without progress, or with another
    version, begins at 0 up to the largest key there is now; rows that come later are not its affair.  Owners not yet begun go
    first, then the one advanced longest ago, then the smallest.  Nothing to do gives an empty page and the progress as it was.
    Writing the page's results before the progress makes a step repeatable.
    """
    both = owners.join(progress.withColumnRenamed("version", "seen"), "owner", "left")
    current = F.col("seen").eqNullSafe(F.col("version"))
    waits = both.filter(~current | (F.col("cursor") < F.col("high_water")))
    # One row, read so that the page's bounds are literals and reach the scan.
    turn = waits.orderBy(F.col("advanced_at").isNotNull(), F.col("advanced_at").asc_nulls_first(), "owner").withColumn("goes_on", current).first()
    columns = ["owner", "version", "cursor", "high_water", "advanced_at"]
    if turn is None:
        return owners.select("owner").limit(0).crossJoin(rows.select(key).limit(0)), progress.select(columns)
    low, high = (turn.cursor, turn.high_water) if turn.goes_on else (0, rows.agg(F.max(key)).first()[0] or 0)
    page = rows.filter((F.col(key) > low) & (F.col(key) <= high)).select(F.lit(turn.owner).cast(owners.schema["owner"].dataType).alias("owner"), key).orderBy(key).limit(size)
    # A page that is not full has reached the mark.
    cursor = F.when(F.count("*") < size, F.lit(high)).otherwise(F.max(key)).cast("bigint")
    moved = page.agg(cursor.alias("cursor")).select(F.lit(turn.owner).alias("owner"), F.lit(turn.version).alias("version"), "cursor", F.lit(high).cast("bigint").alias("high_water"), now.alias("advanced_at"))
    return page, progress.filter(F.col("owner") != F.lit(turn.owner)).select(columns).unionByName(moved)


def claim_refreshes(queue: DataFrame, now: Column, token: str, *, lease_s: int, limit: int) -> DataFrame:
    """``queue`` (kind, id, queued_at, lease_token, lease_until) with a lease on the ``limit`` entries queued longest whose lease is free or over."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    mine = queue.filter(free).orderBy("queued_at", "kind", "id").limit(limit).select("kind", "id", F.lit(True).alias("__mine"))
    out = queue.join(F.broadcast(mine), ["kind", "id"], "left")  # at most ``limit`` rows
    until = F.timestamp_micros(F.unix_micros(now) + lease_s * 1_000_000)
    leased = {"lease_token": F.when(F.col("__mine"), token).otherwise(F.col("lease_token")), "lease_until": F.when(F.col("__mine"), until).otherwise(F.col("lease_until"))}
    return out.withColumns(leased).select(queue.columns)


def missing_vectors(entities: DataFrame, documents: DataFrame, queue: DataFrame, revision: str) -> DataFrame:
    """(kind, id) of entities with neither a vector of this model's revision nor an entry in the queue."""
    have = documents.filter(F.col("model_revision") == revision).select("kind", "id")
    return entities.select("kind", "id").join(have, ["kind", "id"], "left_anti").join(queue.select("kind", "id"), ["kind", "id"], "left_anti")


def backfill_batch(missing: DataFrame, limit: int) -> DataFrame:
    """``limit`` of the missing, from all kinds in turn by id, so that a kind with many rows does not keep the others waiting."""
    turn = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    return missing.withColumn("turn", turn).filter(F.col("turn") <= limit).orderBy("turn", F.col("kind").desc()).limit(limit).drop("turn")


def backfill_complete(kinds: DataFrame, missing: DataFrame, queue: DataFrame) -> DataFrame:
    """(kind, complete): nothing of the kind is missing or queued."""
    open_kinds = missing.select("kind").union(queue.select("kind")).distinct().withColumn("open", F.lit(True))
    return kinds.select("kind").distinct().join(open_kinds, "kind", "left").select("kind", F.col("open").isNull().alias("complete"))
