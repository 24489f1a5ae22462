"""Dirty queues, closures and refreshes maintained by micro-batches.

State tables are Parquet folders named by batch: each micro-batch reads the
newest state, writes the next one and is repeatable, since a batch id always
reads the state before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def coalesced(changes: DataFrame, key: str, revision: str) -> DataFrame:
    """The newest revision of each key."""
    others = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*others), F.col(revision)).alias("r")).select(key, "r.*")


class VersionedTable:
    """A table with one folder a batch; ``read(before)`` gives the newest state older than a batch."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        found = [v for v in self._versions() if before is None or v < before]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")


def maintain(stream: DataFrame, table: VersionedTable, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint_dir: str):
    """Run ``step(state, batch) -> state`` over all that is there, then stop; returns the finished query."""

    def one(batch: DataFrame, batch_id: int) -> None:
        table.write(step(table.read(batch_id), batch), batch_id)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def apply_dirty(recompute: Callable[[DataFrame], DataFrame], key: str, revision: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Recompute the newest revision of each dirty key; results of older revisions than the state's are dropped."""

    def step(state: DataFrame, batch: DataFrame) -> DataFrame:
        fresh = recompute(coalesced(batch, key, revision))
        both = state.unionByName(fresh.select(state.columns))
        return coalesced(both, key, revision).select(state.columns)

    return step


def apply_scans(feed: str = "feed_id", key: str = "external_id") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Close postings that complete scans miss, reopen those that come back; a batch's scans are applied in order of their number.

    state: feed, key, is_active, misses, last_scan.  batch: feed, scan, complete, key (null key: an empty scan).
    """

    def step(state: DataFrame, batch: DataFrame) -> DataFrame:
        scans = batch.groupBy(feed, "scan").agg(F.max("complete").alias("complete"))
        known = state.select(feed, key).union(batch.filter(F.col(key).isNotNull()).select(feed, key)).distinct()
        # A posting's last sighting, and the complete scans after it, say all that the sequence of scans would.
        seen = batch.filter(F.col(key).isNotNull()).groupBy(feed, key).agg(F.max("scan").alias("seen"))
        rows = known.join(state, [feed, key], "left").join(seen, [feed, key], "left").withColumn("since", F.coalesce("seen", "last_scan", F.lit(-1)))
        after = scans.filter("complete").select(F.col(feed).alias("__f"), F.col("scan").alias("__s"))
        missed = rows.join(after, (F.col(feed) == F.col("__f")) & (F.col("__s") > F.col("since")), "left").groupBy(feed, key).agg(F.count("__s").alias("missed"), F.max("__s").alias("newest"))
        j = rows.join(missed, [feed, key])
        base = F.when(F.col("seen").isNotNull(), 0).otherwise(F.coalesce("misses", F.lit(0)))
        active = F.when(F.col("missed") > 0, False).when(F.col("seen").isNotNull(), True).otherwise(F.col("is_active"))
        return j.select(feed, key, active.alias("is_active"), (base + F.col("missed")).cast("int").alias("misses"), F.greatest("since", "newest").alias("last_scan"))

    return step


def debounced(requests: DataFrame, key: str, at: str, wait_s: int) -> DataFrame:
    """Refreshes to run: requests of a key within ``wait_s`` of each other become one, due ``wait_s`` after the last."""
    w = F.session_window(F.col(at).cast("timestamp"), f"{wait_s} seconds")
    return requests.groupBy(w.alias("w"), key).agg(F.count("*").alias("requests")).select(key, F.col("w.end").alias("due_at"), "requests")


def claimable(tasks: DataFrame, now: Column, *, limit: int) -> DataFrame:
    """Due tasks whose lease is free or has run out: high priority first, longest due first."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    return tasks.filter(free & (F.col("next_at") <= now)).orderBy(F.col("priority").desc(), F.col("next_at").asc_nulls_first(), "id").limit(limit)


def recover(tasks: DataFrame, now: Column, *, base_s: float, cap_s: float, most: int) -> DataFrame:
    """Tasks whose lease ran out go back to the queue with an exponential wait, or fail after ``most`` attempts."""
    from vacantia.functions.dates import backoff_seconds

    lost = (F.col("status") == "running") & (F.col("lease_until") <= now)
    wait = F.timestamp_micros(F.unix_micros(now) + (backoff_seconds(F.col("attempts"), base_s, cap_s) * 1_000_000).cast("bigint"))
    return tasks.withColumn("next_at", F.when(lost, wait).otherwise(F.col("next_at"))).withColumn("status", F.when(lost & (F.col("attempts") >= most), "failed").when(lost, "queued").otherwise(F.col("status"))).withColumn("lease_until", F.when(lost, None).otherwise(F.col("lease_until")))
