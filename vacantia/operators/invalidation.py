"""What a change of content makes stale: a cascade by content hash, and results keyed by the generation they were made in.

Owners are postings and profiles.  Their vectors and assessments name the hash of the content they were made from; the cascade
keeps those whose hash is still the owner's, and resets the match index of the profiles concerned.  A new generation begins
whenever the cascade changed anything, and results of an earlier one are no longer found.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    """SHA-256 over columns; null and empty differ, and so do the same texts in other columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, hash): owners whose content changed or that are gone (null hash); new owners are no change."""
    old = before.select(key, content_hash(*columns).alias("old"))
    new = after.select(key, content_hash(*columns).alias("hash"))
    return old.join(new, key, "left").filter(~F.col("old").eqNullSafe(F.col("hash"))).select(key, "hash")


@dataclass
class Cascade:
    """The dependent tables after a change, and the profiles whose match index begins anew."""

    vectors: DataFrame
    assessments: DataFrame
    profiles: DataFrame
    reset: DataFrame


def cascade(jobs: DataFrame, profiles: DataFrame, vectors: DataFrame, assessments: DataFrame) -> Cascade:
    """Drop what ``jobs`` and ``profiles`` (``changed``: id, hash) make stale.

    vectors: kind (job or profile), id, source_hash, ...  assessments: profile_id, job_id, ...  A vector of a changed owner stays only if it was already made from the new
    content; an assessment goes if either side changed.  Reset are the profiles that changed and those that lost an assessment.
    """
    owners = jobs.select(F.lit("job").alias("kind"), F.col("id"), "hash").unionByName(profiles.select(F.lit("profile").alias("kind"), "id", "hash"))
    # One join, by rows that are no longer so: a vector goes if its owner is gone or now has another hash than it was made from.
    v, o = vectors.alias("v"), owners.alias("o")
    stale = (F.col("v.kind") == F.col("o.kind")) & (F.col("v.id") == F.col("o.id")) & ~F.coalesce(F.col("o.hash") == F.col("v.source_hash"), F.lit(False))
    kept = v.join(o, stale, "left_anti").select(vectors.columns)
    by_job, by_profile = jobs.select(F.col("id").alias("job_id")), profiles.select(F.col("id").alias("profile_id"))
    live = assessments.join(by_job, "job_id", "left_anti").join(by_profile, "profile_id", "left_anti").select(assessments.columns)
    lost = assessments.join(by_job, "job_id", "left_semi").select("profile_id")
    return Cascade(kept, live, by_profile, by_profile.union(lost).distinct())


class Snapshots:
    """Results below ``path``, each found by the current generation and its criteria."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, *parts: str):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        at = jvm.Path("/".join((self.path, *parts)))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at, jvm

    def generation(self) -> int:
        fs, at, _ = self._fs("generations")
        return max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=0) if fs.exists(at) else 0

    def advance(self) -> int:
        """Begin the next generation; of two writers that do so at once each gets its own."""
        while True:
            number = self.generation() + 1
            fs, at, _ = self._fs("generations", str(number))
            if not fs.exists(at):
                try:
                    fs.create(at, False).close()
                    return number
                except Exception:  # another writer took the number
                    if not fs.exists(at):
                        raise

    def key(self, criteria: dict) -> str:
        """Criteria in any order give one key in a generation."""
        return hashlib.sha256(json.dumps([self.generation(), criteria], sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def get(self, criteria: dict, compute: Callable[[], DataFrame]) -> DataFrame:
        """The stored result of this generation, computed and stored whole if there is none."""
        name = self.key(criteria)
        fs, at, jvm = self._fs("results", name)
        if not fs.exists(at):
            draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
            compute().write.option("compression", "zstd").parquet(draft)
            fs.mkdirs(at.getParent())
            if not fs.exists(at):
                fs.rename(jvm.Path(draft), at)
        return self.spark.read.parquet(f"{self.path}/results/{name}")
