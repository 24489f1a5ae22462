"""A partitioned table whose partitions are replaced in one step.

Data lie in a folder for each write and partition; a manifest names the folders that make up a version.  A write first
puts its own folders in place and then creates the next manifest, which either exists whole or not at all: readers see the version
before or after, never half of one.  Folders outside the replaced range stay as they are, file by file.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PartitionedTable:
    """A table at ``path`` with partitions by the column ``by`` (whole numbers or dates); the manifest holds one entry a partition."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str):
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by

    def _fs(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        folder = jvm.Path(f"{self.path}/_versions")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder, jvm

    def version(self) -> int:
        """The newest version's number; -1 before the first write."""
        fs, folder, _ = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        """{"parts": [[value, folder]], "tokens": [...]} of a version."""
        version = self.version() if version is None else version
        if version < 0:
            return {"parts": [], "tokens": []}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{version}", wholetext=True).first()[0])

    def _commit(self, version: int, manifest: dict) -> None:
        """Create the manifest of ``version``; if another writer was first, this raises and the table is as that writer left it."""
        fs, folder, jvm = self._fs()
        draft = jvm.Path(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(folder)
        final = jvm.Path(folder, str(version))
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} was written by another writer")

    @staticmethod
    def _plain(value):
        return value.isoformat() if isinstance(value, dt.date) else value

    def replace(self, rows: DataFrame, low, high, token: str) -> int:
        """Replace all partitions with low <= value < high by ``rows``, which must lie in that range; returns the version.

        Partitions of the range without new rows go.  A ``token`` that is already part of the table's history changes nothing, so a repeated job
        is safe.  Rows outside the range, or without a value, raise ValueError before anything is written.
        """
        before = self.version()
        old = self.manifest(before)
        if token in old["tokens"]:
            return before
        value = F.col(self.by)
        if not rows.filter(value.isNull() | (value < F.lit(low)) | (value >= F.lit(high))).isEmpty():
            raise ValueError(f"rows outside of {low} <= {self.by} < {high}")
        # A large partition is dealt to several tasks, small ones are kept together.
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("__part", value.cast("string")).hint("rebalance", "__part").write.partitionBy("__part").option("compression", "zstd").parquet(folder)
        names = self.spark.read.parquet(folder).select("__part", self.by).groupBy("__part").agg(F.first(self.by).alias("v")).collect() if not rows.isEmpty() else []
        new = [[self._plain(r["v"]), f"{folder}/__part={self._plain(r['v'])}"] for r in names]
        a, b = self._plain(low), self._plain(high)
        kept = [p for p in old["parts"] if not a <= p[0] < b]
        self._commit(before + 1, {"parts": sorted(kept + new), "tokens": [*old["tokens"], token]})
        return before + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        folders = [f for _, f in self.manifest(version)["parts"]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
