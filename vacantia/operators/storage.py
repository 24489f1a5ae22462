"""Intermediate tables in the folder that all executors share.

``checkpoint`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and
reads it back: lineage is cut, a lost executor only costs the tasks it ran, and
later stages read compressed columns.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; only a local-mode session without one gets a temporary folder of this process."""
    named = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="vacantia-"))


def checkpoint(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a written table; the files stay until the shared folder is cleaned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vacantia/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by ``checkpoint`` (once nothing reads it any more)."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name.rsplit("/", 1)[0])
        if "/vacantia/" in name:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
