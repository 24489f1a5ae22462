"""Report files, and files held against a manifest of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """``df`` as CSV with a header or as JSON lines, one file a partition; nested columns become JSON text in CSV, nulls stay in JSON."""
    if kind == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        nested = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
        df.withColumns(nested).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError(f"a report is csv or json, not {kind}")


def read_report(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.json(path) if kind == "json" else reader.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, actual): the SHA-256 of each file below ``folder``, by its path in it; Spark's readers pass over empty files, so these are not there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    base = folder.rstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("file"), F.sha2("content", 256).alias("actual"))


def verify(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(file, state) of manifest (file, sha256) and of files that it does not name: ok, mismatch, missing (empty, too) or unlisted; a file listed twice must agree with both."""
    stated = manifest.groupBy("file").agg(F.min(F.lower("sha256")).alias("low"), F.max(F.lower("sha256")).alias("high"), F.lit(True).alias("listed"))
    j = stated.join(actual, "file", "full")
    same = F.coalesce((F.col("low") == F.col("actual")) & (F.col("high") == F.col("actual")), F.lit(False))
    return j.select("file", F.when(F.col("listed").isNull(), "unlisted").when(F.col("actual").isNull(), "missing").when(same, "ok").otherwise("mismatch").alias("state"))
