"""The corpus pipeline: documents in a known language, near-duplicates and benchmark leaks out, personal data masked, sources mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Defined cases: where ids repeat or are missing, rows are told apart by all their columns; rows equal in all columns are copies and leave one.
Null texts and texts without letters go in the first stage, as of no language; empty tables give empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import decontam, langid, minhash, mixing, pii
from vacantia.operators.storage import checkpoint, drop

#: No stage sequence in SQL: the language models' estimates and the hashed sample depend on the corpus that earlier stages leave.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row: the id where all rows have their own, else a digest of the whole row, so that only equal rows share one."""
    if not minhash.repeats(docs, "doc_id") and docs.filter("doc_id is null").isEmpty():
        return docs.withColumn("__key", F.col("doc_id"))
    return docs.withColumn("__key", F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the language models are learned from the labelled documents themselves."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    judged = langid.identify(docs, langid.learn(docs), keep=others)
    return judged.filter("not rejected").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id (rows without an id last), once if it is repeated."""
    keyed = _keyed(docs)
    found = minhash.near_duplicates(keyed, id_col="__key")
    if keyed.schema["__key"].dataType == docs.schema["doc_id"].dataType:
        return keyed.join(found.filter("kept").select("__key"), "__key", "left_semi").select(docs.columns)
    groups = keyed.select("__key", "doc_id").join(found.select("__key", "component_id").distinct(), "__key")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("first")).select(F.col("first.__key").alias("__key"))
    return keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of ten consecutive words of a benchmark item."""
    keyed = _keyed(docs)
    found = decontam.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key")
    return keyed.join(found.filter("contaminated").select("__key"), "__key", "left_anti").select(docs.columns)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each taken document once for each copy (``epoch`` from 1), with the sizes and targets of the mixing."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    mixed = mixing.mix_sources(docs, keep=others).filter("copies > 0")
    return mixed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns, "size", "source_size", "target", "epoch")


STAGES = [("language id", language), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("pii", mask), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on all its predecessor kept; a stage's table goes once the next stage is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
