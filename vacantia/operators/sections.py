"""Sections of postings and profiles as units for embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import requirements, strings
from vacantia.operators.relational import once_per_value

#: Characters of a chunk; chunks of a posting and of a profile; scopes and wordings that say nothing about requirements (fixed values).
CHUNK, POSTING_CHUNKS, PROFILE_CHUNKS = 900, 12, 8
LEFT_OUT = ("benefits", "optional")
ABOUT_THE_EMPLOYER = (
    "we have", "our company", "our team", "we offer", "benefits", "perks", "you receive", "you get", "you can take", "we provide you with", "du erhältst", "sie erhalten", "wir bieten", "unser unternehmen", "unsere firma",
    r"seit \d{4}", "common among our clients", "spoken by our clients", "our clients speak", "our customers speak", "our team speaks",
)


def bounded(sentences: DataFrame, *, id_col: str, limit: int, chunk: int = CHUNK) -> DataFrame:
    """(id_col, n, source, scope, text): sentences (id_col, source, source_rank, scope, place, sentence) packed into chunks of whole words.

    A bucket is a source and scope; buckets stand in the order of their first sentence.  Each gives its first chunk, then its last, then the
    others, in turn with the other buckets, until ``limit`` different texts are found.  Repeated sentences of a bucket count once; a word
    longer than a chunk is cut into pieces.
    """
    once = sentences.groupBy(id_col, "source", "scope", "sentence").agg(F.min(F.struct("source_rank", "place")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "sentence")))
    buckets = once.groupBy(id_col, "source", "scope").agg(F.min("at").alias("first"), ordered.alias("all"))
    text = F.regexp_replace(F.array_join(F.transform("all", lambda x: x["sentence"]), " "), rf"(\S{{{chunk}}})(?=\S)", "$1 ")
    packed = buckets.select(id_col, "source", "scope", "first", strings.pack_words(text, chunk).alias("packed"))
    chunks = packed.select(id_col, "source", "scope", "first", F.posexplode_outer("packed").alias("pos", "text"), F.size("packed").alias("size")).filter("pos is not null")
    turn = F.when(F.col("pos") == 0, 0).when(F.col("pos") == F.col("size") - 1, 1).otherwise(F.col("pos") + 1)
    chunks = chunks.withColumn("at", F.struct(turn.alias("turn"), F.col("first"), F.col("scope")))
    # One text's chunks a window: bounded by the text, not by the table.
    new = chunks.groupBy(id_col, "text").agg(F.min_by(F.struct("source", "scope"), "at").alias("from"), F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy(id_col).orderBy("at"))
    return new.withColumn("n", n).filter(F.col("n") <= limit).select(id_col, "n", "from.source", "from.scope", "text")


def _sentences(texts: DataFrame, id_col: str) -> DataFrame:
    """The sentences of texts (id_col, source, source_rank, text), with scope and place; each distinct text is read once."""
    read = once_per_value(texts, ["text"], __s=requirements.sections(F.col("text")))
    # Outer, for Spark lays a filter on an inner one's array below, which would read each text again.
    rows = read.select(id_col, "source", "source_rank", F.posexplode_outer("__s").alias("place", "s")).filter("s is not null")
    return rows.select(id_col, "source", "source_rank", "place", "s.scope", "s.sentence")


def posting_sections(texts: DataFrame, *, id_col: str, limit: int = POSTING_CHUNKS) -> DataFrame:
    """Chunks of what a posting asks for: no benefits or options, nothing about the employer, no sentence under four words."""
    about = r"(?iu)(?<!\w)(?:" + "|".join(ABOUT_THE_EMPLOYER) + r")(?!\w)"
    s = _sentences(texts, id_col).filter(~F.col("scope").isin(*LEFT_OUT) & ~F.col("sentence").rlike(about) & (F.regexp_count("sentence", F.lit(r"\S+")) >= 4))
    return bounded(s, id_col=id_col, limit=limit)


def profile_sections(texts: DataFrame, skills: DataFrame, *, id_col: str, limit: int = PROFILE_CHUNKS) -> DataFrame:
    """Chunks of a profile: its skills (id_col, skills array<string>) as one sentence, then the sentences of each text as experience."""
    listed = skills.filter(F.size("skills") > 0).select(
        id_col, F.lit("skills").alias("source"), F.lit(-1).alias("source_rank"), F.lit(0).alias("place"), F.lit("capabilities").alias("scope"), F.concat(F.lit("Skills: "), F.array_join("skills", ", ")).alias("sentence")
    )
    return bounded(_sentences(texts, id_col).withColumn("scope", F.lit("experience")).unionByName(listed), id_col=id_col, limit=limit)
