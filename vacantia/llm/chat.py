"""Chat formatting by perspective rotation.

Every participant of a conversation gets a rendering in which that speaker is
the assistant and all others are named users; the loss mask covers the assistant's
words and the end marks after them.

Turns get their place in the conversation by a range sort of all turns and the counts of each range, so a
conversation that holds a third of all turns is never sorted in one task.  It is cut into chunks of ``CHUNK``
places.  A row is one chunk from one perspective; ``start`` is the chunk's first character in the whole
rendering, and the chunks of a perspective in order are that rendering.

Control marks in texts and names are escaped: ``<|`` becomes ``<\\|``, and each ``<``, backslashes, ``|`` gets one backslash more, so a
text cannot forge a turn, and taking one backslash off gives the text back.  Line breaks in names become spaces.

Defined cases: null text is empty; a null role is the speaker ``unknown``; turns are ordered by
number (null first), then role, then the text's SHA-256; repeated rows are repeated turns; a conversation of
system turns alone has no perspective and no rows; a null conversation id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.storage import checkpoint

#: Turns in a chunk, and chunks whose lengths are added up in one step.
CHUNK, STEPS = 64, 1024
SYSTEM = "system"
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """``text`` without control marks; see the module's docstring."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` with ``place``, their number from 0 within the conversation."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    # Equal rows are told apart by where they were read, so that they need not share a range.
    t = turns.withColumn("digest", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order)
    t = checkpoint(t.select("conv", "turn", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range that the conversation reaches
    firsts = t.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    firsts = firsts.select(F.col("conv").alias("f_conv"), F.col("part").alias("f_part"), "first", "ahead")
    same = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("part") == F.col("f_part"))
    return t.join(firsts, same).select("conv", "turn", "role", "text", (F.col("ahead") + F.col("at") - F.col("first")).alias("place"))


def rotate_perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, perspective, chunk, n_turns, start, rendered, mask) with mask array<struct<s, e>> in characters of ``rendered``."""
    t = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    speakers = t.filter(F.col("role") != SYSTEM).select("conv", F.col("role").alias("perspective")).distinct()
    chunks = _placed(t).groupBy("conv", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    # (header, body, own) of each turn as this perspective sees it
    seen = chunks.alias("c").join(speakers.alias("s"), F.col("c.conv").eqNullSafe(F.col("s.conv"))).select("c.conv", "perspective", "chunk", "turns")
    own = lambda x: x["role"] == F.col("perspective")
    name = lambda x: escape(F.translate(x["role"], "\r\n", "  "))
    head = lambda x: F.concat(F.lit(OPEN), F.when(own(x), F.lit("assistant")).when(x["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), name(x))), F.lit("\n"))
    seen = seen.withColumn("pieces", F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(escape(x["text"]), F.lit(CLOSE)).alias("body"), own(x).alias("own"))))
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
        F.when(x["own"], F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("s"), (a["at"] + F.length(x["head"]) + F.length(x["body"]) - 1).alias("e"))))).otherwise(a["mask"]).alias("mask"),
    )
    seen = seen.withColumn("walk", F.aggregate("pieces", F.struct(F.lit(0).alias("at"), none.alias("mask")), step))
    rendered = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "")
    out = seen.select("conv", "perspective", "chunk", F.size("turns").cast("bigint").alias("n_turns"), rendered.alias("rendered"), F.col("walk.at").cast("bigint").alias("length"), F.col("walk.mask").alias("mask"))
    # The offsets run over lengths alone, in steps of STEPS chunks and over the steps; the texts join back by chunk.
    lengths = out.select("conv", "perspective", "chunk", "length", F.floor(F.col("chunk") / STEPS).alias("step"))
    inner = Window.partitionBy("conv", "perspective", "step").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv", "perspective").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = lengths.groupBy("conv", "perspective", "step").agg(F.sum("length").alias("whole")).withColumn("ahead", F.coalesce(F.sum("whole").over(outer), F.lit(0)))
    within = lengths.withColumn("inside", F.coalesce(F.sum("length").over(inner), F.lit(0)))
    both = F.col("w.conv").eqNullSafe(F.col("t.conv")) & (F.col("w.perspective") == F.col("t.perspective")) & (F.col("w.step") == F.col("t.step"))
    starts = within.alias("w").join(steps.alias("t"), both).select("w.conv", "w.perspective", "chunk", (F.col("inside") + F.col("ahead")).alias("start"))
    same = F.col("o.conv").eqNullSafe(F.col("b.conv")) & (F.col("o.perspective") == F.col("b.perspective")) & (F.col("o.chunk") == F.col("b.chunk"))
    return out.alias("o").join(starts.alias("b"), same).select(F.col("o.conv").alias(conv_col), "o.perspective", "o.chunk", "n_turns", "start", "rendered", "mask")
