"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / q with u a hash of its id and q its quality
weight; the documents with the smallest keys of a source are a weighted sample
without replacement.  Keys fall into cells of a logarithmic grid, cell totals
are prefix-summed within the source, the one cell in which a budget ends is cut
into finer parts in the same way, and only the part in which it ends is ordered
document by document.  So a source that holds a third of all
rows is never sorted: its cells are combined map-side.

A source whose target is above its size first gives complete epochs; the rest of
the target is the fractional selection.

Defined cases: null text has no words and takes nothing; null sources are one
source, last in order; a document with a null id is drawn by its text (without text, as the empty string); equal rows tie and
are ordered by size and text hash (rows equal in these too are interchangeable); an empty table gives
an empty result; other columns pass through or are dropped as ``keep`` says.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.storage import checkpoint

WEIGHTS = (5, 2, 1)
#: Up to so many sources their plan (under 100 bytes a source) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Most copies of a document, and the most a target exceeds its source's size.
MAX_EPOCHS = 3
SEED = "mix"
#: Cells for each doubling of the key: a cell holds about 0.02 % of a source.
CELLS = 2048
#: Parts of the cell in which a budget ends: only the part in which it ends is ordered, some 5e-8 of a source.
PARTS = 4096


def quality(length: Column, size: Column) -> Column:
    """Quality weight from the mean length of words: 1 at 6 characters a word, 0.1 at least."""
    return F.when(size > 0, F.greatest(F.lit(0.1), 1 - F.abs(length / size - 6) / 12)).otherwise(F.lit(0.1))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row for each source.

    Shares by weight that exceed ``MAX_EPOCHS`` times a source's size stop there; the excess goes to the others by
    weight.  With sources in order of cap / weight, the common level of the others is the largest of
    (total - caps before) / (weights from here on).
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on: the single-partition windows order sources, not documents.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("each", (F.sum("source_size").over(whole) - F.col("cap_before")) / (F.sum("weight").over(whole) - F.col("weight_before")))
    return t.withColumn("level", F.max("each").over(whole)).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _narrow(rows: DataFrame, cell: str, few: bool) -> tuple[DataFrame, DataFrame]:
    """Rows on either side of the cell in which their source's budget ends (with ``more``), and the rows of that cell (with ``before`` moved to its start).

    ``rows`` have source, size, rest (the budget) and before (what is taken ahead of these rows).
    """
    running = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    cells = rows.groupBy("source", "rest", "before", cell).agg(F.sum("size").alias("in_cell")).withColumn("to_here", F.col("before") + F.sum("in_cell").over(running))
    last = F.when((F.col("to_here") - F.col("in_cell") < F.col("rest")) & (F.col("to_here") > F.col("rest")), F.struct(cell, (F.col("to_here") - F.col("in_cell")).alias("ahead")))
    full = F.max(F.when(F.col("to_here") <= F.col("rest"), F.col(cell)))
    plan = cells.groupBy(F.col("source").alias("p_source")).agg(F.max(last).alias("edge"), full.alias("full"))
    told = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    at_edge = F.coalesce(F.col(cell) == F.col(f"edge.{cell}"), F.lit(False))
    clear = told.filter(~at_edge).withColumn("more", F.coalesce(F.col(cell) <= F.col("full"), F.lit(False))).drop("edge", "full")
    return clear, told.filter(at_edge).withColumn("before", F.col("edge.ahead")).drop("edge", "full")


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) for each row, and the columns named in ``keep``.

    size is the number of words between ASCII white space, copies how often the mix takes the document, taken = size * copies.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(text_col), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), name)), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    base = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), size.alias("size"), F.length(text_col).alias("__length"), F.xxhash64(text_col).alias("__tie"), u.alias("__u"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    q = quality(F.col("__length"), F.col("size"))
    place = F.log2("key") * CELLS
    base = base.withColumn("key", -F.log("__u") / q).withColumn("cell", F.floor(place)).withColumn("part", F.floor((place - F.col("cell")) * PARTS)).drop("__length", "__u")
    base = checkpoint(base, "mix")

    targets = source_targets(base.select("source", "size"), weights)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))).otherwise(F.lit(0)).cast("bigint")
    targets = checkpoint(targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target", "epochs", "rest", F.lit(0).cast("bigint").alias("before"))

    rows = base.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    outside, cell = _narrow(rows, "cell", few)
    beside, part = _narrow(cell, "part", few)
    within = Window.partitionBy("source").orderBy("key", "__id", "size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("upto", F.col("before") + F.sum("size").over(within))
    part = part.withColumn("more", 2 * F.col("upto") - F.col("size") <= 2 * F.col("rest")).drop("upto")
    out = outside.unionByName(beside).unionByName(part).withColumn("copies", F.col("epochs") + F.col("more").cast("bigint"))
    return out.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *[F.col(f"__keep_{c}").alias(c) for c in keep])
