"""Near-duplicate groups by min-max hashing.

Each of ``permutations`` hash functions is evaluated once per shingle and gives
two signature values, its minimum and its maximum over the document, so a
signature of 2 * permutations values costs half the evaluations of plain
MinHash.  Minima and maxima each agree with probability equal to the Jaccard
similarity; bands of ``rows`` values give candidate buckets.

1. Documents with equal shingle sets collapse to their smallest id (a keyed
   aggregate, so thousands of copies are combined before the shuffle).
2. Representatives meet in band buckets.  Each bucket compares all its members
   with its two smallest ids on full shingle sets.
3. Buckets whose other members still belong to several components are finished
   exactly: members in blocks of ``BLOCK`` (fewer if their sets are large), every
   pair of blocks one task, which looks each set up in an inverted index and
   returns only links that join components.
4. Links become components by star contraction; classes get their members back.

Defined cases: a document without text or words has no shingles and is alone; a
row without id is linked with nothing (null component, kept); rows that share an
id are one node; columns other than id and text are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm._text import SPACED, U64, mix, slices, words
from vacantia.operators.components import connected_components
from vacantia.operators.storage import checkpoint, drop

#: Members of a bucket that one task compares with as many others, and the shingles of one such block.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
SEED = 77

_SIGNED = "id {}, n bigint, k1 bigint, k2 bigint, bands array<bigint>"
_SETS = "id {}, n bigint, shingles array<bigint>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a text of fewer words is one shingle."""
    w = words(data, offsets, SPACED)
    grown = w.hashes.copy()
    for k in range(1, width):
        grown = mix(grown[:-1] * U64(0x9E3779B97F4A7C15) + w.hashes[k:]) if len(grown) > 1 else grown[:0]
    sets = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= width:
            sets.append(np.unique(grown[a : b - width + 1]))
        elif b > a:
            h = w.hashes[a : a + 1]
            for k in range(1, b - a):
                h = mix(h * U64(0x9E3779B97F4A7C15) + w.hashes[a + k : a + k + 1])
            sets.append(mix(h + U64(int(b - a))))  # short sequences of different lengths stay apart
        else:
            sets.append(grown[:0])
    return sets


def _signer(width: int, permutations: int, rows: int):
    rng = np.random.Generator(np.random.PCG64(SEED))
    flip = rng.integers(0, 2**63, permutations, dtype=np.uint64)
    times = rng.integers(0, 2**62, permutations, dtype=np.uint64) * U64(2) + U64(1)

    def bands(sets: list[np.ndarray]) -> np.ndarray:
        x, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        lowest = np.empty((permutations, len(sets)), dtype=np.uint64)
        highest = np.empty_like(lowest)
        for k in range(permutations):
            h = (x ^ flip[k]) * times[k]
            lowest[k], highest[k] = np.minimum.reduceat(h, first), np.maximum.reduceat(h, first)
        signature = np.concatenate([lowest, highest])
        out = np.empty((len(signature) // rows, len(sets)), dtype=np.uint64)
        for b in range(len(out)):
            key = np.full(len(sets), U64(b + 1))
            for value in signature[b * rows : (b + 1) * rows]:
                key = mix(key * U64(0x9E3779B97F4A7C15) + value)
            out[b] = key
        return out.T

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = 2 * permutations // rows
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in slices(batch.column(1), 1 << 19):
                sets = shingle_sets(data, offsets, width)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(size)
                keys = np.zeros((2, len(sets)), dtype=np.uint64)
                table = np.zeros((len(sets), per), dtype=np.uint64)
                if len(some):
                    full = [sets[i] for i in some]
                    first, x = np.cumsum([0, *map(len, full[:-1])]), np.concatenate(full)
                    keys[0, some] = np.add.reduceat(mix(x), first)
                    keys[1, some] = np.add.reduceat(mix(x ^ U64(0xA5A5A5A5A5A5A5A5)), first)
                    table[some] = bands(full)
                held = np.where(size > 0, per, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), pa.array(table[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(size), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists],
                    names=["id", "n", "k1", "k2", "bands"],
                )

    return sign


def _setter(width: int):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), 1 << 19):
                sets = shingle_sets(data, offsets, width)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), lists], names=["id", "n", "shingles"])

    return sets_of


def _finisher(num: int, den: int):
    """Links within a bucket (or between two of its blocks) that join components not known to be joined."""

    def finish(table: pa.Table) -> pa.Table:
        ids = table["id"].combine_chunks()
        flat = table["shingles"].combine_chunks()
        lists = flat if isinstance(flat, pa.ListArray) else flat.chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), size)
        order = np.argsort(values, kind="stable")
        values_sorted, owner_sorted = values[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], values_sorted[1:] != values_sorted[:-1]])) if len(values_sorted) else np.empty(0, dtype=np.int64)
        group = np.empty(len(values), dtype=np.int64)
        group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(values_sorted))))
        stop = np.append(begin[1:], len(values_sorted))
        label = table["component"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
        heads, left, right = np.concatenate([[0], np.cumsum(size)]), [], []
        for i in range(len(ids)):
            mine = group[heads[i] : heads[i + 1]]
            mine = mine[stop[mine] - begin[mine] > 1]
            if not len(mine):  # shares nothing
                continue
            shared = np.bincount(np.concatenate([owner_sorted[begin[g] : stop[g]] for g in mine]), minlength=len(ids))
            near = den * shared >= num * (size[i] + size - shared)
            while len(others := np.flatnonzero(near & (label != label[i]))):
                j = others[0]
                left.append(i)
                right.append(int(j))
                label[label == label[j]] = label[i]
        return pa.table({"src": ids.take(pa.array(left, pa.int64())), "dst": ids.take(pa.array(right, pa.int64()))})

    return finish


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = 80, permutations: int = 64, rows: int = 4) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of ``docs``.

    ``similarity`` is a percentage: two documents are linked if 100 * shared >= similarity * union of their
    distinct ``width``-word shingles.  With the default 32 bands of 4 values a pair at 80 % meets in
    no bucket with probability 5e-8.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = checkpoint(text.mapInArrow(_signer(width, permutations, rows), _SIGNED.format(kind)), "minmax")
    real = signed.filter("n > 0 and id is not null")
    classes = real.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"))
    banded = real.join(classes.select(F.col("rep").alias("id"), "k1", "k2", "n"), ["id", "k1", "k2", "n"], "left_semi")
    member = banded.select("id", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("c1")).filter("m > 1")
    member = checkpoint(member.join(shared, "bucket"), "buckets")
    second = member.filter("id > c1").groupBy("bucket").agg(F.min("id").alias("c2"))
    pairs = member.filter("id > c1").select(F.col("c1").alias("a"), F.col("id").alias("b"))
    later = member.filter("m > 2").join(second, "bucket").filter("id > c2").select(F.col("c2").alias("a"), F.col("id").alias("b"))
    pairs = checkpoint(pairs.union(later).distinct(), "pairs")

    wanted = member.select("id").distinct()
    sets = text.join(wanted, "id", "left_semi").mapInArrow(_setter(width), _SETS.format(kind))
    if repeats(signed, "id"):
        sets = sets.dropDuplicates(["id", "shingles"])
    sets = checkpoint(sets, "sets")
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    fits = F.expr(f"100 * least(na, nb) >= {similarity} * greatest(na, nb)")
    met = pairs.join(left.drop("sa"), "a").join(right.drop("sb"), "b").filter(fits).select("a", "b")
    tested = met.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    links = checkpoint(tested.filter(f"100 * both >= {similarity} * (na + nb - both)").select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    found = checkpoint(connected_components(links), "components")

    named = member.filter("m > 3").join(second, "bucket").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # Pairs with either centre are tested: what is open lies between other members of different components.
    mixed = named.filter("id > c2").groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("others"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sum")).filter("lo <> hi")
    mixed = mixed.groupBy("others", "shingles", "sum").agg(F.min("bucket").alias("bucket"))  # the same members in several bands count once
    blocks = F.greatest(F.ceil(F.col("others") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    open_ = named.filter("id > c2").join(mixed, "bucket").select("bucket", "id", "component", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks")))
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "component"
    )
    closed = dealt.join(sets.select("id", "shingles"), "id").groupBy("bucket", "x", "y").applyInArrow(_finisher(similarity, 100), f"src {kind}, dst {kind}")
    more = checkpoint(closed, "links")
    final = found if more.isEmpty() else connected_components(links.union(more))
    for used in (member, pairs, sets, links, more):  # nothing below reads these again
        drop(used)
    back = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.join(back, ["k1", "k2", "n"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def repeats(rows: DataFrame, id_col: str) -> bool:
    """Whether any id stands on more than one row."""
    return not rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty()
