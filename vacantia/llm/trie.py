"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of a conversation's first turns (role and text).  It is named by its depth and the smallest
conversation that begins with it, which names one node at each depth.

1. Turns get their place by a range sort (as many ranges as a large conversation needs).
2. A prefix is known by the exclusive ors of two 64-bit hashes of each turn's digest and place: they add up in blocks of
   ``BLOCK`` turns and ``STEPS`` blocks, so no conversation is walked in one task.  Equal prefixes meet in one aggregate, combined before its shuffle.
3. Sums over subtrees come from a centroid decomposition of the parent edges.  In a component the centroid is the deepest node below which lies
   more than half of the component's weight (a node weighs its members, so no part keeps more than half).  What lies below
   the centroid is added up and goes to every node on the path from the centroid to the component's top; the weight on that path shrinks, the centroid leaves, and
   its children's parts and the rest are components of their own.  Every pair of a node and one below it is met exactly once: when
   the first centroid between them leaves.
   Whether a node is on such a path, and in which part it is, is one equi-join with the table of all prefixes, whatever the depth.
   Components of more than ``LOCAL`` nodes are cut by joins, all of a level at once; smaller ones are finished by tasks, each component in
   one, many components at a time.
4. The conversations that end at a node are range-sorted and spelled in pieces on all tasks; the digest itself, a chain by
   definition, streams over a node's pieces in constant memory.

Defined cases: rows without a conversation id belong to no conversation and are left out; a null role or text is empty; turns of
equal number are ordered by their SHA-256, repeated ones are turns of their own; conversations without turns end at the root; no
conversation gives no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.storage import checkpoint, drop

#: Turns whose hashes add up in one window, and blocks in the next.
BLOCK, STEPS = 512, 1024
#: Nodes of a component that one task finishes.
LOCAL = 2048
#: Bytes of a piece of spelled ids.
PIECE = 1 << 20


def turns_of(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, bytes, length): every turn with its place from 0, its digest, and its conversation's number of turns."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    spelled = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    t = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.unhex(F.sha2(spelled, 256)).alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    # Equal rows are told apart by where they were read, so that they need not share a range.
    t = t.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order)
    t = checkpoint(t.select("conv", "digest", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "trie-turns")
    whole = Window.partitionBy("conv")  # one row for each range that the conversation reaches
    ahead = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = t.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.select("conv", "part", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(whole).alias("length"))
    return t.join(runs, ["conv", "part"]).select("conv", (F.col("ahead") + F.col("at") - F.col("first")).alias("place"), "digest", "bytes", "length")


def lengths_of(turns: DataFrame) -> DataFrame:
    """(conv, length) of the conversations that have turns."""
    return turns.filter("place = 0").select("conv", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, bytes, length): each conversation's prefixes by their hashes."""
    t = turns.select(
        "conv", "place", "bytes", "length", F.floor(F.col("place") / BLOCK).alias("block"),
        F.xxhash64(F.lit(1), "digest", "place").alias("a"), F.xxhash64(F.lit(2), "place", "digest").alias("b"),
    )
    inner = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0)).cast("bigint")
    long = t.filter(F.col("length") > BLOCK)
    blocks = long.groupBy("conv", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).withColumn("step", F.floor(F.col("block") / STEPS))
    steps = blocks.groupBy("conv", "step").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    steps = steps.select("conv", "step", *[xor(c, before(["conv"], "step")).alias(f"step_{c}") for c in "ab"])
    blocks = blocks.select("conv", "block", "step", *[xor(c, before(["conv", "step"], "block")).alias(f"block_{c}") for c in "ab"]).join(steps, ["conv", "step"])
    offsets = blocks.select("conv", "block", *[F.col(f"block_{c}").bitwiseXOR(F.col(f"step_{c}")).alias(f"off_{c}") for c in "ab"])
    summed = t.select("conv", "place", "bytes", "length", "block", *[F.bit_xor(c).over(inner).alias(c) for c in "ab"])
    joined = summed.join(offsets, ["conv", "block"], "left")
    return joined.select("conv", (F.col("place") + 1).alias("depth"), *[F.col(c).bitwiseXOR(F.coalesce(f"off_{c}", F.lit(0).cast("bigint"))).alias(c) for c in "ab"], "bytes", "length")


def _jumped(up: np.ndarray) -> np.ndarray:
    """The top above each node, by pointer doubling; tops point to themselves."""
    while True:
        further = up[up]
        if np.array_equal(further, up):
            return up
        up = further


def centroid_rollup(parent: np.ndarray, depth: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Subtree sums of the rows of ``weights`` in a forest (parent -1 at tops); ``size`` is any positive weight's subtree sum.

    All components lose their centroid in the same round.
    """
    out = np.zeros_like(weights)
    ids = np.arange(len(parent))
    size, weights = size.copy(), weights
    while len(ids):
        n = len(ids)
        own = np.arange(n)
        up = np.where(parent < 0, own, parent)
        top = _jumped(up)
        heavy = np.flatnonzero(2 * size > size[top])
        heavy = heavy[np.lexsort((depth[heavy], top[heavy]))]
        c = heavy[np.append(top[heavy][1:] != top[heavy][:-1], True)]  # the deepest of each component
        cut = up.copy()
        cut[c] = c
        below = _jumped(cut)
        is_c = np.zeros(n, dtype=bool)
        is_c[c] = True
        inside = np.flatnonzero(is_c[below])
        total = np.zeros_like(weights)
        np.add.at(total, below[inside], weights[inside])
        at, start = c, c
        while len(at):  # from the centroids to their tops
            out[ids[at]] += total[start]
            higher = parent[at]
            on = higher >= 0
            at, start = higher[on], start[on]
            size[at] -= size[start]
        left = np.flatnonzero(~is_c)
        place = np.full(n + 1, -1)
        place[left] = np.arange(len(left))
        above = parent[left]
        parent = np.where((above >= 0) & ~is_c[above], place[above], -1)
        ids, depth, size, weights = ids[left], depth[left], size[left], weights[left]
    return out


_NODE = "conv bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, size bigint, leaf bigint, saved bigint, n_leaves bigint, saved_tokens bigint, top_conv bigint, top_depth bigint"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of components that come one after the other; the last of a batch waits for its rest."""

    def of(table: pa.Table) -> pa.RecordBatch:
        col = {c: table.column(c).to_numpy() for c in table.column_names if c != "parent"}
        conv, depth = col["conv"], col["depth"]
        parent = table.column("parent").fill_null(0).to_numpy()
        known = np.unique(conv)
        span = int(depth.max()) + 2
        key = np.searchsorted(known, conv) * span + depth
        order = np.argsort(key)
        rank = np.minimum(np.searchsorted(known, parent), len(known) - 1)
        wanted = np.where((known[rank] == parent) & (depth > 0), rank * span + depth - 1, -1)
        at = order[np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)]
        there = (key[at] == wanted) & (col["top_conv"][at] == col["top_conv"]) & (col["top_depth"][at] == col["top_depth"])
        sums = centroid_rollup(np.where(there, at, -1), depth, col["size"], np.stack([col["leaf"], col["saved"]], axis=1))
        for k, c in enumerate(("n_leaves", "saved_tokens")):
            table = table.set_column(table.column_names.index(c), c, pa.array(col[c] + sums[:, k]))
        return table.combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tops = np.stack([batch.column(batch.schema.names.index(c)).to_numpy() for c in ("top_conv", "top_depth")])
        changes = np.flatnonzero((tops[:, 1:] != tops[:, :-1]).any(axis=0)) + 1
        last = held[-1] if held else None
        same = last is not None and all(last.column(last.schema.names.index(c))[-1].as_py() == tops[k, 0] for k, c in enumerate(("top_conv", "top_depth")))
        stop = int(changes[-1]) if len(changes) else 0  # where the batch's last component begins
        if stop or (held and not same):
            yield of(pa.Table.from_batches([*held, batch.slice(0, stop)]))
            held = []
        held.append(batch.slice(stop))
    if held:
        yield of(pa.Table.from_batches(held))


def _rolled_up(nodes: DataFrame, prefixes: DataFrame, local: int) -> DataFrame:
    """``nodes`` (``_NODE``) with n_leaves and saved_tokens summed over their subtrees."""
    parts: list[DataFrame] = []
    names = [x.split()[0] for x in _NODE.split(", ")]
    comp = ["top_conv", "top_depth"]
    active, written = nodes, []
    look = prefixes.select(F.col("conv").alias("look_conv"), F.col("depth").alias("look_depth"), F.col("owner").alias("there"), F.col("parent").alias("there_parent"))
    while True:
        large = checkpoint(active.groupBy(*comp).agg(F.count("*").alias("nodes"), F.max("size").alias("whole")).filter(F.col("nodes") > local).drop("nodes"), "trie-large")
        if large.isEmpty():
            parts.append(active)
            drop(large)
            break
        parts.append(active.join(large, comp, "left_anti"))
        cut = active.join(large, comp)
        centre = F.max_by(F.struct(F.col("conv").alias("c_conv"), F.col("depth").alias("c_depth"), F.col("size").alias("c_size")), "depth")
        centroids = checkpoint(cut.filter(2 * F.col("size") > F.col("whole")).groupBy(*comp).agg(centre.alias("c")).select(*comp, "c.*"), "trie-centroids")
        cut = active.join(centroids, comp)
        # On the path upwards the centroid's conversation is asked for the node's depth, below it the node's for the depth under the centroid.
        over = F.col("depth") <= F.col("c_depth")
        cut = cut.withColumn("look_conv", F.when(over, F.col("c_conv")).otherwise(F.col("conv"))).withColumn("look_depth", F.when(over, F.col("depth")).otherwise(F.col("c_depth") + 1))
        cut = cut.join(look, ["look_conv", "look_depth"], "left")
        centroid = (F.col("depth") == F.col("c_depth")) & (F.col("conv") == F.col("c_conv"))
        place = F.when(centroid, F.lit("c")).when(over & ((F.col("depth") == 0) | (F.col("there") == F.col("conv"))) & (F.col("depth") < F.col("c_depth")), F.lit("path")).when(~over & (F.col("there_parent") == F.col("c_conv")), F.lit("below"))
        labelled = checkpoint(cut.select(*names, "c_depth", "c_size", "there", place.alias("where")), "trie-level")
        totals = checkpoint(labelled.filter("where in ('c', 'below')").groupBy(*comp).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved")), "trie-totals")
        written += [large, centroids, labelled, totals]
        climbed, below = F.col("where").isin("c", "path"), F.col("where") == "below"
        grown = labelled.join(totals, comp).withColumns({
            "n_leaves": F.when(climbed, F.col("n_leaves") + F.col("t_leaf")).otherwise(F.col("n_leaves")), "saved_tokens": F.when(climbed, F.col("saved_tokens") + F.col("t_saved")).otherwise(F.col("saved_tokens")),
            "size": F.when(F.col("where") == "path", F.col("size") - F.col("c_size")).otherwise(F.col("size")),
            "top_conv": F.when(below, F.col("there")).otherwise(F.col("top_conv")), "top_depth": F.when(below, F.col("c_depth") + 1).otherwise(F.col("top_depth")),
        })
        parts.append(grown.filter("where = 'c'").select(*names).withColumns({"leaf": F.lit(0).cast("bigint"), "saved": F.lit(0).cast("bigint"), "top_conv": F.col("conv"), "top_depth": F.col("depth")}))
        active = grown.filter(F.col("where").isNull() | (F.col("where") != "c")).select(*names)
    rest = parts[0]
    for p in parts[1:]:
        rest = rest.unionByName(p)
    done = rest.repartition(*comp).sortWithinPartitions(*comp).select(*names).mapInArrow(_finish, _NODE)
    out = checkpoint(done.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens"), "trie-sums")
    for table in written:
        drop(table)
    return out


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (owner, depth, conv) as pieces of comma-joined ids."""
    for batch in batches:
        owner, depth, conv = (batch.column(k).to_numpy() for k in range(3))
        edges = [0, *(np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1).tolist(), len(owner)]
        cuts = [k for a, b in zip(edges[:-1], edges[1:], strict=True) for k in range(a, b, PIECE // 20)]
        ids = conv.tolist()
        text = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        if cuts:
            yield pa.RecordBatch.from_pydict({"owner": pa.array(owner[cuts]), "depth": pa.array(depth[cuts]), "first": pa.array(conv[cuts]), "text": pa.array(text, pa.string())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which come in order."""
    node, state = None, None
    for batch in batches:
        out = []
        for owner, depth, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (owner, depth) == node:
                state.update(b"," + text.encode())
                continue
            if node:
                out.append((*node, state.hexdigest()))
            node, state = (owner, depth), hashlib.sha256(text.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("owner", "depth", "sha"), map(list, zip(*out, strict=True)), strict=True)))
    if node:
        yield pa.RecordBatch.from_pydict({"owner": [node[0]], "depth": [node[1]], "sha": [state.hexdigest()]})


def _digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, sha) of the ids (owner, depth, conv) that end at a node."""
    order = ["owner", "depth", "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_spell, "owner bigint, depth bigint, first bigint, text string")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(_hashed, "owner bigint, depth bigint, sha string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, *, local: int = LOCAL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` as of ``turns_of``, ``conversations`` (conv, length) has every conversation once, those without turns with length 0.
    """
    facts = conversations.agg(F.min("conv").alias("root"), F.count("*").alias("n"), F.sum(F.col("length") + 1).alias("size"), F.max("length").alias("longest")).first()
    empty = hashlib.sha256(b"").hexdigest()
    if facts["root"] is None:
        return turns.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    root: Column = F.lit(facts["root"]).cast("bigint")
    rows = checkpoint(_prefixes(turns), "trie-prefixes")
    below = F.col("length") - F.col("depth") + 1
    groups = rows.groupBy("depth", "a", "b").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.sum(below).alias("size"), F.max("length").alias("longest"), F.max("bytes").alias("last_bytes"))
    met = rows.select("conv", "depth", "a", "b", "length").join(groups, ["depth", "a", "b"])
    own = F.col("conv") == F.col("owner")
    met = checkpoint(
        met.select(
            "conv", "depth", "owner", (F.col("length") == F.col("depth")).alias("ends"), F.when(own, F.col("n_convs")).alias("n_convs"), F.when(own, F.col("size")).alias("size"),
            F.when(own, (F.col("longest") == F.col("depth")).cast("bigint")).alias("leaf"), F.when(own, (F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved"),
        ), "trie-owners",
    )
    higher = met.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    paths = met.join(higher, ["conv", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, root).otherwise(F.col("parent")))
    paths = checkpoint(paths, "trie-paths")
    nodes = paths.filter(own).select("conv", "depth", "parent", "n_convs", "size", "leaf", "saved")
    zero = F.lit(0).cast("bigint")
    top = turns.sparkSession.range(1).select(
        root.alias("conv"), zero.alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.lit(facts["n"]).cast("bigint").alias("n_convs"), F.lit(facts["size"]).cast("bigint").alias("size"),
        F.lit(int(facts["longest"] == 0)).cast("bigint").alias("leaf"), zero.alias("saved"),
    )
    nodes = nodes.union(top)
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv", "depth"], "left").select(
        "conv", "depth", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "size", "leaf", "saved", zero.alias("n_leaves"), zero.alias("saved_tokens"), root.alias("top_conv"), zero.alias("top_depth")
    )
    nodes = checkpoint(nodes, "trie-nodes")
    sums = _rolled_up(nodes, paths, local)
    turnless = conversations.filter("length = 0").select(root.alias("owner"), zero.alias("depth"), "conv")
    digests = _digests(paths.filter("ends").select("owner", "depth", "conv").union(turnless))
    out = sums.join(digests.select(F.col("owner").alias("conv"), "depth", "sha"), ["conv", "depth"], "left")
    out = checkpoint(out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(empty)).alias("ends_sha256")), "trie")
    for table in (rows, met, paths, nodes, sums):
        drop(table)
    return out
