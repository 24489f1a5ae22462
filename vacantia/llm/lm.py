"""Language-model scores by deleted interpolation.

P(w | a b) = l3 c(a b w) / c(a b) + l2 c(b w) / c(b) + l1 c(w) / N + l0 / (V + 1), the weights depending on
the frequency (by powers of two) of the pair a b, or of the word b where the pair was not seen.  The weights come from
expectation-maximisation on deleted documents: one training fold whose own
occurrences are taken off all counts.  The final counts are those of the
whole training part.

Each task packs its documents into blocks of text.  A block sends its
distinct words, pairs and triples with their counts as packed rows (see ``_packed``)
to the ranges of the hash space; each range adds up the counts and answers every
block with the totals of the keys it asked for.  So texts are shuffled once and compressed,
keys once, and no task holds more than a block or a range.  EM runs on a histogram of
(context class, log counts), whose size is bounded by its
grid and not by the corpus.  Blocks times ranges is the number of packed rows: see README.

Pairs and triples have keys of 48 bits, so that fewer bytes are sent: among 10**12 distinct ones one in 280 shares its key
with another, among 10**10 one in 28,000.  Words have 64 bits.  Where keys are shared a triple may count more often than its
pair: estimates end at 1, in EM and in the scores, so no probability exceeds 1.

Training documents are scored with their own counts in, held-out ones without: scores of the two are not comparable.

Defined cases: null text is empty, and an empty text is scored by its end alone; a
null id counts as the empty string in the fold rule, ids may be of any type; equal rows count as often as they
stand there; other columns are ignored; with no training tokens all probability is uniform.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm._packed import cut, pack_counts, ranges, unpack_counts, unpack_keys
from vacantia.llm._text import SPACED, U64, mix, slices, utf8, words
from vacantia.operators.storage import checkpoint

#: Text of a block: grows with the square root of the corpus, so that blocks times ranges stays in proportion.
BLOCK_LEAST, BLOCK_MOST, BLOCK_ROOT = 14 << 20, 128 << 20, 400
#: Context classes of words: 0 for unseen contexts, then one for each power of two; those of pairs follow.
CLASSES = 40
#: Cells for each doubling of a probability in EM's histogram, and the last of them.
GRID, LAST = 2, 80
EM_ROUNDS = 40
HELD_OUT, DELETED, FOLDS = 2, 3, 7

_STEP = 0x9E3779B97F4A7C15
_END = mix(np.array([0x0E4D], dtype=np.uint64))[0]
#: Tokens of the documents that one resolved row holds (a longer document alone).
ROW_TOKENS = 1 << 17

_PACKED = "block bigint, ids array<{}>, folds binary, sizes array<bigint>, texts binary"
_SENT = "kind int, part int, block bigint, keys binary, fit binary, dev binary"
_ANSWER = "block bigint, kind int, part int, total binary, dev binary, types bigint"
_RESOLVED = "ids array<{}>, held_out array<boolean>, n_tokens array<bigint>, c1 binary, c2 binary, c3 binary, cells array<bigint>, weights array<bigint>, tokens bigint, types bigint, dev_tokens bigint"


def _resolved(kind: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("ids", pa.list_(kind)), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("c1", pa.binary()), ("c2", pa.binary()), ("c3", pa.binary())]
        + [("cells", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))]
        + [(n, pa.int64()) for n in ("tokens", "types", "dev_tokens")]
    )


def _packer(block_bytes: int):
    """Rows (id, fold, text) of a task as blocks of about ``block_bytes`` of text, numbered by task and place."""

    def pack(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = utf8(table["text"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)
            folds, texts = table["fold"].to_numpy().astype(np.int8).tobytes(), zstandard.compress(data.tobytes(), 6)
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + number]), one(table["id"]), pa.array([folds], pa.binary()), one(pa.array(np.diff(offsets))), pa.array([texts], pa.binary())], names=["block", "ids", "folds", "sizes", "texts"])

        for batch in batches:
            for lo, hi, data, _ in slices(batch.column(2), max(1, block_bytes // 16)):
                if held and size + len(data) > block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
                held.append(batch.slice(lo, hi - lo))
                size += len(data)
        if held:
            yield block()

    return pack


def _unpack(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts of a block, and their folds."""
    row = table.select(["folds", "sizes", "texts"]).to_pylist()[0]
    offsets = np.cumsum([0, *row["sizes"]])
    body = pa.py_buffer(zstandard.decompress(row["texts"]) if row["texts"] else b"")
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), body]), np.frombuffer(row["folds"], dtype=np.int8)


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends in order, and the number of tokens of each document."""
    hashes, counts = [], []
    for _, _, data, offsets in slices(text):
        w = words(data, offsets, SPACED)
        n = w.counts()
        all_ = np.full(len(w.hashes) + len(n), _END, dtype=np.uint64)
        all_[np.arange(len(w.hashes)) + np.repeat(np.arange(len(n)), n)] = w.hashes
        hashes.append(all_)
        counts.append(n + 1)
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _before(hashes: np.ndarray, counts: np.ndarray, steps: int) -> np.ndarray:
    """The token ``steps`` ahead of each; the end stands before each document."""
    out = np.concatenate([np.full(min(steps, len(hashes)), _END), hashes[:-steps]]) if len(hashes) else hashes
    first = np.cumsum(counts) - counts
    for k in range(steps):
        at = first[counts > k] + k
        out[at] = _END
    return out


def _keys(hashes: np.ndarray, counts: np.ndarray, kind: int) -> np.ndarray:
    """Key of each token alone (kind 0), with its predecessor (1), or with both its predecessors (2)."""
    if kind == 0:
        return mix(hashes ^ U64(0x51ED270B))
    pair = mix(_before(hashes, counts, 1) * U64(_STEP) + hashes)
    return pair & ~U64(0xFFFF) if kind == 1 else mix(_before(hashes, counts, 2) * U64(_STEP) + pair) & ~U64(0xFFFF)


def _counted(keys: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands in the fitting and in the deleted folds."""
    by = np.argsort(keys)
    keys, fold = keys[by], fold[by]
    del by
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    fit = np.add.reduceat((fold != DELETED) & (fold != HELD_OUT), first, dtype=np.int64)
    return keys[first], fit, np.add.reduceat(fold == DELETED, first, dtype=np.int64)


def _sender(parts: int, order: int):
    def send(table: pa.Table) -> pa.Table:
        text, folds = _unpack(table)
        hashes, counts = _tokens(text)
        fold = np.repeat(folds, counts)
        block = table["block"][0].as_py()
        rows = []
        for kind in range(order):
            keys, fit, dev = _counted(_keys(hashes, counts, kind), fold)
            rows += [(kind, part, block, blob, *more) for part, blob, more in cut(keys, [fit, dev], parts)]
        types = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "part", "block", "keys", "fit", "dev"), zip(*rows, strict=True), types, strict=True)})

    return send


def _merge(table: pa.Table) -> pa.Table:
    """Totals of a range's keys over all blocks, in each block's own order of keys."""
    keys = [unpack_keys(x) for x in table["keys"].to_pylist()]
    sizes = list(map(len, keys))
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    sums = {}
    for name in ("fit", "dev"):
        each = np.concatenate([unpack_counts(x, n) for x, n in zip(table[name].to_pylist(), sizes, strict=True)])
        sums[name] = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(sums[name], at, each)
    total = sums["fit"] + sums["dev"]
    bounds = np.cumsum([0, *sizes])
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    types = int(np.count_nonzero(total)) if kind == 0 else 0
    out = [(b, kind, part, pack_counts(total[at[i:j]]), pack_counts(sums["dev"][at[i:j]]), types if k == 0 else 0) for k, (b, i, j) in enumerate(zip(table["block"].to_pylist(), bounds[:-1], bounds[1:], strict=True))]
    kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 2 + [pa.int64()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "kind", "part", "total", "dev", "types"), zip(*out, strict=True), kinds, strict=True)})


def _level(p: np.ndarray) -> np.ndarray:
    """Cell of a probability on the logarithmic grid; 0 for 0."""
    return np.where(p > 0, 1 + np.minimum(np.rint(-np.log2(np.maximum(p, 1e-30)) * GRID), LAST - 1).astype(np.int64), 0)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, np.minimum(a / np.maximum(b, 1), 1.0), 0.0)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), CLASSES - 1), 0)


def _context_class(word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The class of a context from the counts of its word and of its pair."""
    return np.where(pair > 0, CLASSES + _bucket(pair), _bucket(word))


def _contexts(c1: np.ndarray, c2: np.ndarray, counts: np.ndarray, ends) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the word and of the pair ahead of each token; a document begins after an end, without a pair."""
    first = np.cumsum(counts) - counts
    word, pair = np.concatenate([c1[:1], c1[:-1]]), np.concatenate([c2[:1], c2[:-1]])
    word[first], pair[first] = ends, 0
    return word, pair


def _resolver(parts: int, order: int):
    def resolve(docs: pa.Table, answers: pa.Table) -> pa.Table:
        text, fold = _unpack(docs)
        hashes, counts = _tokens(text)
        mine = np.repeat(fold == DELETED, counts)
        own = counts[fold == DELETED]
        c, f = [], []  # all counts; counts without the deleted fold, at the deleted documents' tokens
        for kind in range(order):
            keys, at = np.unique(_keys(hashes, counts, kind), return_inverse=True)
            bounds = ranges(keys, parts)
            total, dev = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
            for row in answers.filter(pc.equal(answers["kind"], kind)).select(["part", "total", "dev"]).to_pylist():
                place = slice(bounds[row["part"]], bounds[row["part"] + 1])
                n = place.stop - place.start
                total[place], dev[place] = unpack_counts(row["total"], int(n)), unpack_counts(row["dev"], int(n))
            if kind == 0:
                end = _end_count(hashes, (total - dev)[at])
            c.append(total[at])
            f.append((total - dev)[at[mine]])
            del keys, at, total, dev
        if order == 2:
            c.append(np.zeros(len(c[0]), dtype=np.int64))
            f.append(np.zeros(len(f[0]), dtype=np.int64))
        word, pair = _contexts(f[0], f[1], own, end) if len(own) else (f[0], f[1])
        pair = pair if order == 3 else pair * 0
        cell = _context_class(word, pair)
        # Words stand by their count: the number of tokens is not known here.
        for level in (_level(_ratio(f[2], pair)), _level(_ratio(f[1], word)), _level(_ratio(np.ones(len(word)), f[0]))):
            cell = cell * 256 + level
        cells, weights = np.unique(cell, return_counts=True)
        stats = {"cells": cells, "weights": weights, "tokens": int(counts[fold != HELD_OUT].sum()), "types": sum(answers["types"].to_pylist()), "dev_tokens": int(own.sum())}
        ids = docs["ids"].combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        out, ends, lo = [stats], np.cumsum(counts), 0
        while lo < len(counts):
            first = ends[lo] - counts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, first + ROW_TOKENS, side="right")))
            at = slice(first, ends[hi - 1])
            out.append({"ids": ids[lo:hi].to_pylist(), "held_out": (fold[lo:hi] == HELD_OUT).tolist(), "n_tokens": counts[lo:hi], "c1": pack_counts(c[0][at]), "c2": pack_counts(c[1][at]), "c3": pack_counts(c[2][at])})
            lo = hi
        return pa.Table.from_pylist(out, schema=_resolved(ids.type))

    return resolve


def _end_count(hashes: np.ndarray, counts: np.ndarray) -> int:
    """The count of the end, which every block has."""
    at = np.flatnonzero(hashes == _END)
    return int(counts[at[0]]) if len(at) else 0


def learn_weights(cells: np.ndarray, weights: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Mixture weights (l3, l2, l1, l0) of each context class by EM on the deleted fold's histogram."""
    at = lambda k: (cells >> (8 * k)) & 255
    value = lambda level: np.where(level > 0, 2.0 ** (-(level - 1) / GRID), 0.0)
    once, pair, triple, kind = value(at(0)), value(at(1)), value(at(2)), cells >> 24
    p = np.stack([triple, pair, np.where(once > 0, 1 / np.maximum(once, 1e-30), 0) / max(tokens, 1), np.full(len(cells), 1 / (types + 1))])
    mixed = np.tile(np.array([[0.2], [0.3], [0.4], [0.1]]), (1, 2 * CLASSES))
    mixed[:, :CLASSES] = np.array([[0.0], [0.4], [0.5], [0.1]])
    mixed[:, 0] = 0, 0, 0.9, 0.1
    for _ in range(EM_ROUNDS):
        share = p * mixed[:, kind]
        share *= weights / share.sum(axis=0)
        sums = np.stack([np.bincount(kind, weights=s, minlength=2 * CLASSES) for s in share])
        seen = sums.sum(axis=0) > 0
        mixed[:, seen] = (sums / np.maximum(sums.sum(axis=0), 1e-300))[:, seen]
    mixed = np.maximum(mixed, np.array([[0.0], [0.0], [1e-6], [1e-6]]))
    return mixed / mixed.sum(axis=0)


def _scorer(mixed: np.ndarray, tokens: int, types: int, ends: int, order: int):
    def score(batches):
        for batch in batches:
            kind_ = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                n = np.array(row["n_tokens"], dtype=np.int64)
                c1, c2, c3 = (unpack_counts(row[k], int(n.sum())).astype(np.float64) for k in ("c1", "c2", "c3"))
                first = np.cumsum(n) - n
                word, pair = _contexts(c1, c2, n, ends)
                pair = pair if order == 3 else pair * 0
                kind = _context_class(word, pair)
                p = mixed[0, kind] * _ratio(c3, pair) + mixed[1, kind] * _ratio(c2, word) + mixed[2, kind] * c1 / max(tokens, 1) + mixed[3, kind] / (types + 1)
                base = np.add.reduceat(np.log10((c1 + 1) / (tokens + types + 1)), first)
                known = np.add.reduceat((c1 > 0).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], kind_), pa.array(row["held_out"], pa.bool_()), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), first))],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Documents whose crc32(id as text) mod 7 is 2 are held out from all counts.  score is the interpolated
    model's log10 probability of the text and its end, base_score the add-one unigram's; order is 2 or 3.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    block_bytes = min(max(BLOCK_LEAST, int(BLOCK_ROOT * math.sqrt(size))), BLOCK_MOST)
    blocks = max(1, -(-size // block_bytes))
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col(id_col).alias("id"), fold.cast("tinyint").alias("fold"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    packed = rows.mapInArrow(_packer(block_bytes), _PACKED.format(kind)).repartition(blocks, "block")
    answers = packed.groupBy("block").applyInArrow(_sender(blocks, order), _SENT).groupBy("kind", "part").applyInArrow(_merge, _ANSWER)
    resolved = checkpoint(packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_resolver(blocks, order), _RESOLVED.format(kind)), "resolved")

    totals = resolved.filter("tokens is not null").agg(F.sum("tokens"), F.sum("types"), F.sum("dev_tokens")).first()
    tokens, types, dev_tokens = (x or 0 for x in totals)
    # One row for each cell that occurs: bounded by the classes and the grid's levels, whatever the size of the corpus.
    grid = resolved.filter("cells is not null").select(F.explode(F.arrays_zip("cells", "weights")).alias("x")).groupBy("x.cells").agg(F.sum("x.weights").alias("n")).toArrow()
    mixed = learn_weights(grid["cells"].to_numpy(), grid["n"].to_numpy().astype(np.float64), tokens - dev_tokens, types)
    ends = docs.filter(fold != HELD_OUT).count()
    scored = resolved.filter("tokens is null").select("ids", "held_out", "n_tokens", "c1", "c2", "c3").mapInArrow(
        _scorer(mixed, tokens, types, ends, order), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
    return scored.withColumnRenamed("id", id_col)
