"""I-Match fingerprints over randomised lexicons.

The lexicon holds the words whose document frequency lies in a band.  A document
keeps its distinct lexicon words in order of their hashes, and hashes the words that
fall into each of levels x ``DRAWS`` random subsets of the lexicon; level l keeps a
2**-l part of it, and there are as many levels as leave the largest document less than one word on average (``LEVELS`` at least).
Sparse subsets survive an edit that leaves their few words alone: on a level that leaves most subsets empty, the share of equal
hashes among subsets that are not empty in both documents is their words' Jaccard similarity (a little below it on others).  So the likeness weighs each level by the
share of its subsets that are empty in both documents.  A fingerprint spells the 64-bit hashes of all levels but those on which
every subset is filled, whose weight is 0; equal texts agree in all.

Document frequencies of all words are counted with packed keys.  Copies and near copies must not push
their words out of the band: a document has the smallest hashes of its shingles as sketches, and where a
sketch is shared by ``LOW`` of all documents or more, these count as one document at the band's upper edge.
A word in the band stands in at least ``LOW`` of all documents, so the lexicon has at most
(mean distinct words a document) / LOW words, whatever the corpus: 8 bytes each of what is broadcast.

Defined cases: null text is empty; a text without lexicon words uses all its words; a text without words is
fingerprinted by its digest and is like its equals only; equal ids are ordered by their texts' hashes, then texts; ids may be of any ordered type, null ids come last;
a single document is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm._packed import cut, unpack_counts, unpack_keys
from vacantia.llm._text import ALNUM, U64, mix, slices, words
from vacantia.operators.storage import checkpoint, drop

#: The band of document frequency, as parts of all documents (two documents at least).
LOW, HIGH = 0.001, 0.1
LEVELS, DRAWS = 12, 16
#: Words of a shingle, and sketches of a document: near copies share one of them at least.
SHINGLE, SKETCHES = 3, 4
#: Weight of one document in fixed point.
ONE = 1 << 20
#: Distinct words that a counting task holds before it sends them on.
HELD = 4_000_000
#: Text for each range of word hashes, and the most ranges: a task sends one packed row a range, a merging task holds its distinct words.
RANGE_BYTES, RANGES = 16 << 20, 4096
#: Text of a partition of documents in order of their ids.
PART_BYTES = 48 << 20

_rng = np.random.Generator(np.random.PCG64(31))
_SALTS = _rng.integers(0, 2**63, DRAWS, dtype=np.uint64)


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (word, document) pairs, sorted by word."""
    w = words(data, offsets, ALNUM)
    owner = np.repeat(np.arange(len(offsets) - 1), w.counts())
    by = np.argsort(w.hashes, kind="stable")
    h, d = w.hashes[by], owner[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def _sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Smallest shingle hash in each of SKETCHES parts of the hash space: documents x SKETCHES, 0 for none."""
    w = words(data, offsets, ALNUM)
    n = w.counts()
    out = np.zeros((len(n), SKETCHES), dtype=np.uint64)
    if not len(w.hashes):
        return out
    left = np.repeat(w.first[1:], n) - np.arange(len(w.hashes))  # words from each place to its document's end
    h = w.hashes.copy()
    for k in range(1, SHINGLE):
        h = mix(h + U64(k))
        h[:-k] += np.where(left[:-k] > k, w.hashes[k:], U64(0))
    h = mix(h)
    whole = (left >= SHINGLE) | (np.repeat(n, n) < SHINGLE)
    some = np.flatnonzero(n)
    most = U64(2**64 - 1)
    for k in range(SKETCHES):
        least = np.minimum.reduceat(np.where(whole & (h % U64(SKETCHES) == k), h, most), w.first[some])
        out[some, k] = np.where(least == most, U64(0), least)
    return out


def _shared(text: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of at least ``least`` documents in order, and their documents: at most SKETCHES / LOW, whatever the corpus."""

    def sketch(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                k, c = np.unique(_sketches(data, offsets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k[k > 0].view(np.int64)), pa.array(c[k > 0])], names=["sketch", "n"])

    found = text.mapInArrow(sketch, "sketch bigint, n bigint").groupBy("sketch").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    keys, n = found["sketch"].to_numpy().view(np.uint64), found["n"].to_numpy()
    by = np.argsort(keys)
    return keys[by], n[by]


def _weights(sketches: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each document counts: ONE, or its part of the largest group that shares a sketch with it."""
    if not len(keys):
        return np.full(len(sketches), ONE, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, sketches), len(keys) - 1)
    return np.ceil(ONE / np.where(keys[at] == sketches, n[at], 1).max(axis=1)).astype(np.int64)


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


def lexicon(docs: DataFrame, **options) -> np.ndarray:
    """Sorted hashes of the words in the band of document frequency."""
    return _lexicon(docs, **options)[0]


def _lexicon(docs: DataFrame, *, text_col: str = "text", low: float = LOW, high: float = HIGH) -> tuple[np.ndarray, int]:
    """The lexicon, and the most distinct words of a document."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    parts = min(max(1, -(-(size or 0) // RANGE_BYTES)), RANGES)
    text = docs.select(F.col(text_col).alias("text"))
    lo = max(2, int(np.ceil(low * n)))
    shared = docs.sparkSession.sparkContext.broadcast(_shared(text, lo))

    def send(batches):
        keys, counts, light, held, widest = [], [], [], 0, 0

        def flush():
            if keys:
                k, c = _totals(keys, counts)
                _, v = _totals(keys, light)
                for part, blob, (x, y) in cut(k, [c, v], parts):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary()), pa.array([x], pa.binary()), pa.array([y], pa.binary()), pa.array([widest])], names=["part", "keys", "counts", "light", "widest"])
                keys.clear()
                counts.clear()
                light.clear()

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, d = _distinct(data, offsets)
                k, at, c = np.unique(h, return_inverse=True, return_counts=True)
                keys.append(k)
                counts.append(c)
                widest = max(widest, int(np.bincount(d).max(initial=0)))
                missing = ONE - _weights(_sketches(data, offsets), *shared.value)  # 0 but for documents of shared sketches
                light.append(np.bincount(at, weights=missing[d], minlength=len(k)).astype(np.int64))
                held += len(k)
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the hints choose the form that takes batches
        k, c, v, widest = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
        for batch in batches:
            own = [unpack_keys(x) for x in batch.column("keys").to_pylist()]
            more = [[unpack_counts(x, len(y)) for x, y in zip(batch.column(name).to_pylist(), own, strict=True)] for name in ("counts", "light")]
            old = k
            k, c = _totals([old, *own], [c, *more[0]])
            _, v = _totals([old, *own], [v, *more[1]])
            widest = max(widest, *batch.column("widest").to_pylist())
        band = (c >= lo) & (c - v / ONE <= hi)
        yield pa.RecordBatch.from_arrays([pa.array([*k[band].view(np.int64).tolist(), None], pa.int64()), pa.array([*c[band].tolist(), widest], pa.int64())], names=["word", "df"])  # the widest in a row without a word

    def weigh(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([int(_weights(_sketches(data, offsets), *shared.value).sum())])], names=["weight"])

    weight = text.mapInArrow(weigh, "weight bigint").agg(F.sum("weight")).first()[0] if len(shared.value[0]) else n * ONE
    hi = max(2, int(high * (weight or 0) / ONE))
    sent = text.mapInArrow(send, "part int, keys binary, counts binary, light binary, widest bigint")
    merged = checkpoint(sent.groupBy("part").applyInArrow(merge, "word bigint, df bigint"), "lexicon")
    widest = merged.filter("word is null").agg(F.max("df")).first()[0] or 0
    words_ = np.sort(merged.filter("word is not null").select("word").toArrow()["word"].to_numpy().view(np.uint64))  # bounded by the band
    drop(merged)
    return words_, widest


def _marks(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, levels: int) -> np.ndarray:
    """Subset hashes (0 for an empty subset) of each document: documents x levels * DRAWS."""
    h, d = _distinct(data, offsets)
    out = np.zeros((len(offsets) - 1, levels * DRAWS), dtype=np.uint64)
    if not len(h):
        return out
    mine = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), dtype=bool)
    bare = np.ones(len(out), dtype=bool)
    bare[d[mine]] = False
    mine |= bare[d]  # a document without lexicon words uses all its words
    h, d = h[mine], d[mine]
    by = np.argsort(d, kind="stable")  # documents in order, their words by hash
    for draw in range(DRAWS):
        words_, owner = h[by], d[by]
        x = mix(words_ ^ _SALTS[draw])
        for level in range(levels):
            inside = x < U64((1 << 64 >> level) - 1)
            x, owner = x[inside], owner[inside]  # a level's subset lies within the level's before
            if not len(x):
                break
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            total = mix(np.add.reduceat(mix(x + U64(draw + 1)), first))
            out[owner[first], level * DRAWS + draw] = np.maximum(total, U64(1))
    return out


def _spelled(marks: np.ndarray, texts: list[bytes]) -> list[str]:
    """Three hex digits of a subset's number and 16 of its hash for each filled subset of the levels that are not full; the digest for a text without words."""
    filled = (marks > 0).reshape(len(marks), marks.shape[1] // DRAWS, DRAWS)
    telling = ~filled.all(axis=2)
    telling[:, -1] = True
    doc, place = np.nonzero((filled & telling[:, :, None]).reshape(marks.shape))
    entries = [f"{p:03x}{h:016x}" for p, h in zip(place.tolist(), marks[doc, place].tolist(), strict=True)]
    bounds = np.searchsorted(doc, np.arange(len(marks) + 1)).tolist()
    start = telling.argmax(axis=1).tolist()
    empty = ~filled.any(axis=(1, 2))
    return ["text:" + hashlib.sha256(t).hexdigest() if e else f"{start[k]:02x}:" + "".join(entries[bounds[k] : bounds[k + 1]]) for k, (t, e) in enumerate(zip(texts, empty, strict=True))]


def _likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Share of equal subset hashes among those filled in either document, each level weighed by its subsets that are empty in both; 1 for equal fingerprints."""
    a, b = a.reshape(len(a), a.shape[1] // DRAWS, DRAWS), b.reshape(len(b), b.shape[1] // DRAWS, DRAWS)
    some = (a > 0) | (b > 0)
    filled = some.sum(axis=2)
    weight = (DRAWS - filled) / DRAWS
    weight[:, -1] = np.maximum(weight[:, -1], 1 / DRAWS)
    equal = ((a == b) & some).sum(axis=2)
    return np.where(same, 1.0, np.minimum((weight * equal).sum(axis=1) / np.maximum((weight * filled).sum(axis=1), 1e-9), 0.999))


def _arrow(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], known: np.ndarray, levels: int) -> dict:
    """Results of all documents but the last, each with its successor in the list."""
    raw = [t.encode() for t in texts]
    cut_ = [edited(a, b).encode() for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, other = _marks(*_arrow(raw), known, levels), _marks(*_arrow(cut_), known, levels)
    a, b = _spelled(own, raw), _spelled(other, cut_)
    n = len(cut_)
    return {
        "id": ids[:n],
        "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in cut_],
        "fingerprint": a[:n],
        "edited_fingerprint": b,
        "near_edited": _likeness(own[:n], other, np.array([x == y for x, y in zip(a, b, strict=False)], dtype=bool)).tolist(),
        "near_next": _likeness(own[:n], own[1:], np.array([x == y for x, y in zip(a[:-1], a[1:], strict=True)], dtype=bool)).tolist(),
    }


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_DDL = "id {}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(kind: pa.DataType) -> pa.Schema:
    return pa.schema(list(zip(_NAMES, [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The next document is that of the next smaller id, after the last the first; see ``edited`` for the edited text.
    Rows are range-partitioned by id; a partition's last document is finished in a second step with
    the first document of the next partition that has any.
    """
    sc = docs.sparkSession.sparkContext
    lexicon_, widest = _lexicon(docs, text_col=text_col)
    known, levels = sc.broadcast(lexicon_), max(LEVELS, widest.bit_length() + 1)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    order = F.col("id").desc_nulls_last()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ddl = _DDL.format(rows.schema["id"].dataType.simpleString())
    # Rows without an id, or of one id, are dealt by their text, too.
    rows = rows.repartitionByRange(parts, order, F.xxhash64("text")).sortWithinPartitions(order, F.xxhash64("text"), "text")

    def run(batches):
        part, ids, texts, first = TaskContext.get().partitionId(), [], [], None
        for batch in batches:
            kind, body = batch.schema.field("id").type, batch.column(1)
            wide_ = pa.schema([*_result(kind), ("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())])
            for lo, hi, _, _ in slices(body):
                ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                texts += body.slice(lo, hi - lo).to_pylist()
                first = texts[0] if first is None else first
                got = pa.table(_rows(ids, texts, known.value, levels), schema=_result(kind))
                none = pa.nulls(len(got), pa.string())
                yield from pa.Table.from_arrays([*got.columns, pa.nulls(len(got), pa.int32()), none, none], schema=wide_).to_batches()
                ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield pa.RecordBatch.from_pylist([{"id": ids[0], "part": part, "first_text": first, "last_text": texts[0]}], schema=wide_)

    wide = checkpoint(rows.mapInArrow(run, ddl + ", part int, first_text string, last_text string"), "fingerprints")
    ends = wide.filter("part is not null")
    # One number a partition stands in this window, no text.
    following = ends.select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    pairs = ends.select("id", "part", "last_text").join(following, "part").join(ends.select(F.col("part").alias("next"), "first_text"), "next").select("id", "last_text", "first_text")

    def finish(batches):
        for batch in batches:
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from pa.table(_rows([i, None], [a, b], known.value, levels), schema=_result(batch.schema.field("id").type)).to_batches()

    done = wide.filter("part is null").select(*_NAMES)
    return done.unionByName(pairs.mapInArrow(finish, ddl)).withColumnRenamed("id", id_col)
