"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns runs of documents into index segments: the sorted
(term, position) postings of every query term, written to the shared folder.
``search`` reads segments: the postings of each window's globally rarest term
give candidate starts, which are intersected with the offset-adjusted postings
of the next rarer terms until the whole phrase has matched.  No posting is ever
shuffled; only term counts are.

The index is built once, over the words of all test items (all words, if these have more than ``VOCABULARY`` distinct
ones); a segment has its own sorted dictionary of word hashes.  Items are cut into overlapping pieces, which are searched in blocks of
about ``BLOCK_BYTES`` of text, so what is broadcast is bounded however large the benchmark or one of its items is.

Defined cases: null and empty texts have no words, no hits, and items without
words match nothing; items with a null id hit and contaminate like others, count as one item together in ``n_items``,
stand as one null at the end of ``items``, and are no part of the joined ids; an item of fewer than ``width`` words is one window; equal
rows each get their row; ids may be of any type; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm._text import ALNUM, slices, utf8, words
from vacantia.operators.storage import checkpoint

#: Text of test items in one block of search, and words of a piece of an item.
BLOCK_BYTES, PIECE = 4 << 20, 4096
#: Distinct words of all items up to which only these words are indexed: 64 MB of hashes.
VOCABULARY = 8_000_000
#: Candidate starts held at once while a segment is searched.
CANDIDATES = 1 << 20
_BASE = 1 << 10
_SEGMENT = "ids array<{}>, n_words array<bigint>, text_key array<bigint>, postings binary, terms array<bigint>, counts array<bigint>"
_FOUND = "id {}, text_key bigint, n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>"
_NEAR = "id {}, text_key bigint, items array<string>"
_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


class Phrases:
    """Windows of the test items: where each begins in the items' words, its length, and the item it comes from."""

    def __init__(self, items: list, texts: list, width: int):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        w = words(data, offsets, ALNUM)
        n = w.counts()
        self.vocabulary, number = np.unique(w.hashes, return_inverse=True)
        self.number, self.width = number.astype(np.int32), width
        windows = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        self.owner = np.repeat(np.arange(len(n), dtype=np.int32), windows)
        self.begin = np.repeat(w.first[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(len(self.owner))
        self.length = np.minimum(n, width)[self.owner].astype(np.int32)
        self.names = [None if x is None else str(x) for x in items]

    def rank(self, counts: np.ndarray) -> None:
        """Orders the places of each window from its rarest term to its most frequent, and the windows by their rarest term."""
        self.order = np.empty((len(self.owner), self.width), dtype=np.int16)
        for lo in range(0, len(self.owner), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            place = np.arange(self.width)
            used = place < self.length[at, None]
            cost = np.where(used, counts[self.number[np.where(used, self.begin[at, None] + place, 0)]], np.iinfo(np.int64).max)
            self.order[at] = np.argsort(cost, axis=1, kind="stable")
        rarest = self.number[self.begin + self.order[:, 0]] if len(self.owner) else np.empty(0, dtype=np.int32)
        self.by_rarest = np.argsort(rarest, kind="stable")
        self.groups = np.searchsorted(rarest[self.by_rarest], np.arange(len(self.vocabulary) + 1))

    def terms(self, windows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and term number of each window's ``step``-th rarest term, and whether the window has so many."""
        place = self.order[windows, step].astype(np.int64)
        used = step < self.length[windows]
        return place, self.number[np.where(used, self.begin[windows] + place, 0)], used


def _indexer(vocabulary, gap: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, ALNUM)
                n = w.counts()
                at = np.arange(len(w.hashes)) + np.repeat(np.arange(hi - lo) * gap, n) + _BASE
                hashes = w.hashes
                if known is not None:
                    term = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                    mine = np.flatnonzero(known[term] == hashes) if len(known) else np.empty(0, dtype=np.int64)
                    hashes, at = hashes[mine], at[mine]
                terms, local, counts = np.unique(hashes, return_inverse=True, return_counts=True)
                postings = np.sort((local.astype(np.int64) << 32) | at)
                keys = _text_keys(data, offsets)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [one(batch.column(0).slice(lo, hi - lo)), one(n), one(keys), pa.array([postings.tobytes()], pa.binary()), one(terms.view(np.int64)), one(counts)],
                    names=["ids", "n_words", "text_key", "postings", "terms", "counts"],
                )

    return index


def _text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    body = data.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(body[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64)


def build_index(docs: DataFrame, vocabulary: np.ndarray | None, *, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments with the postings of the words whose hashes are in ``vocabulary`` (of all words without one), as a written table."""
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # VOCABULARY words at most
    return checkpoint(text.mapInArrow(_indexer(held, 2 * width), _SEGMENT.format(text.schema["id"].dataType.simpleString())), "postings")


def _hashes(tests: DataFrame) -> DataFrame:
    """(term): the distinct word hashes of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(data, offsets, ALNUM).hashes).view(np.int64))], names=["term"])

    return tests.select("text").mapInArrow(run, "term bigint").distinct()


def _pieces(tests: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(item, text): pieces of the items' words that overlap by ``width`` - 1, so that each window stands in one piece."""
    rows = tests.select(F.col(item_col).alias("item"), F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1).alias("w")).filter("size(w) > 0")
    begin = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)), F.lit(PIECE)))
    return rows.select("item", "w", begin.alias("at")).select("item", F.array_join(F.slice("w", F.col("at") + 1, F.lit(PIECE + width - 1)), " ").alias("text")).distinct()


def _candidates(postings: np.ndarray, first: np.ndarray, local: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of every posting of each window's rarest term, a bounded number at a time, for windows whose terms all occur."""
    here = np.flatnonzero(local >= 0)
    size = phrases.groups[here + 1] - phrases.groups[here]
    win = phrases.by_rarest[np.repeat(phrases.groups[here] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    for step in range(phrases.width):
        _, term, used = phrases.terms(win, step)
        win = win[~used | (local[term] >= 0)]
    if not len(win):
        return
    rarest, term, _ = phrases.terms(win, 0)
    lo, n = first[local[term]], first[local[term] + 1] - first[local[term]]
    total, done = np.cumsum(n), 0
    while done < len(win):
        now = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + CANDIDATES, side="right")))
        take = slice(done, now)
        each = np.repeat(np.arange(done, now), n[take])
        at = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[take]) - n[take], n[take])
        yield win[each], (postings[at] & 0xFFFFFFFF) - rarest[each]
        done = now


class _Row:
    """A segment as arrays, and where the terms of ``phrases`` stand in it (-1: nowhere)."""

    def __init__(self, row: dict, phrases: Phrases, gap: int):
        self.postings, self.n = np.frombuffer(row["postings"], dtype=np.int64), np.array(row["n_words"], dtype=np.int64)
        terms = np.array(row["terms"], dtype=np.int64).view(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(np.array(row["counts"], dtype=np.int64))]).astype(np.int64)
        self.base = _BASE + np.cumsum(self.n) - self.n + np.arange(len(self.n)) * gap
        self.local = np.full(len(phrases.vocabulary), -1, dtype=np.int64)
        if len(phrases.vocabulary):
            number = np.minimum(np.searchsorted(phrases.vocabulary, terms), len(phrases.vocabulary) - 1)
            mine = np.flatnonzero(phrases.vocabulary[number] == terms)
            self.local[number[mine]] = mine

    def candidates(self, phrases: Phrases):
        return _candidates(self.postings, self.first, self.local, phrases)


def _searcher(held, gap: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                seg = _Row(row, phrases, gap)
                n, base, wins, starts = seg.n, seg.base, [], []
                for win, start in seg.candidates(phrases):
                    for step in range(1, phrases.width):
                        if not len(win):
                            break
                        place, term, used = phrases.terms(win, step)
                        key = (seg.local[term] << 32) | (start + place)
                        at = np.minimum(np.searchsorted(seg.postings, key), len(seg.postings) - 1)
                        ok = (seg.postings[at] == key) | ~used
                        win, start = win[ok], start[ok]
                    wins.append(win)
                    starts.append(start)
                spans, items = [[] for _ in n], [[] for _ in n]
                if wins and len(win := np.concatenate(wins)):
                    start = np.concatenate(starts)
                    doc = np.searchsorted(base, start, side="right") - 1
                    depth = np.zeros(int(base[-1] + n[-1]) + gap + 2, dtype=np.int64)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + phrases.length[win], -1)
                    hit = np.cumsum(depth) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    for s, e in edge.reshape(-1, 2):
                        d = int(np.searchsorted(base, s, side="right")) - 1
                        spans[d].append({"s": int(s - base[d]), "e": int(e - base[d])})
                    for d, k in np.unique(np.stack([doc, phrases.owner[win]], axis=1), axis=0):
                        items[d].append(phrases.names[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], kind), pa.array(row["text_key"], pa.int64()), pa.array(n), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                    names=["id", "text_key", "n_words", "spans", "items"],
                )

    return search


def _near_searcher(held, gap: int, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                seg = _Row(row, phrases, gap)
                n, base, items = seg.n, seg.base, [[] for _ in seg.n]
                for win, start in seg.candidates(phrases):
                    anchor = start + phrases.terms(win, 0)[0]
                    doc = np.searchsorted(base, anchor, side="right") - 1
                    lo, hi = np.maximum(anchor - slop, base[doc]), np.minimum(anchor + slop, base[doc] + n[doc] - 1)
                    ok = np.ones(len(win), dtype=bool)
                    for step in range(phrases.width):
                        _, term, used = phrases.terms(win, step)
                        at = np.searchsorted(seg.postings, (seg.local[term] << 32) | lo)
                        found = seg.postings[np.minimum(at, len(seg.postings) - 1)]
                        ok &= ~used | ((at < len(seg.postings)) & (found <= ((seg.local[term] << 32) | hi)))
                    for d, k in np.unique(np.stack([doc[ok], phrases.owner[win[ok]]], axis=1), axis=0):
                        items[d].append(phrases.names[k])
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), pa.array(row["text_key"], pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["id", "text_key", "items"])

    return search


def _searches(docs: DataFrame, tests: DataFrame, width: int, id_col: str, item_col: str, text_col: str, job, columns: list[str], schema: str) -> tuple[list[DataFrame], str]:
    """job's rows for each block of test items, over one index of the documents."""
    spark = docs.sparkSession
    pieces = checkpoint(_pieces(tests, item_col, text_col, width), "pieces")
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    terms = _hashes(pieces)
    few = terms.count() <= VOCABULARY
    vocabulary = np.sort(terms.toArrow()["term"].to_numpy().view(np.uint64)) if few else None
    index = build_index(docs, vocabulary, width=width, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    blocks, parts = max(1, -(-size // BLOCK_BYTES)), []
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("n"))
    if blocks > 1:
        counts = checkpoint(counts, "term-counts")
    for k in range(blocks):
        rows = pieces.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # a block of bounded size
        phrases = Phrases([r.item for r in rows], [r.text for r in rows], width)
        asked = counts.join(spark.createDataFrame(pa.table({"term": phrases.vocabulary.view(np.int64)})), "term", "left_semi") if blocks > 1 else counts
        found = asked.toArrow()  # one row for each word of the block
        n = np.zeros(len(phrases.vocabulary), dtype=np.int64)
        n[np.searchsorted(phrases.vocabulary, found["term"].to_numpy().view(np.uint64))] = found["n"].to_numpy()
        phrases.rank(n)
        parts.append(index.select(*columns).mapInArrow(job(spark.sparkContext.broadcast(phrases)), schema.format(kind)))
    return parts, kind


def _merger(rows: int):
    """Answers of all blocks for equal rows: spans united, one row for each of the equal rows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items, times = [], [], []
            for row in batch.select(["spans", "items", "answers"]).to_pylist():
                out = []
                for s, e in sorted((x["s"], x["e"]) for x in row["spans"]):
                    if out and out[-1]["e"] >= s:
                        out[-1]["e"] = max(out[-1]["e"], e)
                    else:
                        out.append({"s": s, "e": e})
                spans.append(out)
                items.append(row["items"])
                times.append(row["answers"] // rows)
            again = pa.array(np.repeat(np.arange(batch.num_rows), times))
            yield pa.RecordBatch.from_arrays([x.take(again) for x in (batch.column("id"), batch.column("n_words"), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())))], names=["id", "n_words", "spans", "items"])

    return merge


def contamination(docs: DataFrame, tests: DataFrame, *, width: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, spans, items, contaminated) for each row of ``docs``.

    A word is hit if it stands in an occurrence of ``width`` consecutive words of an item; ``spans`` are the runs of
    hit words [s, e), ``items`` the ids of the items found, sorted as strings.
    """
    parts, kind = _searches(docs, tests, width, id_col, item_col, text_col, lambda held: _searcher(held, 2 * width), ["ids", "n_words", "text_key", "postings", "terms", "counts"], _FOUND)
    found = parts[0]
    if len(parts) > 1:  # equal rows were searched alike: merge the blocks' answers, then give each row its own again
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("id", "text_key", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.count("*").alias("answers"))
        found = found.mapInArrow(_merger(len(parts)), f"id {kind}, n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>")
    found = found.withColumn("items", F.array_sort(F.array_distinct("items")))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    out = found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "spans", "items")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def proximity(docs: DataFrame, tests: DataFrame, *, width: int = 10, slop: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, items): the items of which some window's terms all stand within ``slop`` words of an occurrence of its rarest term; one row for each distinct id and text if there is more than one block."""
    parts, _ = _searches(docs, tests, width, id_col, item_col, text_col, lambda held: _near_searcher(held, 2 * width, slop), ["ids", "n_words", "text_key", "postings", "terms", "counts"], _NEAR)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) > 1:
        found = found.groupBy("id", "text_key").agg(F.flatten(F.collect_list("items")).alias("items"))
    return found.select(F.col("id").alias(id_col), F.array_sort(F.array_distinct("items")).alias("items"))
