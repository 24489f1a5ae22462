"""Search pages over postings and companies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, strings
from vacantia.operators import dedupe, scope
from vacantia.operators.relational import best_per_group, newest


def keyword_filter(words: str, columns: Sequence[Column]) -> Column:
    """Every word stands in some column; case aside, and % or _ mean themselves."""
    out = F.lit(True)
    for word in words.split():
        some = F.lit(False)
        for c in columns:
            some = some | F.coalesce(strings.like_literal(c, word), F.lit(False))
        out = out & some
    return out


def date_rank(value: Column) -> Column:
    """Seconds since 1970; what does not parse sorts before everything."""
    return F.coalesce(F.unix_timestamp(dates.parse_iso(value)).cast("double"), F.lit(float("-inf")))


def browse_order(kind: str) -> list[Column]:
    c = F.col
    first = {
        "newest": [c("posted_at").isNull(), c("posted_at").desc()],
        "title": [F.lower("title")],
        "company": [F.lower("company"), F.lower("title")],
        "remote": [F.coalesce("is_remote", F.lit(False)).desc(), F.lower("title")],
    }[kind]
    return [*first, c("job_id")]


def candidate_filter(spatial: Column, expires: Column, remote: Column, text: Column) -> Column:
    """A superset of the exact scope: any of four cheap tests."""
    out = F.lit(False)
    for c in (spatial, expires, remote, text):
        out = out | F.coalesce(c, F.lit(False))
    return out


def visible(eligible: Column, score: Column, minimum: int, tracked: Column, by_model: Column, unknown: Column, include_unknown: bool) -> Column:
    return eligible & ((score >= minimum) | (tracked & by_model)) & (F.lit(include_unknown) | ~unknown)


class Nearest:
    """The k nearest rows of each query among those met, by cosine distance, then id; of unit vectors, whatever rows come together.

    Products of matrices leave the rows that can be among the k best; only their distances are worked out again, as sums in the order of the entries.
    """

    def __init__(self, names: Sequence[int], queries: np.ndarray, k: int, cells: int):
        self.names, self.queries, self.k, self.cells = np.asarray(names, dtype=np.int64), queries, k, cells
        self.ids, self.best = np.full((len(names), k), np.iinfo(np.int64).max), np.full((len(names), k), np.nan)  # empty places sort last
        self.held = np.zeros(len(names), dtype=np.int64)

    def meet(self, ids: np.ndarray, rows: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Rows that the queries at ``asking`` (all) look at."""
        asking = np.arange(len(self.names)) if asking is None else asking
        if not len(ids) or not len(asking):
            return
        ids, rows = _few(ids, rows, self.k)
        step = max(1, self.cells // len(ids))
        for at in range(0, len(asking), step):  # queries whose distances are held at once
            self._meet(ids, rows, asking[at : at + step])

    def _meet(self, ids: np.ndarray, rows: np.ndarray, who: np.ndarray) -> None:
        q = self.queries[who]
        near = q @ rows.T
        most = self.best[who, -1]
        if len(ids) >= self.k and np.isnan(most).any():  # the k best of some rows bound those of all
            some = near[:, : max(self.k, FIRST)]
            most = np.fmin(most, 1 - np.partition(some, some.shape[1] - self.k, axis=1)[:, -self.k])
        a, b = np.nonzero(~(near < (1 - most - NEAR)[:, None]))  # not a number: no bound, or no distance
        if not len(a):
            return
        exact, part = np.empty(len(a)), max(1, self.cells // max(1, q.shape[1]))
        for at in range(0, len(a), part):
            some = slice(at, at + part)
            exact[some] = 1 - np.cumsum(q[a[some]] * rows[b[some]], axis=1)[:, -1]
        new = np.bincount(a, minlength=len(who))
        row = np.concatenate([np.repeat(np.arange(len(who)), self.k), a])
        d, i = np.concatenate([self.best[who].ravel(), exact]), np.concatenate([self.ids[who].ravel(), ids[b]])
        order = np.lexsort((i, d, row))
        first = order[(np.cumsum(new + self.k) - new - self.k)[:, None] + np.arange(self.k)]
        self.ids[who], self.best[who] = i[first], d[first]
        self.held[who] = np.minimum(self.k, self.held[who] + new)

    def found(self, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
        """(query, id, distance) in batches of a thousand queries."""
        for at in range(0, len(self.names), 1_000):
            some = slice(at, at + 1_000)
            there = np.arange(self.k) < self.held[some, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.names[some], self.held[some])), pa.array(self.ids[some][there]), pa.array(self.best[some][there])], names=list(names))


def _few(ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal rows the k with the smallest ids: no others can be among the k nearest."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    code = np.unique(whole, return_inverse=True)[1]
    order = np.lexsort((ids, code))
    first = np.searchsorted(code[order], code[order])
    kept = np.sort(order[np.arange(len(order)) - first < k])
    return ids[kept], rows[kept]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def vector_topk(items: DataFrame, queries: DataFrame, *, item: str, query: str, vector: str, k: int) -> DataFrame:
    """(query, item, distance, rank): the k nearest items of each query by cosine distance, then id.

    Exact: every item meets every query. Queries are taken in blocks of MAX_QUERIES at most on average (by a hash of the row), each read
    once a partition; each partition hands on only its own k best of a query, so the shuffle holds partitions * k rows a query.
    """
    asked = queries.select(F.col(query).alias("q"), F.col(vector).alias("v"))
    blocks, cells = max(1, -(-asked.count() // MAX_QUERIES)), CELLS

    def block(number: int):
        rows = asked.filter(F.pmod(F.xxhash64("q", "v"), F.lit(blocks)) == number).collect()
        names = [r.q for r in rows]
        q = _unit(np.array([r.v for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))
        held = items.sparkSession.sparkContext.broadcast((names, q))
        return lambda batches: nearest(batches, *held.value)

    def nearest(batches, names, q):
        best = Nearest(names, q, k, cells)
        for batch in batches:
            if len(batch) and len(names):
                best.meet(np.asarray(batch.column(0)), _unit(np.asarray(batch.column(1).flatten()).reshape(len(batch), -1).astype(np.float64)))
        yield from best.found(["q", "item", "distance"])

    rows = items.filter(F.col(vector).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(vector).alias("v"))
    rows = rows.repartition(4 * items.sparkSession.sparkContext.defaultParallelism, "item")  # vectors are short: a table of many lies in few file splits
    found = reduce(DataFrame.unionByName, [rows.mapInArrow(block(k), "q bigint, item bigint, distance double") for k in range(blocks)])
    top = newest(found, ["q"], [F.col("distance"), F.col("item")], k)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "item"))
    return top.withColumn("rank", rank).select(F.col("q").alias(query), F.col("item").alias(item), "distance", "rank")


#: Query vectors broadcast at once on average (1.5 MB at 384 dimensions per 1,000).
MAX_QUERIES = 10_000
#: Distances that a task holds at once, some 40 bytes each with their ids and order.
CELLS = 1_000_000
#: Rows that bound the first k best of a query; similarities so near the bound are worked out again in order.
FIRST, NEAR = 1_000, 1e-9


def snapshot_key(generation: Column, **criteria: Column) -> Column:
    """Key of a search's materialised result."""
    from vacantia.functions.records import canonical_hash

    return canonical_hash(generation=generation, **criteria)


def display(postings: DataFrame, limit: int = 280) -> DataFrame:
    """Display rows: employer falls back to the posting's organisation, then the feed's company; descriptions are cut."""
    return postings.withColumn("employer", F.coalesce("employer_name", "organization", "source_company")).withColumn("summary", F.left("description", F.lit(limit)))


def match_order(kind: str) -> list[Column]:
    """Orders of matched postings by score, discovery and posting date; 'match' and 'relevance' put the score first.

    Columns: score (null: none), first_seen_at and date_posted as text, title, job_id.
    """
    score = F.coalesce("score", F.lit(-1)).desc()
    discovered, posted = date_rank(F.col("first_seen_at")).desc(), date_rank(F.col("date_posted")).desc()
    first = {"posted": [posted, score, discovered], "discovered": [discovered, score, posted], "match": [score, discovered, posted], "relevance": [score, discovered, posted]}[kind]
    return [*first, F.lower("title"), F.col("job_id")]


def search_page(postings: DataFrame, *, now: Column, order: str = "match", offset: int = 0, limit: int = 50, minimum: int = 0, include_unknown: bool = True, selection: str = "all", **area) -> tuple[DataFrame, DataFrame]:
    """One search: (page, counts).  Scope first, then the richest eligible posting of each ``group``, then the match's verdict, the order and the page.

    postings: what ``scope.classify`` and ``dedupe.richness`` read, ``group`` of the vacancy (from the maintained groups), score, conflict and
    uncertain (null: false).  page: the postings with ``scope`` and ``total``, the number of all that pass.  counts: (reason, n) of what was
    turned away by scope, profile_conflict, below_score or uncertain, in this precedence.
    """
    classified = scope.classify(postings, now=now, selection=selection, **area)
    unique = best_per_group(classified.filter("scope.eligible"), ["group"], dedupe.richness(now))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    turned = F.when(yes("conflict"), "profile_conflict").when(F.coalesce("score", F.lit(-1)) < minimum, "below_score").when(F.lit(not include_unknown) & yes("uncertain"), "uncertain")
    judged = unique.withColumn("turned", turned)
    kept = judged.filter("turned is null").drop("turned")
    counts = scope.rejected_by_reason(classified).unionByName(judged.filter("turned is not null").groupBy(F.col("turned").alias("reason")).agg(F.count("*").alias("n")))
    shown = kept.orderBy(*match_order(order)).offset(offset).limit(limit)
    return shown.crossJoin(F.broadcast(kept.agg(F.count("*").alias("total")))), counts  # total: one row


def evict(snapshots: DataFrame, now: Column, *, keep: int = 32, fresh_s: int = 900, most_s: int = 86_400, preserve: str | int | None = None) -> DataFrame:
    """Snapshots (key, created_at, is_prewarmed) that stay: prewarmed ones for ``fresh_s`` seconds, others for ``most_s`` and the ``keep`` newest of them; ``preserve`` always, beside these."""
    own = F.lit(False) if preserve is None else F.col("key") == preserve
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / 1_000_000
    newest = snapshots.filter(~F.col("is_prewarmed") & ~own).orderBy(F.col("created_at").desc(), "key").limit(keep).select("key", F.lit(True).alias("__new"))
    stays = F.when(F.col("is_prewarmed"), age <= fresh_s).otherwise((age <= most_s) & F.coalesce("__new", F.lit(False)))
    return snapshots.join(F.broadcast(newest), "key", "left").filter(own | stays).select(snapshots.columns)  # at most ``keep`` rows
