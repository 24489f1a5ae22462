"""Company search: semantic over an inverted-file index, then by keyword, then browsing.

The index deals every vector to the nearest of ``lists`` centres, which are fitted on a bounded sample.  A search looks into
the ``probes`` lists nearest to its vector; where a filter leaves too few of their rows for the page, all rows that pass it are
compared, so a narrow scope never loses results.  ``recall`` measures an index against full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import geo, vectors
from vacantia.operators import search
from vacantia.operators.relational import newest
from vacantia.operators.search import vector_topk
from vacantia.operators.storage import checkpoint

#: Rows that the centres are fitted on at most (those with the smallest hashes), and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8


@dataclass
class VectorIndex:
    """Unit vectors by list: ``rows`` (id, list, vector) is a written table; ``centres`` has a row a list."""

    rows: DataFrame
    centres: np.ndarray
    probes: int

    def nearest_lists(self, vector: list[float]) -> list[int]:
        q = np.asarray(vector, dtype=np.float64)
        return np.argsort(-(self.centres @ q), kind="stable")[: self.probes].tolist()


def _fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres by Lloyd's rounds from evenly spaced sample rows; a centre that loses all its rows stays where it is."""
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows have one): sums in the order of the entries, as in ``vectors.normalize``; none for a zero or non-finite row."""
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    there = (n > 0) & np.isfinite(n)
    return x[there] / n[there, None], there


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and unit vectors of batches (id, vector); a null entry is not finite."""
    for b in batches:
        if b.num_rows:
            x, there = _units(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
            yield b.column(0).filter(pa.array(there)), x


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def build_index(documents: DataFrame, *, key: str = "id", vector: str = "embedding", lists: int = 64, probes: int = 16) -> VectorIndex:
    """Index every vector; null, empty, zero and non-finite ones are not found by any search.  All vectors have one length."""
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector")).filter("vector is not null and size(vector) > 0")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _indexed(batches):
            yield pa.RecordBatch.from_arrays([ids, _lists(x)], names=["id", "vector"])

    unit = rows.mapInArrow(units, "id bigint, vector array<double>")
    sample = np.array([r[0] for r in unit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()], dtype=np.float64)
    if not len(sample):
        return VectorIndex(checkpoint(unit.select("id", F.lit(0).alias("list"), "vector"), "vectors"), np.empty((0, 0)), probes)
    centres = _fitted(sample, lists)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _indexed(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array((x @ centres.T).argmax(axis=1).astype(np.int32)), _lists(x)], names=["id", "list", "vector"])

    rows = rows.mapInArrow(deal, "id bigint, list int, vector array<double>")
    return VectorIndex(checkpoint(rows.repartitionByRange("list", "id").sortWithinPartitions("list"), "vectors"), centres, probes)


def topk(index: VectorIndex, queries: DataFrame, k: int, *, query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, id, distance): the k nearest of each query among the lists it looks into, by cosine distance, then id.

    Queries are broadcast in blocks (``search.MAX_QUERIES`` on average) and meet the lists they look into in products of matrices; a large list is read by as
    many tasks as it has parts, and each hands on its own k best of a query.
    """
    centres, probes, cells = index.centres, index.probes, search.CELLS
    asked = queries.select(F.col(query).cast("bigint").alias("q"), F.col(vector).alias("v")).filter("q is not null and v is not null and size(v) > 0")
    if not len(centres):
        return asked.select(F.col("q").alias(query), F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("distance")).limit(0)
    blocks = max(1, -(-asked.count() // search.MAX_QUERIES))

    def block(number: int):
        rows = asked.filter(F.pmod(F.xxhash64("q", "v"), F.lit(blocks)) == number).collect()
        q, there = _units(np.array([r.v for r in rows], dtype=np.float64).reshape(len(rows), centres.shape[1]))
        held = index.rows.sparkSession.sparkContext.broadcast((np.array([r.q for r in rows], dtype=np.int64)[there], q))
        return lambda batches: nearest(batches, *held.value)

    def nearest(batches: Iterator[pa.RecordBatch], names: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        best = search.Nearest(names, q, k, cells)
        looks = np.zeros((len(names), len(centres)), dtype=bool)
        np.put_along_axis(looks, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            ids, own, x = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2).flatten()).reshape(b.num_rows, -1)
            for n in np.unique(own):
                best.meet(ids[own == n], x[own == n], np.flatnonzero(looks[:, n]))
        yield from best.found([query, "id", "distance"])

    rows = index.rows.filter("id is not null").select("id", "list", "vector")
    found = reduce(DataFrame.unionByName, [rows.mapInArrow(block(n), f"{query} bigint, id bigint, distance double") for n in range(blocks)])
    return newest(found, [query], [F.col("distance"), F.col("id")], k)


def recall(index: VectorIndex, documents: DataFrame, queries: DataFrame, k: int, *, key: str = "id", query: str = "query_id", vector: str = "embedding") -> float:
    """The share of the exact k nearest that the index finds, over all queries; 1 if there are none."""
    exact = vector_topk(documents, queries, item=key, query=query, vector=vector, k=k).select(query, F.col(key).cast("bigint").alias("id"))
    found = topk(index, queries, k, query=query, vector=vector).select(query, "id", F.lit(1).alias("hit"))
    n, hits = exact.join(found, [query, "id"], "left").agg(F.count("*"), F.sum(F.coalesce("hit", F.lit(0)))).first()
    return hits / n if n else 1.0


def search_companies(companies: DataFrame, index: VectorIndex | None, *, text: str | None = None, vector: list[float] | None = None, within: tuple[float, float, float] | None = None, where: Column | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, int, str]:
    """(page, total, mode) of a search over companies (id, name, lat, lon, ...).

    ``within`` is (lat, lon, radius in km), ``where`` any other scope.  With a vector, and as soon as one company in scope is indexed, the mode is ``semantic``:
    all indexed companies in scope count, nearest first.  Else a text gives ``keyword`` (a part of the name, in any case), else ``browse``; both are ordered by
    distance if there is a radius, then by name and id.
    """
    scope = companies if where is None else companies.filter(where)
    if within:
        lat, lon, km = (F.lit(float(x)) for x in within)
        scope = scope.filter(geo.within_radius(F.col("lat"), F.col("lon"), lat, lon, km)).withColumn("distance_m", geo.haversine_m(F.col("lat"), F.col("lon"), lat, lon))
    words = " ".join(text.split()) if text else ""
    if vector is not None and index is not None and len(index.centres):
        q = np.asarray(vector, dtype=np.float64)
        q = F.array(*[F.lit(float(x)) for x in q / max(np.linalg.norm(q), 1e-300)])
        total = scope.join(index.rows.select("id"), "id", "left_semi").count()
        if total:
            near = index.rows.filter(F.col("list").isin(index.nearest_lists(vector)))
            found = scope.join(near.select("id", "vector"), "id")
            if index.probes < len(index.centres) and found.count() < min(total, offset + limit):
                found = scope.join(index.rows.select("id", "vector"), "id")  # too few in the lists looked into: all in scope
            scored = found.withColumn("semantic_distance", 1 - vectors.dot(q, F.col("vector"))).drop("vector")
            return scored.orderBy("semantic_distance", "id").offset(offset).limit(limit), total, "semantic"
    if words:
        scope = scope.filter(F.contains(F.lower("name"), F.lit(words.lower())))
    order = (["distance_m"] if within else []) + [F.lower("name"), F.col("id")]
    return scope.orderBy(*order).offset(offset).limit(limit), scope.count(), "keyword" if words else "browse"
