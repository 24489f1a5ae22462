"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.strings import once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector; null for a zero or non-finite one."""
    unit = lambda v, n: F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n))
    return once(a, lambda v: once(norm(v), lambda n: unit(v, n)))


def masked_mean_pool(states: Column, mask: Column) -> Column:
    """Unit vector of the mean of the states (one vector a token) whose mask is above 0; null if none is."""
    kept = F.filter(F.zip_with(states, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: F.coalesce(x["m"] > 0, F.lit(False)) & x["v"].isNotNull())
    add = lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q.cast("double"))
    mean = lambda k, n: F.transform(F.aggregate(k, F.transform(F.try_element_at(k, F.lit(1))["v"], lambda x: F.lit(0.0)), add), lambda x: x / n)
    return normalize(once(kept, lambda k: once(F.size(k), lambda n: mean(k, n))))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def similarity_score(similarity: Column) -> Column:
    """min(59, 30 + round((s - .84) / .07 * 29)) from .84 on, else 0 (half to even)."""
    return F.when(similarity >= 0.84, F.least(F.lit(59), 30 + F.bround((similarity - 0.84) / 0.07 * 29, 0).cast("int"))).otherwise(F.lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
