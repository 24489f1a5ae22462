"""Picks, pages, lookups and rewrites that the search, ingest and matching queries share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt anew to four parts a core at least (by the columns named, else in turn), for dear expressions over many short rows.

    Such a table lies in few file splits, and adaptive execution joins small parts of a shuffle again unless their number is stated.
    """
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def once_per_value(rows: DataFrame, inputs: Sequence[str], **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, dear expressions over ``inputs`` alone, worked out once for each of their distinct values (nulls are a value)."""
    keyed = rows.withColumn("__value", F.sha2(F.to_json(F.struct(*inputs)), 256))
    distinct = spread(keyed.groupBy("__value").agg(*[F.first(i).alias(i) for i in inputs]), "__value")
    return keyed.join(distinct.select("__value", *[v.alias(k) for k, v in columns.items()]), "__value").drop("__value")


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in ``order``; give an order that ends in a unique key."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def latest_per_parent(df: DataFrame, parent: str, at: str, *columns: str) -> DataFrame:
    """The newest row's columns of each parent: a max_by aggregate, so rows are combined before the shuffle."""
    return df.groupBy(parent).agg(*[F.max_by(F.col(c), F.col(at)).alias(c) for c in (at, *columns)])


def newest(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def page(df: DataFrame, order: Sequence[Column], *, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Rows behind a key, one more than the page holds if there is a next page; ``next_after`` is its cursor."""
    rows = df.filter(F.col(key) > after).orderBy(key).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(key))  # limit + 1 rows
    numbered = rows.withColumn("__n", place)
    more = F.max("__n").over(Window.partitionBy()) > limit
    last = F.max(F.when(F.col("__n") == limit, F.col(key))).over(Window.partitionBy())
    return numbered.withColumn("next_after", F.when(more, last)).filter(F.col("__n") <= limit).drop("__n")


def zero_filled_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Rows of each value of a closed domain, 0 where there are none."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return values.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def priority_pick(df: DataFrame, group: Sequence[str], key: str, levels: Sequence[Column]) -> DataFrame:
    """Smallest key that meets the first level, else the second, and so on, else the smallest."""
    picks = [F.min(F.when(level, F.col(key))) for level in levels]
    return df.groupBy(*group).agg(F.coalesce(*picks, F.min(key)).alias(key))


#: Rows a side of a block of ``or_join``: a block gives 4 million pairs at most on average.
BLOCK = 2_000


def or_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], *, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of rows that agree on any pair of columns: a union of equi-joins, not a nested loop.

    Each id (null is one) stands once a side, with the sets of its keys, and a pair is taken by the first columns and the smallest key that it shares, so pairs are
    distinct without a shuffle.  A key of many rows is cut into blocks on both sides, which meet one by one.
    """
    a, b = [f"__a{i}" for i in range(len(pairs))], [f"__b{i}" for i in range(len(pairs))]
    l = left.groupBy(left_id).agg(*[F.collect_set(x).alias(n) for n, (x, _) in zip(a, pairs, strict=True)])  # noqa: E741
    r = right.groupBy(right_id).agg(*[F.collect_set(y).alias(n) for n, (_, y) in zip(b, pairs, strict=True)])
    parts = []
    for i in range(len(pairs)):
        mine, theirs = l.withColumn("__k", F.explode(a[i])), r.withColumn("__k", F.explode(b[i]))
        count = lambda rows, name: rows.groupBy("__k").agg(F.ceil(F.count("*") / BLOCK).alias(name))
        cuts = count(mine, "__nl").join(count(theirs, "__nr"), "__k")
        block = lambda x, n: F.pmod(F.xxhash64(x), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        mine = mine.join(cuts, "__k").withColumn("__x", block(left_id, "__nl")).withColumn("__y", every("__nr")).drop("__nl", "__nr")
        theirs = theirs.join(cuts, "__k").withColumn("__y", block(right_id, "__nr")).withColumn("__x", every("__nl")).drop("__nl", "__nr")
        met = mine.join(theirs.hint("shuffle_hash"), ["__k", "__x", "__y"])
        met = met.filter((F.size(a[i]) == 1) | (F.size(b[i]) == 1) | (F.col("__k") == F.array_min(F.array_intersect(a[i], b[i]))))
        for j in range(i):
            met = met.filter(~F.arrays_overlap(a[j], b[j]))
        parts.append(met.select(left_id, right_id))
    return reduce(DataFrame.unionByName, parts)


def unique_match(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """``left`` with ``value`` where exactly one distinct value of the right side matches, else null."""
    one = right.groupBy(*on).agg(F.min(value).alias(value), F.max(value).alias("__max")).filter(F.col(value) == F.col("__max")).drop("__max")
    return left.join(one, list(on), "left")


def lookup_own_else_group(rows: DataFrame, states: DataFrame, *, id_col: str, group_col: str, value: str) -> DataFrame:
    """A value by a row's own id, else by any member of its group (the smallest id that has one)."""
    own = states.select(F.col(id_col), F.col(value).alias("__own"))
    grouped = rows.select(id_col, group_col).join(states, id_col).filter(F.col(value).isNotNull()).groupBy(group_col).agg(F.min_by(value, id_col).alias("__group"))
    return rows.join(own, id_col, "left").join(grouped, group_col, "left").withColumn(value, F.coalesce("__own", "__group")).drop("__own", "__group")


def labels_of_current_text(labels: DataFrame, texts: DataFrame, *, id_col: str, stated: str = "stated", own: str = "own") -> DataFrame:
    """Labels whose stated text hash is that of the stored text; labels of other versions and of unknown rows go."""
    return labels.join(texts.select(id_col, own), id_col).filter(F.col(stated) == F.col(own)).drop(stated, own)


def against_all(rows: DataFrame, queries: DataFrame, *, most: int = 10_000) -> DataFrame:
    """Every row with every row of a query set.  The set is counted and broadcast in blocks of ``most`` rows on average, so any number of queries will do."""
    blocks = -(-queries.count() // most)
    if blocks <= 1:
        return rows.crossJoin(F.broadcast(queries))
    numbered = queries.withColumn("__block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)))
    return reduce(DataFrame.unionByName, [rows.crossJoin(F.broadcast(numbered.filter(F.col("__block") == b).drop("__block"))) for b in range(blocks)])


def interleave(df: DataFrame, bucket: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Round robin over buckets: every bucket's first row, then every second, up to ``limit`` rows."""
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    # The filter on a rank lets each task keep its own first ``limit`` rows of a bucket before the shuffle.
    return df.withColumn("turn", place).filter(F.col("turn") <= limit).orderBy("turn", bucket).limit(limit)


def greedy_one_to_one(df: DataFrame, left: str, right: str, order: Sequence[str]) -> DataFrame:
    """In priority order, keep a row if neither of its sides has been taken.

    The rule is sequential, but a row is surely kept if it comes first on both its sides; each round keeps those
    and drops what they exclude, so rounds are few and every one is a pair of aggregates and joins.
    """
    from vacantia.operators.storage import checkpoint

    key = F.struct(*order)
    rest, kept = checkpoint(df.withColumn("__key", key), "greedy"), None
    while not rest.isEmpty():
        by_left = rest.groupBy(left).agg(F.min("__key").alias("__l"))
        by_right = rest.groupBy(right).agg(F.min("__key").alias("__r"))
        won = checkpoint(rest.join(by_left, left).join(by_right, right).filter("__key = __l and __key = __r").drop("__l", "__r").dropDuplicates([left, right]).select(rest.columns), "greedy")
        kept = won if kept is None else kept.union(won)
        rest = checkpoint(rest.join(won.select(left), left, "left_anti").join(won.select(right), right, "left_anti").select(rest.columns), "greedy")
    return (rest if kept is None else kept).drop("__key")


def radius_join(points: DataFrame, centres: DataFrame, *, lat: str, lon: str, c_lat: str, c_lon: str, radius_km: float) -> DataFrame:
    """Pairs within a radius: equi-join on grid cells as wide as the radius, then the exact distance (column ``distance_m``).

    Centres are copied to the cells their circle can reach; at high latitudes that is more cells of longitude.
    """
    from vacantia.functions import geo

    size = radius_km / geo.KM_PER_DEGREE
    dlat, dlon = geo.degree_deltas(F.col(c_lat), F.lit(radius_km))
    cells = lambda c, d: F.sequence(F.floor((c - d) / size), F.floor((c + d) / size))
    wide = F.when(dlon >= 180, F.sequence(F.floor(F.lit(-180.0) / size), F.floor(F.lit(180.0) / size))).otherwise(cells(F.col(c_lon), dlon))
    spread = centres.withColumn("__y", F.explode(cells(F.col(c_lat), dlat))).withColumn("__x", F.explode(wide))
    located = points.withColumn("__y", geo.grid_cell(F.col(lat), size))
    both = located.withColumn("__turn", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)))).withColumn("__x", F.floor((F.col(lon) + F.col("__turn")) / size))
    joined = both.join(spread, ["__x", "__y"]).withColumn("distance_m", geo.haversine_m(F.col(lat), F.col(lon), F.col(c_lat), F.col(c_lon)))
    return joined.filter(F.col("distance_m") <= radius_km * 1000).drop("__x", "__y", "__turn").distinct()
