"""Queries of discovery: searches under a budget, frontiers over captured pages, and tiles of a map."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vacantia.operators import company_search, frontier, invalidation, partitions
from vacantia.operators.storage import shared_dir
from vacantia.plans.catalog import Tables, query
from vacantia.sources import archives, tiles
from vacantia.streaming.queues import VersionedTable

c = F.col


@query()
def ot35_frontier(t: Tables):
    """The first ten pages as employers; links, scores and redirects from the page numbers (compared with a heap in the tests)."""
    n = t.pages.count()
    k = c("page_id")
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    link = lambda x, score: F.struct(name(x % n).alias("url"), score.cast("double").alias("score"))
    links = F.array(link(k * 3 + 1, k * 37 % 100), link(k * 5 + 2, k * 53 % 100), link(k + 10, F.lit(50)))
    captures = t.pages.select(name(k).alias("url"), F.when(k % 11 == 3, name(k - k % 11)).otherwise(name(k)).alias("final_url"), F.when(k % 13 == 5, "http_error").otherwise("ok").alias("state"), links.alias("links"))
    return frontier.discover(t.pages.filter(k < 10).select(k.alias("employer"), name(k).alias("url")), captures, max_pages=6, max_depth=3)


def _stage(k: int, before: str, allowed: str) -> str:
    """Stage k of the search plan in SQL: who still asks, which new queries fit in, and who is settled then."""
    prior = "".join(f" AND NOT EXISTS (SELECT 1 FROM d{j} d WHERE d.company = p.company)" for j in range(k))
    known = " UNION ALL ".join(f"SELECT query FROM n{j}" for j in range(k)) or "SELECT '' WHERE false"
    return f"""a{k} AS (SELECT * FROM p WHERE stage = {k}{prior}),
f{k} AS (SELECT query, min((rank, company)) AS first FROM a{k} WHERE query NOT IN ({known}) GROUP BY 1),
n{k} AS (SELECT query, first.company AS payer FROM (SELECT *, row_number() OVER (ORDER BY first, query) AS r FROM (SELECT query, struct_pack(rank := first[1], company := first[2]) AS first FROM f{k})) WHERE r <= {allowed}),
l{k} AS (SELECT {before} - (SELECT count(*) FROM n{k}) AS n),
d{k} AS (SELECT company FROM a{k} WHERE resolves AND query IN ({known} UNION ALL SELECT query FROM n{k}))"""


_OT07 = ",\n".join([
    """p AS (SELECT c_custkey AS company, c_custkey * 7919 % 100003 AS rank, stage, CASE stage WHEN 0 THEN c_mktsegment || c_custkey % 90 WHEN 1 THEN c_mktsegment || c_custkey % 140 ELSE 'n' || c_nationkey || '-' || c_custkey % 40 END AS query, (c_custkey + stage) % 3 = 0 AS resolves
FROM customer, (SELECT unnest([0, 1, 2]) AS stage))""",
    _stage(0, "400", "266"), _stage(1, "(SELECT n FROM l0)", "(SELECT greatest(1, n * 2 // 3) FROM l0)"), _stage(2, "(SELECT n FROM l1)", "(SELECT n FROM l1)"),
])
_OT07 = f"WITH {_OT07}\n" + " UNION ALL ".join(
    f"SELECT company, stage, a.query, coalesce(n.payer = company, false) AS runs, a.query IN ({' UNION ALL '.join(f'SELECT query FROM n{j}' for j in range(k + 1))}) AS answered FROM a{k} a LEFT JOIN n{k} n ON n.query = a.query" for k in range(3)
)


@query(_OT07)
def ot07_budgeted_searches(t: Tables):
    """Three queries a customer, many of them shared, under 400 searches."""
    k, s = c("c_custkey"), c("stage")
    key = k.cast("string")
    text = F.when(s == 0, F.concat("c_mktsegment", (k % 90).cast("string"))).when(s == 1, F.concat("c_mktsegment", (k % 140).cast("string"))).otherwise(F.concat(F.lit("n"), c("c_nationkey").cast("string"), F.lit("-"), (k % 40).cast("string")))
    rows = t.customer.withColumn("stage", F.explode(F.array(*map(F.lit, range(3))))).withColumn("key", key)
    return frontier.budgeted_searches(rows.select(k.alias("company"), (k * 7919 % 100003).alias("rank"), "stage", text.alias("query"), ((k + s) % 3 == 0).alias("resolves")), 400)


_COMPLETE = "(round(south * 64)::BIGINT + 3 * round(west * 64)::BIGINT + 5 * round(east * 64)::BIGINT) % 3 <> 1"


@query(f"""WITH RECURSIVE a AS (SELECT s_suppkey AS area, (s_suppkey % 50)::DOUBLE AS s, (s_suppkey * 2)::DOUBLE AS w FROM supplier),
b AS (SELECT area, (s + i * 0.5)::DOUBLE AS south, (w + j * 0.5)::DOUBLE AS west, least(s + 0.75, s + (i + 1) * 0.5)::DOUBLE AS north, (w + (j + 1) * 0.5)::DOUBLE AS east, 0 AS depth FROM a, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)
UNION ALL SELECT area, CASE WHEN q < 2 THEN south ELSE (south + north) / 2 END, CASE WHEN q % 2 = 0 THEN west ELSE (west + east) / 2 END, CASE WHEN q < 2 THEN (south + north) / 2 ELSE north END, CASE WHEN q % 2 = 0 THEN (west + east) / 2 ELSE east END, depth + 1
FROM b, (SELECT unnest([0, 1, 2, 3]) AS q) WHERE depth < 2 AND NOT {_COMPLETE})
SELECT area, south::DOUBLE AS south, west::DOUBLE AS west, north::DOUBLE AS north, east::DOUBLE AS east, depth, CASE WHEN {_COMPLETE} THEN 'done' WHEN depth = 2 THEN 'failed' ELSE 'split' END AS state FROM b""")
def src23_adaptive_tiles(t: Tables):
    """A box a supplier; which tiles are answered whole follows from their corners.  The first round's cursor is stored, a second call resumes it."""
    k = c("s_suppkey")
    areas = t.supplier.select(k.cast("string").alias("area"), (k % 50 + F.lit(0.0)).alias("south"), (k * F.lit(2.0)).alias("west"), (k % 50 + F.lit(0.75)).alias("north"), (k * F.lit(2.0) + 1).alias("east"))
    level = tiles.first_tiles(areas)
    boxes = level
    for _ in range(tiles.MOST):
        level = level.select("area", F.explode(tiles.quadrants(c("south"), c("west"), c("north"), c("east"))).alias("q")).select("area", "q.*")
        boxes = boxes.select("south", "west", "north", "east").union(level.select("south", "west", "north", "east"))
    whole = (F.round(c("south") * 64).cast("bigint") + 3 * F.round(c("west") * 64).cast("bigint") + 5 * F.round(c("east") * 64).cast("bigint")) % 3 != 1
    answers = boxes.withColumn("complete", whole)
    table = VersionedTable(t.spark, f"{shared_dir(t.spark)}/vacantia/tiles-{uuid.uuid4().hex}", tiles.CURSOR)
    tiles.inventory(areas, answers, table, rounds=1)
    return tiles.inventory(areas, answers, table).withColumn("area", c("area").cast("bigint"))


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, sum((o_totalprice * CASE WHEN year(o_orderdate) = 1995 THEN 2 ELSE 1 END)::DECIMAL(18, 2))::DOUBLE AS total
FROM orders WHERE year(o_orderdate) <> 1995 OR o_orderkey % 2 = 0 GROUP BY 1""")
def snk06_partition_overwrite(t: Tables):
    """Orders by month; 1995 is replaced by its even orders at twice the price, twice with the same token."""
    import datetime as dt

    rows = t.orders.select(F.trunc(c("o_orderdate").cast("date"), "month").alias("month"), "o_orderkey", c("o_totalprice").cast("decimal(18,2)").alias("price"))
    table = partitions.PartitionedTable(t.spark, f"{shared_dir(t.spark)}/vacantia/orders-{uuid.uuid4().hex}", "month date, o_orderkey bigint, price decimal(18,2)", "month")
    table.replace(rows, dt.date(1900, 1, 1), dt.date(2100, 1, 1), "load")
    again = rows.filter("year(month) = 1995 and o_orderkey % 2 = 0").withColumn("price", (c("price") * 2).cast("decimal(18,2)"))
    for _ in range(2):
        table.replace(again, dt.date(1995, 1, 1), dt.date(1996, 1, 1), "fix")
    return table.read().groupBy("month").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("total"))


@query("SELECT c_nationkey || '/' || c_custkey // 500 AS archive, c_custkey, c_name AS name, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 500 ORDER BY c_custkey) - 1 AS row FROM customer")
def src18_archive_members(t: Tables):
    """Customers packed into archives of 500 keys and a nation, with preamble lines and an unrelated member; read back."""
    import io
    import zipfile

    import pandas as pd

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, rows = io.BytesIO(), rows.sort_values("c_custkey")
        lines = [f'{k};"{n}";{s}' for k, n, s in zip(rows["c_custkey"], rows["c_name"], rows["c_mktsegment"], strict=True)]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("notes.txt", "Key;nothing\n")
            z.writestr("results.csv", "\n".join(["﻿Customers", "", "Key;Name;Segment", *lines]))
        return pd.DataFrame({"path": [f"{key[0]}/{key[1]}"], "content": [out.getvalue()]})

    packed = t.customer.groupBy("c_nationkey", F.floor(c("c_custkey") / 500).alias("block")).applyInPandas(pack, "path string, content binary")
    rows = archives.read_members(packed, member="results.csv", first="Key")
    return rows.select("archive", c("cells")["Key"].cast("bigint").alias("c_custkey"), c("cells")["Name"].alias("name"), c("cells")["Segment"].alias("segment"), "row")


# Orders are postings, customers profiles; every seventh customer and every fifth of the first thousand postings changes, every eleventh of these is gone.
@query("""WITH a AS (SELECT o_custkey AS p, o_orderkey AS j FROM orders), cj AS (SELECT o_orderkey AS j FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 11 = 0), cp AS (SELECT c_custkey AS p FROM customer WHERE c_custkey % 7 = 0)
SELECT 'assessment' AS what, p AS a, j AS b FROM a WHERE j NOT IN (SELECT j FROM cj) AND p NOT IN (SELECT p FROM cp)
UNION ALL SELECT 'vector', j, 0 FROM a WHERE j NOT IN (SELECT j FROM cj) UNION ALL SELECT 'reset', p, 0 FROM (SELECT p FROM cp UNION SELECT p FROM a WHERE j IN (SELECT j FROM cj))""")
def ot29_hash_cascade(t: Tables):
    """What is left of vectors and assessments, and whose match index is reset."""
    k = c("o_orderkey")
    jobs = t.orders.select(k.alias("id"), "o_orderpriority", "o_orderstatus")
    after = jobs.filter("id % 11 <> 0").withColumn("o_orderstatus", F.when(c("id") % 5 == 0, "new").otherwise(c("o_orderstatus")))
    people = t.customer.select(c("c_custkey").alias("id"), "c_name")
    columns = ["o_orderpriority", "o_orderstatus"]
    vectors = jobs.select(F.lit("job").alias("kind"), "id", invalidation.content_hash(*columns).alias("source_hash"))
    assessments = t.orders.select(c("o_custkey").alias("profile_id"), k.alias("job_id"))
    changed_people = invalidation.changed(people, people.withColumn("c_name", F.when(c("id") % 7 == 0, "new").otherwise(c("c_name"))), "id", ["c_name"])
    out = invalidation.cascade(invalidation.changed(jobs, after, "id", columns), changed_people, vectors, assessments)
    zero = F.lit(0).cast("bigint")
    kept = out.assessments.select(F.lit("assessment").alias("what"), c("profile_id").alias("a"), c("job_id").alias("b"))
    return kept.union(out.vectors.select(F.lit("vector"), "id", zero)).union(out.reset.select(F.lit("reset"), "profile_id", zero))


def _companies(t: Tables):
    return t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name"), (46 + c("c_custkey") * 7 % 90 / 10.0).alias("lat"), (5 + c("c_custkey") * 13 % 110 / 10.0).alias("lon"), "c_nationkey")


_COSINE = "1 - list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 50))"


@query(f"SELECT c_custkey AS id, (SELECT count(*) FROM customer JOIN embeddings e ON e.vec_id = c_custkey WHERE c_nationkey < 9) AS total FROM customer JOIN embeddings e ON e.vec_id = c_custkey WHERE c_nationkey < 9 ORDER BY {_COSINE}, c_custkey LIMIT 20")
def ot02_semantic_step(t: Tables):
    """Companies with a vector in scope, nearest first; all lists are looked into, so the order is exact."""
    docs = t.embeddings.select(c("vec_id").alias("id"), "embedding")
    index = company_search.build_index(docs, lists=16, probes=16)
    asked = [float(x) for x in docs.filter("id = 50").first()["embedding"]]
    page, total, _ = company_search.search_companies(_companies(t), index, vector=asked, where=c("c_nationkey") < 9, limit=20)
    return page.select("id", F.lit(total).cast("bigint").alias("total"))


@query("SELECT true AS enough, (SELECT count(*) FROM embeddings) AS indexed")
def ot02_index_recall(t: Tables):
    """Recall of the five nearest over every id divisible by 50 against full comparison: 0.9 at least."""
    docs = t.embeddings.select(c("vec_id").alias("id"), "embedding")
    index = company_search.build_index(docs, lists=32, probes=24)
    found = company_search.recall(index, docs, docs.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), 5)
    return index.rows.agg(F.lit(found >= 0.9).alias("enough"), F.count("*").alias("indexed"))


@query("SELECT c_custkey AS id, 'keyword' AS mode FROM customer WHERE contains(lower(c_name), '007') AND c_nationkey % 2 = 0 ORDER BY lower(c_name), c_custkey LIMIT 15 OFFSET 3")
def ot02_keyword_step(t: Tables):
    page, _, mode = company_search.search_companies(_companies(t), None, text=" 007 ", vector=[1.0], where=c("c_nationkey") % 2 == 0, offset=3, limit=15)
    return page.select("id", F.lit(mode).alias("mode"))


@query("""WITH p AS (SELECT c_custkey, c_name, 46 + c_custkey * 7 % 90 / 10.0 AS lat, 5 + c_custkey * 13 % 110 / 10.0 AS lon FROM customer),
d AS (SELECT *, 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(lat - 50) / 2), 2) + cos(radians(50)) * cos(radians(lat)) * pow(sin(radians(lon - 8) / 2), 2)))) AS m FROM p)
SELECT c_custkey AS id, (SELECT count(*) FROM d WHERE m <= 150000) AS total FROM d WHERE m <= 150000 ORDER BY round(m, 3), lower(c_name), c_custkey LIMIT 25""")
def ot02_browse_radius(t: Tables):
    page, total, _ = company_search.search_companies(_companies(t), None, within=(50.0, 8.0, 150.0), limit=25)
    return page.select("id", F.lit(total).cast("bigint").alias("total"))
