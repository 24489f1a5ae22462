"""Queries of whole searches, inventory pages, index queues, snapshots, sections and captured responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import vectors
from vacantia.operators import indexing, search, sections
from vacantia.plans.case_queries import area, area_rows
from vacantia.plans.catalog import Tables, query
from vacantia.sources import fetches

c = F.col

_KEPT = """e AS (SELECT *, c_custkey // 3 AS g FROM customer WHERE c_custkey % 8 IN (2, 3, 4, 5)), u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY g ORDER BY c_custkey % 4 DESC, c_custkey) = 1),
j AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 'profile_conflict' WHEN c_custkey % 101 < 30 THEN 'below_score' WHEN c_custkey % 5 = 0 THEN 'uncertain' END AS turned FROM u), s AS (SELECT * FROM j WHERE turned IS NULL)"""


def _search(t: Tables, order: str):
    k = c("c_custkey")
    more = {
        "job_id": k, "group": F.floor(k / 3), "is_active": F.lit(True), "description": F.repeat(F.lit("x"), (k % 4).cast("int")), "n_locations": F.lit(1), "score": k % 101, "conflict": k % 7 == 0, "uncertain": k % 5 == 0,
        "title": c("c_name"), "first_seen_at": F.concat(F.lit("2024-01-0"), k % 3 + 1), "date_posted": F.concat(F.lit("2023-12-0"), k % 4 + 1),
    }
    rows = area_rows(t, *[v.alias(n) for n, v in more.items()])
    return search.search_page(rows, order=order, offset=10, limit=20, minimum=30, include_unknown=False, **area())


@query(f"WITH {_KEPT} SELECT c_custkey AS job_id, c_custkey % 101 AS score, (SELECT count(*) FROM s) AS total FROM s ORDER BY c_custkey % 101 DESC, c_custkey % 3 DESC, c_custkey % 4 DESC, lower(c_name), c_custkey LIMIT 20 OFFSET 10")
def ot01_so02_search_page(t: Tables):
    return _search(t, "match")[0].select("job_id", "score", "total")


@query(f"WITH {_KEPT} SELECT c_custkey AS job_id FROM s ORDER BY c_custkey % 4 DESC, c_custkey % 101 DESC, c_custkey % 3 DESC, lower(c_name), c_custkey LIMIT 20 OFFSET 10")
def so02_posted_order(t: Tables):
    return _search(t, "posted")[0].select("job_id")


@query(f"WITH {_KEPT} SELECT c_custkey AS job_id FROM s ORDER BY c_custkey % 3 DESC, c_custkey % 101 DESC, c_custkey % 4 DESC, lower(c_name), c_custkey LIMIT 20 OFFSET 10")
def so02_discovered_order(t: Tables):
    return _search(t, "discovered")[0].select("job_id")


@query(f"""WITH {_KEPT} SELECT reason, count(*) AS n FROM (SELECT CASE c_custkey % 8 WHEN 0 THEN 'expired' WHEN 1 THEN 'remote_country' ELSE 'outside_area' END AS reason FROM customer WHERE c_custkey % 8 IN (0, 1, 6, 7)
UNION ALL SELECT turned FROM j WHERE turned IS NOT NULL) GROUP BY 1""")
def ot01_fil20_turned_away(t: Tables):
    return _search(t, "match")[1]


def _waiting(t: Tables):
    """Each nation owns an inventory; nations 0 to 4 have progress of another version, the others of this one."""
    k = c("n_nationkey")
    owners = t.nation.select(k.alias("owner"), F.lit("v2").alias("version"))
    started = F.timestamp_seconds(1_700_000_000 + (k * 7 + 11) % 25)
    return owners, t.nation.select(k.alias("owner"), F.when(k < 5, "v1").otherwise("v2").alias("version"), (k * 10).cast("bigint").alias("cursor"), F.when(k == 2, k * 10).otherwise(1000).cast("bigint").alias("high_water"), started.alias("advanced_at"))


# The longest wait is nation 2's: (2 * 7 + 11) % 25 = 0.
@query("SELECT 2 AS owner, o_orderkey FROM orders WHERE o_orderkey > 0 ORDER BY o_orderkey LIMIT 100")
def sm02_inventory_page(t: Tables):
    owners, progress = _waiting(t)
    page, _ = indexing.inventory_page(t.orders, owners, progress, F.lit("2024-01-01").cast("timestamp"), key="o_orderkey")
    return page.select(c("owner").cast("int").alias("owner"), "o_orderkey")


@query("""SELECT n_nationkey::INT AS owner, CASE WHEN n_nationkey BETWEEN 0 AND 4 AND n_nationkey <> 2 THEN 'v1' ELSE 'v2' END AS version, CASE WHEN n_nationkey = 2 THEN 100 ELSE n_nationkey * 10 END::BIGINT AS "cursor",
CASE WHEN n_nationkey = 2 THEN (SELECT max(o_orderkey) FROM orders) ELSE 1000 END::BIGINT AS high_water FROM nation""")
def sm02_inventory_progress(t: Tables):
    owners, progress = _waiting(t)
    _, after = indexing.inventory_page(t.orders, owners, progress, F.lit("2024-01-01").cast("timestamp"), key="o_orderkey")
    return after.select(c("owner").cast("int").alias("owner"), "version", "cursor", "high_water")


def _queue(t: Tables):
    """Every third part and every fourth supplier are queued; every second entry's lease is over or free."""
    at = F.timestamp_seconds
    entry = lambda kind, k: [F.lit(kind).alias("kind"), k.alias("id"), at(1_700_000_000 + k % 100).alias("queued_at"), F.when(k % 2 == 0, "old").alias("lease_token"), F.when(k % 2 == 0, F.when(k % 4 == 0, at(F.lit(1_700_000_500))).otherwise(at(F.lit(1_700_002_000)))).alias("lease_until")]
    parts = t.part.filter("p_partkey % 3 = 0").select(*entry("job", c("p_partkey")))
    return parts.unionByName(t.supplier.filter("s_suppkey % 4 = 0").select(*entry("company", c("s_suppkey"))))


_QUEUE = "q AS (SELECT 'job' AS kind, p_partkey AS id FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'company', s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)"
_MISSING = f"{_QUEUE}, m AS (SELECT * FROM (SELECT 'job' AS kind, p_partkey AS id FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'company', s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0) x WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.kind = x.kind AND q.id = x.id))"


@query(f"""WITH {_QUEUE}, f AS (SELECT *, id % 2 = 1 OR id % 4 = 0 AS free FROM q), r AS (SELECT *, free AND row_number() OVER (PARTITION BY free ORDER BY id % 100, kind, id) <= 50 AS mine FROM f)
SELECT kind, id, CASE WHEN mine THEN 'new' WHEN id % 2 = 0 THEN 'old' END AS lease_token, CASE WHEN mine THEN 1700001300 WHEN id % 4 = 0 THEN 1700000500 WHEN id % 2 = 0 THEN 1700002000 END::BIGINT AS until FROM r""")
def sm12_claim_refreshes(t: Tables):
    out = indexing.claim_refreshes(_queue(t), F.timestamp_seconds(F.lit(1_700_001_000)), "new", lease_s=300, limit=50)
    return out.select("kind", "id", "lease_token", F.unix_seconds("lease_until").alias("until"))


def _missing(t: Tables):
    entities = t.part.select(F.lit("job").alias("kind"), c("p_partkey").alias("id")).union(t.supplier.select(F.lit("company"), "s_suppkey"))
    documents = entities.select("kind", "id", F.when(c("id") % 5 == 0, "m2").otherwise("m1").alias("model_revision"))
    return indexing.missing_vectors(entities, documents, _queue(t), "m2")


@query(f"WITH {_MISSING} SELECT kind, id FROM m")
def sm12_missing_vectors(t: Tables):
    return _missing(t)


@query(f"WITH {_MISSING} SELECT kind, id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS turn FROM m) ORDER BY turn, kind DESC LIMIT 33")
def sm12_backfill_batch(t: Tables):
    return indexing.backfill_batch(_missing(t), 33)


@query("SELECT * FROM (VALUES ('job', false), ('company', false), ('nation', true)) v(kind, complete)")
def sm12_backfill_complete(t: Tables):
    kinds = t.spark.createDataFrame([("job",), ("company",), ("nation",)], "kind string")
    return indexing.backfill_complete(kinds, _missing(t), _queue(t))


@query("""WITH s AS (SELECT o_orderkey AS key, o_orderkey % 2 = 0 AS warm, o_orderkey AS minutes FROM orders), n AS (SELECT key FROM s WHERE NOT warm AND key <> 701 ORDER BY minutes, key LIMIT 32)
SELECT key FROM s WHERE key = 701 OR (warm AND minutes <= 15) OR (NOT warm AND minutes <= 1440 AND key IN (SELECT key FROM n))""")
def snk07_evict(t: Tables):
    rows = t.orders.select(c("o_orderkey").alias("key"), F.timestamp_seconds(1_700_000_000 - c("o_orderkey") * 60).alias("created_at"), (c("o_orderkey") % 2 == 0).alias("is_prewarmed"))
    return search.evict(rows, F.timestamp_seconds(F.lit(1_700_000_000)), preserve=701).select("key")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT vec_id, list_transform(range(1, len(e) + 1), lambda i: (e[i] + e[len(e) + 1 - i]) / 2) AS m FROM e)
SELECT vec_id, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 5) AS first, round(m[2] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 5) AS second FROM m""")
def sc56_masked_mean_pool(t: Tables):
    states = F.array("embedding", F.transform("embedding", lambda x: x * 9 + 1), F.reverse("embedding"))
    pooled = vectors.masked_mean_pool(states, F.array(F.lit(1), F.lit(0), F.lit(1)))
    return t.embeddings.select("vec_id", F.round(pooled[0], 5).alias("first"), F.round(pooled[1], 5).alias("second"))


@query("""SELECT p_partkey, 1 AS n, 'description' AS source, 'requirements' AS scope, 'Knowledge of ' || p_brand || ' wrenches needed.' AS text FROM part
UNION ALL SELECT p_partkey, 2, 'detail', 'neutral', 'Part ' || p_partkey || ' must be understood well.' FROM part""")
def sc22_posting_sections(t: Tables):
    """Two sources a part: a posting with requirements, benefits and options, and a detail that repeats itself."""
    key = c("p_partkey").cast("string")
    description = F.concat(F.lit("Short one.\nYour profile:\nKnowledge of "), "p_brand", F.lit(" wrenches needed.\nWe offer:\nFree fruit on every day.\nNice to have:\nA second wrench of yours."))
    detail = F.concat(F.lit("Part "), key, F.lit(" must be understood well.\nOur company makes such parts daily.\nPart "), key, F.lit(" must be understood well."))
    both = t.part.select("p_partkey", F.lit("description").alias("source"), F.lit(0).alias("source_rank"), description.alias("text")).union(t.part.select("p_partkey", F.lit("detail"), F.lit(1), detail))
    return sections.posting_sections(both, id_col="p_partkey")


# A chain runs from each customer to the next multiple of ten.
@query("""WITH r AS (SELECT c_custkey AS k, (10 - c_custkey % 10) % 10 AS d, (SELECT max(c_custkey) FROM customer) AS top FROM customer)
SELECT 'http://h.example/c/' || k AS url, CASE WHEN d > 5 THEN 'redirect_limit' WHEN k + d > top THEN 'not_captured' WHEN (k + d) % 20 = 0 THEN 'bot_challenge' ELSE 'fetched' END AS state,
CASE WHEN d <= 5 THEN 'http://h.example/c/' || (k + d) END AS final_url, CASE WHEN d > 5 THEN 6 WHEN k + d > top THEN d ELSE d + 1 END::INT AS n_read FROM r""")
def ot27_outcomes(t: Tables):
    k, onward = c("c_custkey"), (c("c_custkey") + 1).cast("string")
    url = F.concat(F.lit("http://h.example/c/"), k.cast("string"))
    location = F.when(k % 3 == 0, F.concat(F.lit("/c/"), onward)).when(k % 3 == 1, onward).otherwise(F.concat(F.lit("//h.example/c/"), onward))
    status = F.when(k % 10 == 0, 200).when(k % 2 == 0, 301).otherwise(308)
    responses = t.customer.select(url.alias("url"), status.alias("status"), F.when(status > 300, location).alias("location"), (k % 20 == 0).alias("challenge"))
    return fetches.outcomes(t.customer.select(url.alias("url")), responses)
