"""Aggregates, metrics, writes as joins, matching and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import analytics, matching, relational, upserts
from vacantia.operators.storage import checkpoint
from vacantia.plans.catalog import Tables, query
from vacantia.streaming import queues, windows

c = F.col
_NOW = "TIMESTAMP '1998-06-01'"


def _now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


@query(f"""WITH r AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 30 ELSE 3 END AS d, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS due_at FROM orders)
SELECT count(*) AS total, count(*) FILTER (coalesce(d, 7) = 1) AS daily, count(*) FILTER (coalesce(d, 7) = 7) AS weekly, count(*) FILTER (coalesce(d, 7) = 30) AS monthly, count(*) FILTER (coalesce(d, 7) NOT IN (1, 7, 30)) AS other,
count(*) FILTER (due_at <= {_NOW}) AS due, count(*) FILTER (due_at <= {_NOW} - INTERVAL 24 HOUR) AS overdue, count(*) FILTER (due_at IS NULL) AS unscheduled FROM r""")
def health_counts(t: Tables):
    k = c("o_orderkey") % 5
    roots = t.orders.select(F.when(k == 1, 1).when(k == 2, 7).when(k == 3, 30).when(k == 4, 3).alias("interval_days"), F.when(c("o_orderkey") % 11 != 0, c("o_orderdate")).alias("next_at"))
    return analytics.health_counts(roots, _now())


@query("""WITH e AS (SELECT event_id % 90 AS job, ts, event_type = 'error' AS legacy FROM events WHERE event_type IN ('signup', 'purchase', 'error')), f AS (SELECT job, date_trunc('week', min(ts)) AS week FROM e WHERE NOT legacy GROUP BY 1), w AS (SELECT week, count(*) AS n FROM f GROUP BY 1),
g AS (SELECT week, week::DATE - (row_number() OVER (ORDER BY week) * 7)::INT AS island FROM w WHERE n >= 10), r AS (SELECT max(week) AS last, count(*) AS len FROM g GROUP BY island)
SELECT coalesce((SELECT sum(n) FROM w WHERE week = DATE '2024-01-08'), 0)::BIGINT AS applied_this_week, (SELECT count(DISTINCT job) FROM e) AS lifetime, coalesce((SELECT len FROM r WHERE last IN (DATE '2024-01-08', DATE '2024-01-01') ORDER BY last DESC LIMIT 1), 0) AS successful_weeks""")
def weekly_streak(t: Tables):
    e = t.events.filter(c("event_type").isin("signup", "purchase", "error")).select((c("event_id") % 90).alias("job"), c("ts").cast("timestamp").alias("occurred_at"), (c("event_type") == "error").alias("is_legacy"))
    return analytics.weekly_streak(e, F.lit("2024-01-10 12:00:00").cast("timestamp"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 17999999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rolling_budget(t: Tables):
    return analytics.rolling_count(t.events, ["user_id"], "ts", 5).select("event_id", "in_window")


@query("""WITH p AS (SELECT l_suppkey, l_returnflag, sum(l_linenumber) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, sum(n) AS total, max(n) AS most FROM p GROUP BY 1)
SELECT l_suppkey, any_value(total)::BIGINT AS total, string_agg(l_returnflag, ' / ' ORDER BY l_returnflag) AS leading, round(100 * any_value(most)::DOUBLE / any_value(total), 2) AS leading_share FROM p JOIN m USING (l_suppkey) WHERE n = most GROUP BY 1""")
def vote_shares_ties(t: Tables):
    return analytics.shares_with_ties(t.lineitem, ["l_suppkey"], "l_returnflag", "l_linenumber")


@query("""SELECT l_orderkey, round(sum(g) / greatest(1, sum(w)), 9) AS coverage FROM (SELECT l_orderkey, l_returnflag, max(l_quantity) AS w, max(l_quantity * l_discount * 10) AS g FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def ag16_weighted_coverage(t: Tables):
    rows = t.lineitem.withColumn("got", c("l_quantity") * c("l_discount") * 10)
    out = analytics.best_weight_coverage(rows, ["l_orderkey"], "l_returnflag", "l_quantity", "got")
    return out.select("l_orderkey", F.round("coverage", 9).alias("coverage"))


_REQ = """r AS (SELECT l_orderkey, ['supported', 'transferable', 'missing', 'unknown'][l_linenumber % 4 + 1] AS status, CASE WHEN l_partkey % 2 = 0 THEN 'close' ELSE 'far' END AS dist, CASE WHEN l_partkey % 3 = 0 THEN 'tool' ELSE 'capability' END AS cat,
CASE WHEN l_returnflag = 'R' THEN 'preferred' ELSE 'required' END AS prio, CASE WHEN l_linestatus = 'O' THEN 'core' ELSE 'supporting' END AS imp, l_partkey % 2 AS quote FROM lineitem),
k AS (SELECT *, CASE WHEN prio = 'preferred' THEN 0.25::DOUBLE ELSE 1 END AS w, CASE WHEN status = 'supported' THEN 1::DOUBLE WHEN status = 'transferable' THEN CASE WHEN dist = 'close' AND cat = 'capability' THEN 0.8::DOUBLE ELSE 0.5 END ELSE 0 END AS credit FROM r)"""


def _requirements(t: Tables):
    status = F.element_at(F.array(*map(F.lit, ("supported", "transferable", "missing", "unknown"))), c("l_linenumber") % 4 + 1)
    return t.lineitem.select(
        "l_orderkey", status.alias("status"), F.when(c("l_partkey") % 2 == 0, "close").otherwise("far").alias("evidence_distance"), F.when(c("l_partkey") % 3 == 0, "tool").otherwise("capability").alias("category"),
        F.when(c("l_returnflag") == "R", "preferred").otherwise("required").alias("priority"), F.when(c("l_linestatus") == "O", "core").otherwise("supporting").alias("importance"), (c("l_partkey") % 2).alias("job_quote"),
    )


@query(f"WITH {_REQ} SELECT l_orderkey, round_even(100 * sum(CASE WHEN status <> 'unknown' THEN w * credit ELSE 0 END) / nullif(sum(CASE WHEN status <> 'unknown' THEN w ELSE 0 END), 0), 0)::BIGINT AS coverage, round_even(100 * sum(CASE WHEN status <> 'unknown' THEN w ELSE 0 END) / sum(w), 0)::BIGINT AS completeness FROM k GROUP BY 1")
def ag17_requirement_coverage(t: Tables):
    return analytics.requirement_summary(_requirements(t), ["l_orderkey"])


@query(f"""WITH {_REQ}, q AS (SELECT l_orderkey, imp, prio, quote, any_value(w) AS w, avg(credit) AS credit FROM k GROUP BY 1, 2, 3, 4), s AS (SELECT l_orderkey, sum(w * credit) FILTER (imp = 'core') / sum(w) FILTER (imp = 'core') AS a, sum(w * credit) FILTER (imp = 'supporting') / sum(w) FILTER (imp = 'supporting') AS b FROM q GROUP BY 1)
SELECT l_orderkey, round_even(CASE WHEN a IS NULL THEN 0 ELSE a * CASE WHEN b IS NULL THEN 100 ELSE 85 END + coalesce(b * 15, 0) END, 0)::BIGINT AS score FROM s""")
def ag18_role_relevance(t: Tables):
    return analytics.role_relevance(_requirements(t), ["l_orderkey"])


@query("SELECT l_orderkey, round(sum(CASE WHEN l_tax > 0.02 THEN l_tax END * l_quantity) / sum(CASE WHEN l_tax > 0.02 THEN l_quantity END), 9) AS component FROM lineitem GROUP BY 1")
def ag19_weighted_component(t: Tables):
    rows = t.lineitem.withColumn("score", F.when(c("l_tax") > 0.02, c("l_tax")))
    return analytics.weighted_component(rows, ["l_orderkey"], "score", "l_quantity").select("l_orderkey", F.round("component", 9).alias("component"))


_BM25 = """t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9äöüß+#]{2,}'), lambda w: w NOT IN ('the', 'and', 'of', 'to', 'in', 'a', 'for', 'with', 'der', 'die', 'das', 'und', 'in', 'mit', 'für', 'von')) AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9äöüß+#]{2,}'), lambda w: w NOT IN ('the', 'and', 'of', 'to', 'in', 'a', 'for', 'with', 'der', 'die', 'das', 'und', 'in', 'mit', 'für', 'von'))) AS term FROM benchmark),
b AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2)"""


def _bm25(t: Tables):
    return analytics.bm25(t.documents, t.benchmark, doc="doc_id", query="item_id")


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b) SELECT item_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10")
def bm25_top(t: Tables):
    return analytics.top_ranks(_bm25(t), query="item_id", doc="doc_id", k=10).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"""WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b), v AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM b WHERE doc_id % 3 = 0), z AS (SELECT item_id, max(rank) + 1 AS last FROM v GROUP BY 1)
SELECT r.item_id, r.doc_id, round(1.0::DOUBLE / (60 + r.rank) + 0.5::DOUBLE / (60 + coalesce(v.rank, z.last, 1)), 6) AS score FROM r LEFT JOIN v USING (item_id, doc_id) LEFT JOIN z USING (item_id) WHERE r.rank <= 20""")
def rrf_fusion(t: Tables):
    keys = {"query": "item_id", "doc": "doc_id"}
    scored = checkpoint(_bm25(t), "bm25")  # read twice
    first = checkpoint(analytics.top_ranks(scored, **keys, k=20).select("item_id", "doc_id", "rank"), "bm25-top")
    thirds = scored.filter("doc_id % 3 = 0").select("item_id", "doc_id")
    size = thirds.groupBy("item_id").agg((F.count("*") + 1).alias("last"))
    fused = analytics.fuse_ranks(first, analytics.places(thirds, first.filter("doc_id % 3 = 0"), **keys), **keys, weight=0.5, size=size)
    return fused.select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b), l AS (SELECT item_id, doc_id, quality + (1 - toxic) AS gain FROM labels, (SELECT DISTINCT item_id FROM q)),
g AS (SELECT r.item_id, rank, coalesce(gain, 0) AS gain FROM r LEFT JOIN l USING (item_id, doc_id)), a AS (SELECT item_id, sum(CASE WHEN rank <= 10 THEN (pow(2, gain) - 1) / log2(rank + 1) END) AS dcg, avg(CASE WHEN rank <= 10 THEN (gain > 0)::INT END) AS p, sum((gain > 0)::INT) AS hits FROM g GROUP BY 1),
i AS (SELECT item_id, sum(CASE WHEN place <= 10 THEN (pow(2, gain) - 1) / log2(place + 1) END) AS ideal, sum((gain > 0)::INT) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY gain DESC, doc_id) AS place FROM l) GROUP BY 1)
SELECT item_id, round(p, 4) AS precision_k, round(hits::DOUBLE / relevant, 4) AS recall, round(dcg / ideal, 4) AS ndcg_k FROM a JOIN i USING (item_id)""")
def ndcg_at_10(t: Tables):
    keys = {"query": "item_id", "doc": "doc_id"}
    scored = checkpoint(_bm25(t), "bm25")  # read twice
    labels = t.labels.select("doc_id", (c("quality") + (1 - c("toxic"))).alias("gain"))
    return analytics.ranking_metrics(analytics.top_ranks(scored, **keys, k=10).select("item_id", "doc_id", "rank"), labels, **keys, found=scored.select("item_id", "doc_id"))


@query("""WITH f AS (SELECT event_type AS stage, user_id AS key FROM events), m AS (SELECT key, min(stage) AS stage FROM f GROUP BY 1), n AS (SELECT stage, count(*) AS new FROM m GROUP BY 1)
SELECT stage, count(DISTINCT key) AS found, coalesce(any_value(new), 0) AS new, (sum(coalesce(any_value(new), 0)) OVER (ORDER BY stage))::BIGINT AS total FROM f LEFT JOIN n USING (stage) GROUP BY stage""")
def ag25_stage_yield(t: Tables):
    return analytics.stage_yield(t.events.select(c("event_type").alias("stage"), c("user_id").alias("key")), "stage", "key")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 0 WHEN c_acctbal >= 9000 THEN 100 WHEN recent THEN 90 WHEN n > 0 THEN 60 WHEN c_custkey % 4 >= 2 THEN 10 ELSE 30 END AS priority, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_acctbal >= 9000 THEN 1 WHEN recent THEN 1 WHEN n > 0 THEN 3 WHEN c_custkey % 4 >= 2 THEN 30 ELSE 7 END AS interval_days
FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n, coalesce(bool_or(o_orderdate BETWEEN {_NOW} - INTERVAL 30 DAY AND {_NOW}), false) AS recent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY 1, 2)""")
def ag26_crawl_rank(t: Tables):
    recent = F.coalesce(F.bool_or(c("o_orderdate").between(_now() - F.expr("interval 30 days"), _now())), F.lit(False))
    e = t.customer.join(t.orders.filter("o_orderstatus = 'O'"), c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey", "c_acctbal").agg(F.count("o_orderkey").alias("n"), recent.alias("recent"))
    rank = analytics.crawl_rank(F.when(c("c_acctbal") >= 9000, 250).otherwise(1), c("recent"), c("n") > 0, c("c_custkey") % 4, c("c_custkey") % 17 == 0)
    return e.select("c_custkey", rank.alias("r")).select("c_custkey", "r.priority", "r.interval_days")


@query("SELECT c_nationkey, round(avg(v), 2) AS share, coalesce(greatest(-10, least(10, round_even((25 - round(avg(v), 2)) / 25 * 10, 0)::INT)), 0) AS adjustment FROM (SELECT c_nationkey, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 50)::DOUBLE END AS v FROM customer) GROUP BY 1")
def ag28_mt12_location_adjustment(t: Tables):
    share = t.customer.groupBy("c_nationkey").agg(F.avg(F.when(c("c_custkey") % 3 > 0, (c("c_custkey") % 50).cast("double"))).alias("s"))
    return share.select("c_nationkey", F.round("s", 2).alias("share"), analytics.location_adjustment(c("s"), F.lit(10)).alias("adjustment"))


@query("SELECT count(DISTINCT coalesce(CASE WHEN user_id % 2 = 0 THEN user_id % 20 END, event_id)) AS logical, event_type FROM events GROUP BY 2")
def ag07_logical_jobs(t: Tables):
    return t.events.groupBy("event_type").agg(F.countDistinct(F.coalesce(F.when(c("user_id") % 2 == 0, c("user_id") % 20), c("event_id"))).alias("logical"))


@query("SELECT max(o_orderkey) AS generation, count(*) AS n, max(o_orderdate) AS newest FROM orders")
def ag08_ag09_generation(t: Tables):
    return t.orders.agg(F.max("o_orderkey").alias("generation"), F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))


# Orders of a customer on one day at one priority share a key; so do those of a customer with the same whole thousands of price.
@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderstatus <> 'F' AS live, o_orderpriority AS p, floor(o_totalprice / 50000) AS w FROM orders), e AS (SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON a.k = b.k AND (a.p = b.p AND a.id % 3 = 0 AND b.id % 3 = 0 OR a.w = b.w)),
r AS (SELECT id AS a, id AS b FROM o UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS id, min(b) AS grp FROM r GROUP BY 1) SELECT k AS company, count(DISTINCT grp) AS postings FROM o JOIN g USING (id) WHERE live GROUP BY 1""")
def ag10_distinct_postings(t: Tables):
    """Active orders of a customer after grouping by shared keys, active or not."""
    from vacantia.operators import dedupe

    key = c("o_orderkey")
    keys = t.orders.select(key.alias("job_id"), F.explode(F.array_compact(F.array(
        F.when(key % 3 == 0, F.concat_ws("|", F.lit("p"), "o_custkey", "o_orderpriority")), F.concat_ws("|", F.lit("w"), "o_custkey", F.floor(c("o_totalprice") / 50000).cast("string")),
    ))).alias("key"))
    rows = t.orders.select(key.alias("job_id"), F.when(key % 2 == 0, c("o_custkey")).alias("employer"), c("o_custkey").alias("company"), (c("o_orderstatus") != "F").alias("is_active"))
    return analytics.distinct_postings(rows, dedupe.group_by_keys(keys))


@query("SELECT o_orderpriority AS tier, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def ag11_fil20_tier_counts(t: Tables):
    n = t.orders.groupBy(c("o_orderpriority").alias("tier")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return n.select("tier", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("F", "O", "P")])


@query("SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_jobs, (SELECT count(DISTINCT o_custkey) FROM orders) AS employers, (SELECT count(*) FROM lineitem) AS rows")
def ag13_summary(t: Tables):
    one = lambda df, e, n: df.agg(e.alias(n))
    s = one(t.customer, F.count("*"), "companies").crossJoin(one(t.orders.filter("o_orderstatus = 'O'"), F.count("*"), "open_jobs"))
    return s.crossJoin(one(t.orders, F.countDistinct("o_custkey"), "employers")).crossJoin(one(t.lineitem, F.count("*"), "rows"))


@query("SELECT count(*) AS n, count(*) FILTER (text <> '') AS text, count(*) FILTER (lang <> '') AS lang FROM documents")
def ag22_field_coverage(t: Tables):
    return analytics.field_coverage(t.documents, ["text", "lang"])


@query("""SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS size, count(*) AS n, count(DISTINCT source) AS sources, round(1 - count(DISTINCT text)::DOUBLE / count(*), 6) AS repeated FROM documents GROUP BY 1, 2""")
def ag23_buckets(t: Tables):
    size = F.when(c("n_chars") < 500, "short").when(c("n_chars") < 5000, "medium").otherwise("long")
    return t.documents.groupBy("lang", size.alias("size")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.round(1 - F.countDistinct("text") / F.count("*"), 6).alias("repeated"))


@query("SELECT count(DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))) AS hosts, count(*) AS n FROM pages")
def ag24_hosts(t: Tables):
    from vacantia.functions import urls

    return t.pages.agg(F.countDistinct(urls.host(c("url"))).alias("hosts"), F.count("*").alias("n"))


@query("SELECT event_type, CASE WHEN max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 90 MINUTE THEN 'healthy' ELSE 'stale' END AS state FROM events GROUP BY 1")
def ag27_worker_health(t: Tables):
    limit = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz") - F.expr("interval 90 minutes")
    return t.events.groupBy("event_type").agg(F.when(F.max("ts") >= limit, "healthy").otherwise("stale").alias("state"))


@query("SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'purchase' GROUP BY 1")
def wn11_sm11_first_event(t: Tables):
    return t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first"))


_GEN = "c AS (SELECT o_custkey % 7 AS feed_id, o_orderkey AS external_id, o_orderpriority AS title, o_orderstatus <> 'F' AS is_active, 0 AS misses, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '1998-01-01' END AS closed_at FROM orders WHERE o_orderkey % 5 < 3), i AS (SELECT o_custkey % 7 AS feed_id, o_orderkey AS external_id, o_orderpriority || '!' AS title FROM orders WHERE o_orderkey % 5 > 1)"


@query(f"""WITH {_GEN} SELECT coalesce(c.feed_id, i.feed_id)::BIGINT AS feed_id, coalesce(c.external_id, i.external_id) AS external_id, CASE WHEN i.feed_id IS NOT NULL THEN i.title ELSE c.title END AS title,
CASE WHEN i.feed_id IS NOT NULL THEN true WHEN c.feed_id < 4 THEN false ELSE c.is_active END AS is_active, CASE WHEN i.feed_id IS NOT NULL THEN 0 WHEN c.feed_id < 4 THEN c.misses + 1 ELSE c.misses END AS misses,
CASE WHEN i.feed_id IS NOT NULL THEN NULL WHEN c.feed_id < 4 AND c.is_active THEN {_NOW} ELSE c.closed_at END AS closed_at,
CASE WHEN c.feed_id IS NULL THEN 'inserted' WHEN i.feed_id IS NOT NULL THEN 'updated' WHEN c.feed_id < 4 AND c.is_active THEN 'closed' ELSE 'kept' END AS change FROM c FULL JOIN i ON c.feed_id = i.feed_id AND c.external_id = i.external_id""")
def snapshot_diff_close(t: Tables):
    feed = (c("o_custkey") % 7).alias("feed_id")
    current = t.orders.filter("o_orderkey % 5 < 3").select(feed, c("o_orderkey").alias("external_id"), c("o_orderpriority").alias("title"), (c("o_orderstatus") != "F").alias("is_active"), F.lit(0).alias("misses"), F.when(c("o_orderstatus") == "F", F.lit("1998-01-01").cast("timestamp_ntz")).alias("closed_at"))
    incoming = t.orders.filter("o_orderkey % 5 > 1").select(feed, c("o_orderkey").alias("external_id"), F.concat("o_orderpriority", F.lit("!")).alias("title"))
    scans = t.spark.range(7).select(c("id").alias("feed_id"), (c("id") < 4).alias("complete"))
    return upserts.snapshot_diff(current, incoming, scans, _now(), fields=["title"])


def _states(t: Tables):
    return t.orders.filter("o_orderkey % 3 < 2").select(c("o_orderkey").alias("job_id"), F.lower("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("previous_status"))


@query("""WITH c AS (SELECT o_orderkey AS job_id, lower(o_orderstatus) AS status FROM orders WHERE o_orderkey % 3 < 2), i AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 'o' END AS status FROM orders WHERE o_orderkey % 3 > 0)
SELECT coalesce(c.job_id, i.job_id) AS job_id, coalesce(i.status, c.status) AS status, CASE WHEN i.status <> c.status THEN c.status END AS previous_status FROM c FULL JOIN i USING (job_id)""")
def upsert_keep_previous(t: Tables):
    new = t.orders.filter("o_orderkey % 3 > 0").select(c("o_orderkey").alias("job_id"), F.when(c("o_orderkey") % 2 == 0, "p").otherwise("o").alias("status"))
    return upserts.upsert_keeping_previous(_states(t), new, ["job_id"])


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 > 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def snk02_upsert(t: Tables):
    current = t.orders.filter("o_orderkey % 3 < 2").select(c("o_orderkey").alias("job_id"), c("o_orderstatus").alias("status"))
    return upserts.upsert(current, t.orders.filter("o_orderkey % 3 > 0").select(c("o_orderkey").alias("job_id"), F.lit("new").alias("status")), ["job_id"])


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus ELSE 'new' END AS status FROM orders")
def snk03_snk14_insert_new(t: Tables):
    current = t.orders.filter("o_orderkey % 3 < 2").select(c("o_orderkey").alias("job_id"), c("o_orderstatus").alias("status"))
    return upserts.insert_new(current, t.orders.filter("o_orderkey % 3 > 0").select(c("o_orderkey").alias("job_id"), F.lit("new").alias("status")), ["job_id"])


@query("""WITH a AS (SELECT o_orderkey AS job_id, ['applied', 'saved', 'accepted', 'offer'][o_orderkey % 4 + 1] AS s, o_custkey % 2 = 0 AS closed FROM orders)
SELECT job_id, CASE WHEN NOT closed OR s = 'accepted' THEN s WHEN s IN ('applied', 'interview', 'offer') THEN 'rejected' ELSE 'closed' END AS status, CASE WHEN closed AND s <> 'accepted' THEN s END AS previous_status FROM a""")
def snk05_close_states(t: Tables):
    s = F.element_at(F.array(*map(F.lit, ("applied", "saved", "accepted", "offer"))), (c("o_orderkey") % 4 + 1).cast("int"))
    apps = t.orders.select(c("o_orderkey").alias("job_id"), s.alias("status"), F.lit(None).cast("string").alias("previous_status"))
    return upserts.close_states(apps, t.orders.filter("o_custkey % 2 = 0").select(c("o_orderkey").alias("job_id")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS score FROM orders")
def snk06_replace_range(t: Tables):
    current = t.orders.select("o_orderkey", c("o_totalprice").alias("score"))
    scope = t.orders.filter("o_custkey % 3 = 0")
    return upserts.replace_range(current, scope.select("o_orderkey", (c("o_totalprice") * 2).alias("score")), scope, "o_orderkey")


@query("""WITH o AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber < 4), n AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 2)
SELECT *, 'kept' AS change FROM (SELECT * FROM o INTERSECT ALL SELECT * FROM n) UNION ALL SELECT *, 'added' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)""")
def snk08_children(t: Tables):
    rows = t.lineitem
    return upserts.replace_children(rows.filter("l_linenumber < 4").select("l_orderkey", "l_partkey"), rows.filter("l_linenumber > 2").select("l_orderkey", "l_partkey"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS summary, 'old ' || o_orderkey AS detail FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE 'x' END AS summary FROM orders)
SELECT n.k, n.summary, CASE WHEN o.summary = n.summary THEN o.detail END AS detail FROM n LEFT JOIN o USING (k)""")
def snk10_preserve_detail(t: Tables):
    old = t.orders.filter("o_orderkey % 2 = 0").select(c("o_orderkey").alias("k"), c("o_orderpriority").alias("summary"), F.concat(F.lit("old "), c("o_orderkey").cast("string")).alias("detail"))
    new = t.orders.select(c("o_orderkey").alias("k"), F.when(c("o_orderkey") % 4 == 0, c("o_orderpriority")).otherwise("x").alias("summary"), F.lit(None).cast("string").alias("detail"))
    return upserts.preserve_detail(old, new, "k")


@query("SELECT key, min(queued) AS queued_at, max(rev) AS revision FROM (SELECT user_id AS key, ts AS queued, event_id AS rev FROM events) GROUP BY 1")
def snk15_sm01_enqueue(t: Tables):
    rows = t.events.select(c("user_id").alias("key"), c("ts").alias("queued_at"), c("event_id").alias("revision"))
    return upserts.enqueue(rows.filter("revision % 2 = 0"), rows.filter("revision % 2 = 1"), "key")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def sm08_newest_revision(t: Tables):
    return queues.coalesced(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND (event_id % 3 = 0 OR ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-10') ORDER BY event_id % 5 DESC, ts, event_id LIMIT 20")
def sm09_claim(t: Tables):
    ts = c("ts")
    tasks = t.events.select(c("event_id").alias("id"), ts.alias("next_at"), F.when(c("event_id") % 3 != 0, ts + F.expr("interval 1 day")).alias("lease_until"), (c("event_id") % 5).alias("priority"))
    return queues.claimable(tasks, F.lit("2024-01-10").cast("timestamp_ntz"), limit=20).select(c("id").alias("event_id"))


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, ts FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type, ts FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, event_type, ts FROM events WHERE event_type = 'error') ORDER BY ts, event_id LIMIT 30")
def sm14_live_activity(t: Tables):
    parts = [t.events.filter(c("event_type") == k).select("event_id", "event_type", "ts") for k in ("click", "view", "error")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("ts", "event_id").limit(30).drop("ts")


@query(f"SELECT o_orderkey, o_orderdate + INTERVAL 90 DAY AS next_run_at FROM orders WHERE o_orderdate <= {_NOW}")
def sm13_recurring(t: Tables):
    return t.orders.filter(c("o_orderdate") <= _now()).select("o_orderkey", (c("o_orderdate") + F.expr("interval 90 days")).alias("next_run_at"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t: Tables):
    w = windows.tumbling(t.events, "1 day")
    return w.select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR) IS NOT TRUE AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(t: Tables):
    return windows.sessions(t.events, "1 hour").select("user_id", c("start").cast("timestamp_ntz").alias("start"), c("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT start, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1")
def events_late(t: Tables):
    return windows.sliding(t.events, "12 hours", "6 hours").select(c("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH p AS (SELECT item_id, item_id % 3 = 0 AS role, item_id % 3 = 1 AS sec FROM benchmark), x AS (SELECT item_id, doc_id, role, sec, CASE WHEN role THEN 55 WHEN sec THEN 35 ELSE 0 END + CASE WHEN role THEN 45 WHEN sec THEN 20 ELSE 25 END * (doc_id % 5)::DOUBLE / greatest(1, doc_id % 7) AS s, CASE WHEN (doc_id + item_id) % 4 = 0 THEN 20 ELSE 0 END AS pen, CASE WHEN doc_id % 9 = 0 THEN 59 ELSE 100 END AS lim FROM p, documents),
v AS (SELECT *, least(100, round_even(s, 0)::INT) AS v0 FROM x), w AS (SELECT *, greatest(0, least(lim, CASE WHEN pen > 0 THEN greatest(0, least(v0, 60) - least(40, pen)) ELSE v0 END)) AS score FROM v)
SELECT item_id, doc_id, score, CASE WHEN doc_id % 13 = 0 OR score < 30 THEN 'unlikely' WHEN score >= 65 AND doc_id % 2 = 0 THEN 'recommended' ELSE 'possible' END AS tier FROM w""")
def scored_cross_join(t: Tables):
    p = t.benchmark.select("item_id", (c("item_id") % 3 == 0).alias("role"), (c("item_id") % 3 == 1).alias("sec"))
    x = relational.against_all(t.documents.select("doc_id"), p)  # the items are the profiles
    s = matching.lexical_score(c("role"), c("sec"), F.lit(True), (c("doc_id") % 5).cast("double"), c("doc_id") % 7)
    pen, lim = F.when((c("doc_id") + c("item_id")) % 4 == 0, 20).otherwise(0), F.when(c("doc_id") % 9 == 0, 59).otherwise(100)
    x = x.withColumn("score", matching.adjusted_score(s, pen, lim, F.lit(0), F.lit(0), F.lit(0)))
    fit = F.when(c("doc_id") % 2 == 0, 100).otherwise(0)
    return x.select("item_id", "doc_id", "score", matching.tier(c("score"), fit, F.lit(False), c("doc_id") % 13 == 0, F.lit(False)).alias("tier"))


@query("""WITH l AS (SELECT doc_id AS job, doc_id % 80 AS score, md5(lang) AS h, CASE WHEN doc_id % 80 >= 65 THEN 'recommended' WHEN doc_id % 80 < 30 THEN 'unlikely' ELSE 'possible' END AS tier, doc_id % 11 > 0 AS ok FROM documents), a AS (SELECT doc_id AS job, md5(CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE lang END) AS h, quality * 60 + 20 AS s, toxic = 0 AS ok FROM labels JOIN documents USING (doc_id))
SELECT l.job, CASE WHEN a.s IS NOT NULL THEN a.s ELSE l.score END::BIGINT AS score, CASE WHEN a.s IS NOT NULL THEN CASE WHEN NOT (l.ok AND a.ok) OR a.s < 30 THEN 'unlikely' WHEN a.s >= 65 THEN 'recommended' ELSE 'possible' END WHEN l.ok AND l.tier = 'recommended' THEN 'possible' ELSE l.tier END AS tier, CASE WHEN a.s IS NOT NULL THEN 'llm' ELSE 'local' END AS score_source FROM l LEFT JOIN a ON l.job = a.job AND l.h = a.h""")
def assessment_overlay(t: Tables):
    s = c("doc_id") % 80
    local = t.documents.select(F.lit(1).alias("profile"), c("doc_id").alias("job"), F.md5("lang").alias("source_hash"), s.alias("score"), F.when(s >= 65, "recommended").when(s < 30, "unlikely").otherwise("possible").alias("tier"), (c("doc_id") % 11 > 0).alias("eligible"), F.lit(False).alias("mandatory_review"), F.lit(False).alias("language_review"))
    stored = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    a = stored.select(F.lit(1).alias("profile"), c("doc_id").alias("job"), F.md5(F.when(c("doc_id") % 4 == 0, "stale").otherwise(c("lang"))).alias("source_hash"), F.lit("v1").alias("version"), (c("quality") * 60 + 20).cast("bigint").alias("a_score"), (c("toxic") == 0).alias("a_eligible"), F.lit(False).alias("a_unresolved"))
    return matching.assessment_overlay(local, a, version="v1").select("job", "score", "tier", "score_source")


@query("""WITH j AS (SELECT l_orderkey, l_partkey % 40 AS name, CASE WHEN l_returnflag = 'R' THEN 0.25::DOUBLE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS w, l_returnflag = 'N' AND l_partkey % 40 % 2 = 1 AS special FROM lineitem), p AS (SELECT DISTINCT p_partkey % 40 AS name, CASE WHEN p_partkey % 40 % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END AS s FROM part WHERE p_partkey % 40 < 20),
n AS (SELECT l_orderkey, name, max(w) AS w, max(CASE WHEN w > 0 THEN w * s END) AS g, max(CASE WHEN special THEN s END) AS sp FROM j LEFT JOIN p USING (name) GROUP BY 1, 2), z AS (SELECT l_orderkey, sum(w) AS t, coalesce(sum(g), 0) AS o, coalesce(sum(sp), 0) AS sp FROM n GROUP BY 1)
SELECT l_orderkey, round_even(CASE WHEN sp >= 1 THEN least(85 * (o / greatest(1, t)), CASE WHEN sp >= 2 THEN 85 ELSE 59 END) ELSE 0 END, 0)::INT AS score, round(o / greatest(1, t), 3) AS coverage FROM z""")
def mt07_content_overlap(t: Tables):
    kind = F.when(c("l_returnflag") == "R", "optional").when(c("l_returnflag") == "A", "incidental").otherwise("mentioned")
    jobs = t.lineitem.select("l_orderkey", (c("l_partkey") % 40).alias("name"), kind.alias("kind"), (c("l_partkey") % 40 % 2 == 0).alias("general"))
    have = t.part.select((c("p_partkey") % 40).alias("name")).filter("name < 20").distinct().withColumn("strength", F.when(c("name") % 3 == 0, 0.5).otherwise(1.0))
    return matching.content_overlap(jobs, have, ["l_orderkey"])


@query("SELECT vec_id, CASE WHEN greatest(s, least(59, x)) > s THEN least(greatest(s, least(59, x)), greatest(59, s)) ELSE s END AS score FROM (SELECT vec_id, vec_id % 90 AS s, vec_id * 7 % 100 AS x FROM embeddings)")
def mt08_semantic_overlay(t: Tables):
    s = c("vec_id") % 90
    return t.embeddings.select("vec_id", matching.semantic_overlay(s, s, c("vec_id") * 7 % 100).alias("score"))


@query("SELECT doc_id, doc_id % 3 > 0 AND lang = 'en' AS eligible, CASE WHEN lang = 'en' THEN 'possible' ELSE 'unlikely' END AS tier FROM documents")
def mt13_scope_overlay(t: Tables):
    m = t.documents.select("doc_id", (c("doc_id") % 3 > 0).alias("eligible"), F.lit("possible").alias("tier"), (c("lang") == "en").alias("in_scope"))
    return matching.scope_overlay(m).select("doc_id", "eligible", "tier")


@query("""WITH p AS (SELECT l_orderkey AS feed, l_linenumber // 3 AS page, l_partkey AS id, (SELECT count(*) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey) AS total FROM lineitem l), g AS (SELECT feed, page, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT feed, count(*) AS pages, count(*) FILTER (n > 3) AS over FROM g GROUP BY 1)
SELECT p.feed, count(*) AS rows, count(*) = count(DISTINCT id) AND min(total) = max(total) AND count(*) = max(total) AND any_value(over) = 0 AND any_value(pages) <= 2 AS complete FROM p JOIN s USING (feed) GROUP BY 1""")
def src14_pages_complete(t: Tables):
    from vacantia.sources.feeds import pages_complete

    total = t.lineitem.groupBy(c("l_orderkey").alias("feed")).agg(F.count("*").alias("total"))
    pages = t.lineitem.select(c("l_orderkey").alias("feed"), F.floor(c("l_linenumber") / 3).alias("page"), c("l_partkey").alias("id")).join(total, "feed")
    return pages_complete(pages, feed="feed", page="page", ids="id", total="total", page_size=3, cap=2)


@query("SELECT o_orderpriority AS family, count(*) FILTER (o_orderstatus = 'O') AS filled, count(*) FILTER (o_orderstatus = 'F') AS missed, count(DISTINCT o_custkey) AS examples FROM orders GROUP BY 1")
def ot12_ot13_outcomes(t: Tables):
    return t.orders.groupBy(c("o_orderpriority").alias("family")).agg(F.count_if(c("o_orderstatus") == "O").alias("filled"), F.count_if(c("o_orderstatus") == "F").alias("missed"), F.countDistinct("o_custkey").alias("examples"))


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def ot21_empty_campaigns(t: Tables):
    return t.nation.join(t.supplier, c("n_nationkey") == c("s_nationkey"), "left_anti").select("n_nationkey")


@query("SELECT user_id, CASE max(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END) WHEN 5 THEN 'purchase' WHEN 4 THEN 'signup' WHEN 3 THEN 'click' WHEN 2 THEN 'view' ELSE 'error' END AS status FROM events GROUP BY 1")
def ot38_status_precedence(t: Tables):
    order = F.create_map(*[F.lit(x) for k, n in (("purchase", 5), ("signup", 4), ("click", 3), ("view", 2), ("error", 1)) for x in (k, n)])
    return t.events.groupBy("user_id").agg(F.max_by("event_type", order[c("event_type")]).alias("status"))
