"""Search, filter, join, set and window queries (employers: customer, supplier; feeds: nation; postings: orders, documents; runs: events)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia.functions import geo, strings, urls, vectors
from vacantia.operators import dedupe, relational, scope, search, spatial
from vacantia.plans.catalog import Tables, query

c = F.col


def _browse(t: Tables):
    jobs = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    hit = search.keyword_filter("urgent", [c("o_orderpriority"), c("c_name")]) | search.keyword_filter("high", [c("o_orderpriority")])
    return jobs.filter(hit & (c("o_orderstatus") == "O"))


@query("""SELECT o_orderkey, o_orderpriority, c_name, n_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE (o_orderpriority ILIKE '%urgent%' OR c_name ILIKE '%urgent%' OR o_orderpriority ILIKE '%high%') AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, lower(o_orderpriority), o_orderkey LIMIT 25 OFFSET 25""")
def search_browse_page(t: Tables):
    rows = _browse(t).select("o_orderkey", "o_orderpriority", "c_name", "n_name", "o_orderdate")
    return relational.page(rows, [c("o_orderdate").desc(), F.lower("o_orderpriority"), c("o_orderkey")], offset=25, limit=25)


@query("""SELECT count(*) AS total, count(DISTINCT o_custkey) AS employers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE (o_orderpriority ILIKE '%urgent%' OR c_name ILIKE '%urgent%' OR o_orderpriority ILIKE '%high%') AND o_orderstatus = 'O'""")
def ag01_ag02_page_totals(t: Tables):
    return _browse(t).agg(F.count("*").alias("total"), F.countDistinct("o_custkey").alias("employers"))


@query("SELECT s.s_suppkey, s.s_name, n.n_name, m.n_name AS employer_nation FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN nation m ON m.n_nationkey = s.s_nationkey AND m.n_regionkey = 1")
def employer_left_alias(t: Tables):
    n, m = t.nation.alias("n"), t.nation.filter("n_regionkey = 1").alias("m")
    return t.supplier.join(n, c("s_nationkey") == c("n.n_nationkey")).join(m, c("s_nationkey") == c("m.n_nationkey"), "left").select("s_suppkey", "s_name", c("n.n_name").alias("n_name"), c("m.n_name").alias("employer_nation"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_has_rows(t: Tables):
    return t.orders.join(t.lineitem.filter("l_quantity > 45"), c("o_orderkey") == c("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'))")
def jn04_nested_semi(t: Tables):
    returned = t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), c("o_orderkey") == c("l_orderkey"), "left_semi")
    return t.customer.join(returned, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unindexed(t: Tables):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def not_in_active(t: Tables):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P' and o_custkey is not null"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linestatus = 'O' AND l_returnflag = 'N' WHERE o_orderstatus = 'O'")
def jn07_constant_keys(t: Tables):
    return t.orders.filter("o_orderstatus = 'O'").join(t.lineitem.filter("l_linestatus = 'O' and l_returnflag = 'N'"), c("o_orderkey") == c("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS best, o.o_orderstatus FROM lineitem a LEFT JOIN (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25) b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber LEFT JOIN orders o ON o.o_orderkey = a.l_orderkey AND o.o_orderstatus = 'F'""")
def jn08_left_composite(t: Tables):
    best = t.lineitem.filter("l_quantity > 25").select("l_orderkey", "l_linenumber", c("l_quantity").alias("best"))
    groups = t.orders.filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return t.lineitem.select("l_orderkey", "l_linenumber").join(best, ["l_orderkey", "l_linenumber"], "left").join(groups, "l_orderkey", "left")


@query("SELECT DISTINCT c_custkey, s_suppkey FROM customer, supplier WHERE c_custkey = s_suppkey OR (c_nationkey * 1000 + length(c_mktsegment)) = (s_nationkey * 1000 + 8)")
def or_join_union(t: Tables):
    left = t.customer.withColumn("g", (c("c_nationkey") * 1000 + F.length("c_mktsegment")).cast("bigint"))
    right = t.supplier.withColumn("h", (c("s_nationkey") * 1000 + 8).cast("bigint"))
    return relational.or_join(left, right, [("c_custkey", "s_suppkey"), ("g", "h")], left_id="c_custkey", right_id="s_suppkey")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_run(t: Tables):
    return relational.latest_per_parent(t.events, "user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_row_per_group(t: Tables):
    return relational.best_per_group(t.orders, ["o_custkey"], [(c("o_orderstatus") == "O").desc(), c("o_totalprice").desc(), c("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 32")
def snk07_wn09_newest_32(t: Tables):
    return relational.newest(t.orders, ["o_orderstatus"], [c("o_orderdate").desc(), c("o_orderkey").desc()], 32).select("o_orderstatus", "o_orderkey")


@query("SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def wn03_first_per_key(t: Tables):
    return relational.best_per_group(t.customer.filter("c_acctbal > 0"), ["c_nationkey"], [c("c_custkey")]).select("c_nationkey", "c_custkey")


@query("""SELECT c_mktsegment AS d, coalesce(min(c_custkey) FILTER (c_acctbal > 5000 AND c_nationkey < 5), min(c_custkey) FILTER (c_acctbal > 5000), min(c_custkey)) AS c_custkey FROM customer GROUP BY 1""")
def priority_pick(t: Tables):
    rich = c("c_acctbal") > 5000
    return relational.priority_pick(t.customer.withColumnRenamed("c_mktsegment", "d"), ["d"], "c_custkey", [rich & (c("c_nationkey") < 5), rich])


@query("SELECT s AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s)")
def status_counts_zero_fill(t: Tables):
    return relational.zero_filled_counts(t.orders.withColumnRenamed("o_orderstatus", "status"), "status", ["F", "O", "P", "X"])


@query("SELECT o_orderkey, o_totalprice, CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey > 100) > 20 THEN (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 20)) END AS next_after FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 20")
def keyset_page(t: Tables):
    return relational.keyset_page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 20)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END ASC NULLS FIRST, o_orderkey LIMIT 10")
def claim_order(t: Tables):
    bucket = F.when(c("o_orderpriority") == "1-URGENT", 0).when(c("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    due = t.orders.filter(c("o_orderdate") <= F.to_timestamp(F.lit("1998-01-01")).cast("timestamp_ntz"))
    return due.orderBy(bucket, F.when(c("o_orderstatus") != "P", c("o_orderdate")).asc_nulls_first(), "o_orderkey").limit(10).select("o_orderkey")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS q, e.vec_id AS i, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM q, embeddings e),
r AS (SELECT q, i, round(1 - d, 4) AS similarity, row_number() OVER (PARTITION BY q ORDER BY d, i) AS rank FROM d) SELECT q AS query_id, i AS vec_id, similarity, rank FROM r WHERE rank <= 5""")
def vector_topk(t: Tables):
    found = search.vector_topk(t.embeddings, t.embeddings.filter("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "embedding"), item="vec_id", query="query_id", vector="embedding", k=5)
    return found.select("query_id", "vec_id", F.round(1 - c("distance"), 4).alias("similarity"), "rank")


def _placed(t: Tables):
    return t.supplier.select("s_suppkey", "s_name", (46 + c("s_suppkey") * 7 % 90 / 10.0).alias("lat"), (5 + c("s_suppkey") * 13 % 110 / 10.0).alias("lon"))


_PLACED = "p AS (SELECT s_suppkey, s_name, 46 + s_suppkey * 7 % 90 / 10.0::DOUBLE AS lat, 5 + s_suppkey * 13 % 110 / 10.0::DOUBLE AS lon FROM supplier)"
_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


@query(f"WITH {_PLACED} SELECT s_suppkey, round({_HAV.format(a='lat', b='lon', c='49.0', d='8.4')} / 1000, 3) AS km FROM p WHERE {_HAV.format(a='lat', b='lon', c='49.0', d='8.4')} <= 250000")
def haversine_radius(t: Tables):
    d = geo.haversine_m(c("lat"), c("lon"), F.lit(49.0), F.lit(8.4))
    return _placed(t).filter(geo.within_radius(c("lat"), c("lon"), F.lit(49.0), F.lit(8.4), F.lit(250.0))).select("s_suppkey", F.round(d / 1000, 3).alias("km"))


@query(f"WITH {_PLACED} SELECT s_suppkey FROM p WHERE lat BETWEEN 49.0 - 250 / 110.0 AND 49.0 + 250 / 110.0 AND lon BETWEEN 8.4 - 250 / (110.0 * cos(radians(49.0))) AND 8.4 + 250 / (110.0 * cos(radians(49.0)))")
def bbox_prefilter(t: Tables):
    return _placed(t).filter(geo.in_box(c("lat"), c("lon"), F.lit(49.0), F.lit(8.4), F.lit(250.0))).select("s_suppkey")


@query(f"WITH {_PLACED} SELECT s_suppkey, s_name, round({_HAV.format(a='lat', b='lon', c='49.0', d='8.4')} / 1000, 3) AS km FROM p ORDER BY {_HAV.format(a='lat', b='lon', c='49.0', d='8.4')}, lower(s_name), s_suppkey LIMIT 5")
def so06_so11_nearest(t: Tables):
    d = geo.haversine_m(c("lat"), c("lon"), F.lit(49.0), F.lit(8.4))
    return _placed(t).withColumn("d", d).orderBy(c("d").asc_nulls_last(), F.lower("s_name"), "s_suppkey").limit(5).select("s_suppkey", "s_name", F.round(c("d") / 1000, 3).alias("km"))


@query(f"WITH {_PLACED}, n AS (SELECT n_nationkey, 46 + n_nationkey * 11 % 90 / 10.0::DOUBLE AS nlat, 5 + n_nationkey * 17 % 110 / 10.0::DOUBLE AS nlon FROM nation) SELECT s_suppkey, n_nationkey, round({_HAV.format(a='lat', b='lon', c='nlat', d='nlon')} / 1000, 3) AS km FROM p, n WHERE {_HAV.format(a='lat', b='lon', c='nlat', d='nlon')} <= 120000")
def jn14_radius_join(t: Tables):
    n = t.nation.select("n_nationkey", (46 + c("n_nationkey") * 11 % 90 / 10.0).alias("nlat"), (5 + c("n_nationkey") * 17 % 110 / 10.0).alias("nlon"))
    j = relational.radius_join(_placed(t), n, lat="lat", lon="lon", c_lat="nlat", c_lon="nlon", radius_km=120.0)
    return j.select("s_suppkey", "n_nationkey", F.round(c("distance_m") / 1000, 3).alias("km"))


@query("""WITH RECURSIVE k AS (SELECT doc_id, 'text:' || md5(text) AS key FROM documents UNION SELECT doc_id, 'head:' || lower(left(text, 40)) FROM documents UNION SELECT doc_id, 'tail:' || right(text, 30) FROM documents),
e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b ON a.key = b.key), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS doc_id, min(y) AS grp FROM r GROUP BY 1""")
def dedupe_components(t: Tables):
    d = t.documents
    keys = F.array(F.concat(F.lit("text:"), F.md5("text")), F.concat(F.lit("head:"), F.lower(F.left("text", F.lit(40)))), F.concat(F.lit("tail:"), F.right("text", F.lit(30))))
    return dedupe.group_by_keys(d.select("doc_id", F.explode(keys).alias("key")), id_col="doc_id").withColumnRenamed("group", "grp")


@query("""WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS d FROM pages) SELECT page_id, min(page_id) OVER (PARTITION BY d) AS root FROM u""")
def st09_canonical_per_domain(t: Tables):
    return dedupe.canonical_per_domain(t.pages.select(c("page_id").alias("id"), c("url").alias("website_url"), F.lit(False).alias("paused"))).withColumnRenamed("id", "page_id")


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def st01_union_all(t: Tables):
    return t.customer.filter("c_acctbal > 9000").select(c("c_custkey").alias("id"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(c("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def st05_candidate_union(t: Tables):
    return t.customer.select(c("c_nationkey").alias("nationkey")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def st04_difference(t: Tables):
    return t.orders.filter("o_orderstatus = 'F'").select("o_custkey").subtract(t.orders.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY first), ',') AS seen FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def st06_ordered_distinct(t: Tables):
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("a"))
    return rows.select("o_custkey", F.array_join(F.array_distinct(F.transform("a", lambda x: x["o_orderpriority"])), ",").alias("seen"))


@query("SELECT p_partkey FROM part WHERE len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))) = 0 AND len(string_split(p_name, ' ')) > 1")
def st07_token_sets(t: Tables):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return t.part.filter((F.size(F.array_intersect(a, b)) == 0) & (F.size(a) > 1)).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def fil01_status(t: Tables):
    return t.orders.filter("o_orderstatus = 'O'").select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type ILIKE '%pur%' OR json_extract_string(props, '$.k') ILIKE '%7%'")
def fil02_nested_keyword(t: Tables):
    hit = search.keyword_filter("pur", [c("event_type")]) | search.keyword_filter("7", [F.get_json_object("props", "$.k")])
    return t.events.filter(hit).select("event_id")


@query("SELECT c_custkey FROM customer WHERE (contains(lower(c_name), 'cust') OR contains(lower(c_mktsegment), 'cust')) AND (contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')) AND NOT (contains(lower(c_name), '%') OR contains(lower(c_mktsegment), '%'))")
def fil03_words_escaped(t: Tables):
    columns = [c("c_name"), c("c_mktsegment")]
    return t.customer.filter(search.keyword_filter("cust build", columns) & ~search.keyword_filter("%", columns)).select("c_custkey")


@query("SELECT o_orderkey, (a IS NULL OR a = 'remote') AND (r OR coalesce(a = 'remote', false)) AS remote, coalesce(a = 'hybrid', false) AS hybrid FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'remote' WHEN 'P' THEN 'hybrid' END AS a, o_orderkey % 3 = 0 AS r FROM orders)")
def fil04_fil13_work_style(t: Tables):
    o = t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "F", "remote").when(c("o_orderstatus") == "P", "hybrid").alias("a"), (c("o_orderkey") % 3 == 0).alias("r"))
    return o.select("o_orderkey", scope.work_style(c("a"), c("r"), "remote").alias("remote"), scope.work_style(c("a"), c("r"), "hybrid").alias("hybrid"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7")
def fil05_either_company(t: Tables):
    return t.lineitem.filter("l_partkey = 7 or l_suppkey = 7").select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 'jobs' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'feed' WHEN c_acctbal > 0 THEN 'domain' ELSE 'all' END AS stage FROM customer""")
def fil06_discovery_stage(t: Tables):
    per = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.bool_or(c("o_orderstatus") == "O").alias("open"))
    return t.customer.join(per, "c_custkey", "left").select("c_custkey", F.when(c("open"), "jobs").when(c("open").isNotNull(), "feed").when(c("c_acctbal") > 0, "domain").otherwise("all").alias("stage"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 3) OR n_nationkey IN (1, 2)")
def fil07_fil27_membership(t: Tables):
    region = t.nation.filter("n_regionkey = 3 or n_nationkey in (1, 2)")
    return t.customer.join(region, c("c_nationkey") == c("n_nationkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND (o_totalprice >= 100000 OR (o_orderkey % 2 = 0 AND o_orderpriority = '1-URGENT'))) AND NOT (o_orderpriority = '5-LOW')")
def fil21_visibility(t: Tables):
    ok = search.visible(c("o_orderstatus") == "O", c("o_totalprice"), 100000, c("o_orderkey") % 2 == 0, c("o_orderpriority") == "1-URGENT", c("o_orderpriority") == "5-LOW", False)
    return t.orders.filter(ok).select("o_orderkey")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https://www.') AND contains(url, 'utm_source=')")
def fil22_url_prefix(t: Tables):
    return t.pages.filter(c("url").startswith("https://www.") & c("url").contains("utm_source=")).select("page_id")


@query("""WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '.') AS l FROM pages), s AS (SELECT page_id, array_to_string(l[unnest(range(1, len(l) + 1)) : len(l)], '.') AS suffix FROM h)
SELECT page_id, suffix FROM s WHERE suffix IN ('example.org', 'net')""")
def fil23_host_suffix(t: Tables):
    rules = t.spark.createDataFrame([("example.org",), ("net",)], "suffix string")
    return t.pages.select("page_id", F.explode(urls.host_suffixes(urls.host(c("url")))).alias("suffix")).join(rules, "suffix", "left_semi").select("page_id", "suffix")


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND (event_type <> 'click' OR ts <= TIMESTAMP '2024-01-10')")
def fil26_due_and_free(t: Tables):
    now, lease = F.lit("2024-01-15").cast("timestamp_ntz"), F.when(c("event_type") == "click", c("ts") + F.expr("interval 5 days"))
    return t.events.filter((c("ts") <= now) & (lease.isNull() | (lease <= now))).select("event_id")


@query("SELECT o_orderkey, coalesce(nullif(c_name, ''), n_name, 'unknown') AS employer, left(o_orderpriority, 5) AS summary, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def prj01_sc69_display(t: Tables):
    j = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"), "left").join(t.nation, c("c_nationkey") == c("n_nationkey"), "left")
    shown = search.display(j.select("o_orderkey", F.nullif("c_name", F.lit("")).alias("employer_name"), c("n_name").alias("organization"), F.lit("unknown").alias("source_company"), c("o_orderpriority").alias("description"), "c_mktsegment"), limit=5)
    return shown.select("o_orderkey", "employer", "summary", "c_mktsegment")


@query("SELECT c_custkey, min(o_orderdate) AS next_check, count(o_orderkey) AS feeds FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'F' GROUP BY 1")
def prj02_next_check(t: Tables):
    open_ = t.orders.filter("o_orderstatus <> 'F'")
    return t.customer.join(open_, c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(F.min("o_orderdate").alias("next_check"), F.count("o_orderkey").alias("feeds"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 10")
def prj03_catalogue(t: Tables):
    return t.part.filter("p_size < 10").select("p_partkey", "p_name", "p_size")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id, l.quality FROM labels l JOIN documents d USING (doc_id) WHERE (CASE WHEN doc_id % 3 = 0 THEN sha256('older ' || d.text) ELSE sha256(d.text) END) = sha256(d.text)")
def jn18_labels_with_hash(t: Tables):
    """Labels count only for the text that they were given to: a third of them states the hash of another version."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("own"), "text")
    stated = t.labels.join(d.select("doc_id", "text"), "doc_id").select("doc_id", "quality", F.when(c("doc_id") % 3 == 0, F.sha2(F.concat(F.lit("older "), "text"), 256)).otherwise(F.sha2("text", 256)).alias("stated"))
    return relational.labels_of_current_text(stated, d.drop("text"), id_col="doc_id")


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS v FROM orders), g AS (SELECT o_custkey, min_by(v, s.o_orderkey) FILTER (v IS NOT NULL) AS gv FROM orders o JOIN s ON o.o_orderkey = s.o_orderkey GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, coalesce(s.v, g.gv) AS v FROM orders o LEFT JOIN s USING (o_orderkey) LEFT JOIN g USING (o_custkey)""")
def jn20_own_else_group(t: Tables):
    states = t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "P", c("o_totalprice")).alias("v"))
    return relational.lookup_own_else_group(t.orders.select("o_orderkey", "o_custkey"), states, id_col="o_orderkey", group_col="o_custkey", value="v")


@query("SELECT DISTINCT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT l_orderkey FROM lineitem WHERE l_partkey < 5)")
def jn21_ot30_affected(t: Tables):
    by_company = t.orders.join(t.customer.filter("c_nationkey = 3"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey")
    return by_company.union(t.lineitem.filter("l_partkey < 5").select("l_orderkey")).distinct()


@query("SELECT p.p_partkey, p.p_brand, u.v AS unique_type FROM part p LEFT JOIN (SELECT p_brand, p_size, min(p_type) AS v FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) = 1) u ON u.p_brand = p.p_brand AND u.p_size = p.p_size")
def jn22_unique_match(t: Tables):
    right = t.part.select("p_brand", "p_size", c("p_type").alias("unique_type"))
    return relational.unique_match(t.part.select("p_partkey", "p_brand", "p_size"), right, ["p_brand", "p_size"], "unique_type").drop("p_size")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), m AS (SELECT v.label AS job, q.vec_id AS profile, max(round(list_cosine_similarity(v.e, q.e), 4)) AS similarity FROM v, q GROUP BY 1, 2)
SELECT job, profile, similarity, CASE WHEN similarity >= 0.84 THEN least(59, 30 + round_even((similarity - 0.84) / 0.07 * 29, 0)::INT) ELSE 0 END AS score FROM m""")
def jn11_best_sections(t: Tables):
    from vacantia.operators.matching import best_section_pairs

    jobs = t.embeddings.select(c("label").alias("job"), F.lit("").alias("text"), c("embedding").alias("vector"))
    profiles = t.embeddings.filter("vec_id % 50 = 0").select(c("vec_id").alias("profile"), F.lit("").alias("text"), c("embedding").alias("vector"))
    best = best_section_pairs(jobs, profiles).select("job", "profile", "similarity")
    return best.withColumn("score", vectors.similarity_score(c("similarity")))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS squared, round(embedding[1] / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS first FROM embeddings")
def sc53_normalize(t: Tables):
    e = c("embedding")
    return t.embeddings.select("vec_id", F.round(vectors.dot(e, e), 4).alias("squared"), F.round(F.element_at(vectors.normalize(e), 1), 4).alias("first"))


for _name, _sql, _order in (
    ("so01_newest", "ORDER BY o_orderdate DESC NULLS LAST, o_orderkey", lambda: [c("o_orderdate").desc_nulls_last(), c("o_orderkey")]),
    ("so01_title", "ORDER BY lower(o_orderpriority), o_orderkey", lambda: [F.lower("o_orderpriority"), c("o_orderkey")]),
    ("so09_score_then_id", "ORDER BY -o_totalprice, o_orderkey", lambda: [-c("o_totalprice"), c("o_orderkey")]),
    ("so13_three_keys", "ORDER BY o_orderstatus DESC, o_orderpriority, o_orderkey DESC", lambda: [c("o_orderstatus").desc(), c("o_orderpriority"), c("o_orderkey").desc()]),
):
    query(f"SELECT o_orderkey, o_totalprice FROM orders {_sql} LIMIT 40", name=_name)(lambda t, order=_order: t.orders.orderBy(*order()).limit(40).select("o_orderkey", "o_totalprice"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '-inf'::DOUBLE ELSE epoch(TIMESTAMP '2024-01-01' + to_days((doc_id % 28)::INT)) END AS rank FROM documents")
def so03_date_rank(t: Tables):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 28).cast("int")), "yyyy-MM-dd")
    return t.documents.select("doc_id", search.date_rank(F.when(c("doc_id") % 3 == 0, "soon").otherwise(day)).alias("rank"))


@query("SELECT user_id, min_by(event_id, struct_pack(a := event_type <> 'signup', b := ts, c := event_id)) AS event_id FROM events GROUP BY 1")
def so10_fair_pick(t: Tables):
    return t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct(c("event_type") != "signup", "ts", "event_id")).alias("event_id"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 60")
def so04_offset_page(t: Tables):
    return relational.page(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), [c("o_totalprice").desc(), c("o_orderkey")], offset=60, limit=30).drop("o_totalprice")


@query("""WITH k AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS turn, c_mktsegment FROM customer) SELECT c_custkey, c_mktsegment, turn FROM k ORDER BY turn, c_mktsegment LIMIT 12""")
def wn08_interleave(t: Tables):
    return relational.interleave(t.customer, "c_mktsegment", [c("c_acctbal").desc(), c("c_custkey")], 12).select("c_custkey", "c_mktsegment", c("turn").cast("bigint").alias("turn"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def ag05_distinct(t: Tables):
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@query("""SELECT c_custkey, c_name, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '00') AND n_regionkey = 2 ORDER BY lower(c_name), c_custkey LIMIT 20""")
def ot02_company_search(t: Tables):
    j = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).filter(search.keyword_filter("00", [c("c_name")]) & (c("n_regionkey") == 2))
    return relational.page(j.select("c_custkey", "c_name", "c_mktsegment", "n_name"), [F.lower("c_name"), c("c_custkey")], offset=0, limit=20)


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT b.o_custkey, b.o_orderkey, c.c_name FROM b JOIN customer c ON b.o_custkey = c.c_custkey WHERE r = 1 ORDER BY b.o_totalprice DESC, b.o_orderkey LIMIT 50""")
def ot03_application_list(t: Tables):
    best = relational.best_per_group(t.orders, ["o_custkey", "o_orderpriority"], [c("o_totalprice").desc(), c("o_orderkey")])
    j = best.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_custkey", "o_orderkey", "c_name", "o_totalprice")
    return relational.page(j, [c("o_totalprice").desc(), c("o_orderkey")], offset=0, limit=50).drop("o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 33")
def ot04_detail(t: Tables):
    return t.orders.filter("o_orderkey = 33").join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).select("o_orderkey", "o_orderstatus", "c_name", "n_name")


@query("SELECT o_orderkey, round(100.0 * rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) / count(*) OVER (PARTITION BY o_orderstatus), 2) AS place FROM orders")
def wn_rank_in_status(t: Tables):
    w = Window.partitionBy("o_orderstatus")
    return t.orders.select("o_orderkey", F.round(100.0 * F.rank().over(w.orderBy("o_totalprice")) / F.count("*").over(w), 2).alias("place"))


@query("""SELECT doc_id, trim(regexp_replace(translate(replace(lower(text), 'ß', 'ss'), 'äöüàâáéèêëîïíôóûùúçñ', 'aouaaaeeeeiiioouuucn'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def text_key_normalize(t: Tables):
    return t.documents.select("doc_id", strings.text_key(c("text")).alias("key"))


_DIAMONDS = """n AS (SELECT n_nationkey AS region, (n_nationkey * 29) % 360 - 180.0 AS x, (n_nationkey * 13) % 100 - 50.0 AS y, 8.0 + n_nationkey % 7 AS a, 6.0 + n_nationkey % 5 AS b, n_nationkey % 3 = 0 AS holed, n_nationkey % 4 = 1 AS twice FROM nation),
p AS (SELECT c_custkey, (c_custkey * 7919 % 36000) / 100.0 - 179.9963 AS lon, (c_custkey * 104729 % 17000) / 100.0 - 84.9987 AS lat FROM customer),
d AS (SELECT c_custkey, region, holed, twice, least(abs(lon - x), 360 - abs(lon - x)) / a AS dx, abs(lat - y) / b AS dy, abs(lat - y - 25) / b AS dz FROM p, n)"""


@query(f"WITH {_DIAMONDS} SELECT c_custkey, region FROM d WHERE (dx + dy <= 1 AND NOT (holed AND dx + dy <= 0.5)) OR (twice AND 2 * (dx + dz) <= 1)")
def jn13_points_in_regions(t: Tables):
    """Points of customers in diamonds of nations: some with a hole, some of two polygons, some across the antimeridian."""
    turned = lambda x: F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)
    corner = lambda x, y: F.array(turned(x), y)
    k = F.col("n_nationkey")
    x, y, a, b = (k * 29) % 360 - F.lit(180.0), (k * 13) % 100 - F.lit(50.0), F.lit(8.0) + k % 7, F.lit(6.0) + k % 5
    ring = lambda y, s: F.array(corner(x - a * s, y), corner(x, y - b * s), corner(x + a * s, y), corner(x, y + b * s), corner(x - a * s, y))
    first = F.when(k % 3 == 0, F.array(ring(y, 1.0), ring(y, 0.5))).otherwise(F.array(ring(y, 1.0)))
    regions = t.nation.select(k.alias("region"), F.when(k % 4 == 1, F.array(first, F.array(ring(y + 25, 0.5)))).otherwise(F.array(first)).alias("polygons"))
    c_key = F.col("c_custkey")
    points = t.customer.select("c_custkey", ((c_key * 7919 % 36000) / 100.0 - 179.9963).alias("lon"), ((c_key * 104729 % 17000) / 100.0 - 84.9987).alias("lat"))
    return spatial.join_regions(points, regions, size=1.0).select("c_custkey", "region")
