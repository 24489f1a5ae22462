"""Feeds, captures, imports and merges: bodies are built from the tables' columns, parsed, and compared with the rows they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators import dedupe, identity, imports, relational, search, upserts
from vacantia.plans.catalog import Tables, query
from vacantia.sources import feeds
from vacantia.streaming import queues

c = F.col
#: Customers of a board: boards stay under the pages of the feeds' formats.
_BOARD = "c_custkey // 40"


def _board(key: str = "c_custkey") -> Column:
    return F.floor(c(key) / 40).cast("bigint")


def _text(key: str = "c_custkey") -> Column:
    return c(key).cast("string")


def _bodies(t: Tables, provider: str, row: Column, wrap, url: Column | None = None) -> DataFrame:
    """One feed a board, its body made of all its customers' rows."""
    rows = t.customer.groupBy(_board().alias("feed_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))).alias("all"))
    return rows.select("feed_id", F.lit(provider).alias("provider"), (F.concat(F.lit("https://b"), c("feed_id").cast("string"), F.lit(".example")) if url is None else url).alias("board_url"), wrap(F.transform("all", lambda x: x["r"]), c("feed_id")).alias("body"))


def _rows(bodies: DataFrame, *more: str) -> DataFrame:
    parsed = feeds.parse_feeds(bodies)
    return parsed.select("feed_id", "complete", F.explode("postings").alias("p")).select("feed_id", "complete", "p.external_id", "p.title", "p.url", *[f"p.{m}" for m in more])


@query(f"SELECT {_BOARD} AS feed_id, {_BOARD} % 3 <> 0 AS complete, c_custkey::VARCHAR AS external_id, c_name AS title, 'https://x.example/' || c_custkey AS url, c_mktsegment AS department, CASE c_custkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' END AS work_arrangement FROM customer")
def src02_greenhouse(t: Tables):
    place = F.when(c("c_custkey") % 3 == 0, "Remote").when(c("c_custkey") % 3 == 1, "Hybrid").otherwise("Bonn")
    row = F.struct(_text().alias("id"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("title"), F.concat(F.lit("https://x.example/"), _text()).alias("absolute_url"), F.struct(place.alias("name")).alias("location"), F.array(F.struct(c("c_mktsegment").alias("name"))).alias("departments"))
    total = lambda rows, board: F.size(rows) + F.when(board % 3 == 0, 1).otherwise(0)  # noqa: E731 - a third of the boards hold back a posting
    return _rows(_bodies(t, "greenhouse", row, lambda rows, b: F.to_json(F.struct(rows.alias("jobs"), F.struct(total(rows, b).alias("total")).alias("meta")))), "department", "work_arrangement")


@query(f"SELECT {_BOARD} AS feed_id, true AS complete, c_custkey::VARCHAR AS external_id, c_name AS title, 'https://l.example/' || c_custkey AS url, 'Bonn' AS location, c_mktsegment AS department, CASE WHEN c_custkey % 2 = 0 THEN 'hybrid' ELSE 'remote' END AS work_arrangement, strftime(to_timestamp(1704067200 + c_custkey * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date_posted FROM customer")
def src03_lever(t: Tables):
    row = F.struct(
        _text().alias("id"), c("c_name").alias("text"), F.concat(F.lit("https://l.example/"), _text()).alias("hostedUrl"), F.struct(F.lit("Bonn").alias("location"), c("c_mktsegment").alias("team")).alias("categories"),
        F.when(c("c_custkey") % 2 == 0, "hybrid").otherwise("remote").alias("workplaceType"), ((F.lit(1704067200) + c("c_custkey") * 86400) * 1000).alias("createdAt"),
    )
    got = _rows(_bodies(t, "lever", row, lambda rows, b: F.to_json(rows)), "location", "department", "work_arrangement", "date_posted")
    return got.withColumn("date_posted", F.left("date_posted", F.lit(10)))


@query(f"SELECT {_BOARD} AS feed_id, true AS complete, c_custkey::VARCHAR AS external_id, c_name AS title, 'https://a.example/' || c_custkey AS url, CASE WHEN c_custkey % 4 = 1 THEN 'remote' ELSE 'onsite' END AS work_arrangement, CASE WHEN c_custkey % 4 = 1 THEN true END AS is_remote FROM customer WHERE c_custkey % 4 <> 0")
def src04_ashby(t: Tables):
    row = F.struct(_text().alias("id"), c("c_name").alias("title"), F.concat(F.lit("https://a.example/"), _text()).alias("jobUrl"), (c("c_custkey") % 4 != 0).alias("isListed"), (c("c_custkey") % 4 == 1).alias("isRemote"), F.lit("OnSite").alias("workplaceType"))
    return _rows(_bodies(t, "ashby", row, lambda rows, b: F.to_json(F.struct(rows.alias("jobs")))), "work_arrangement", "is_remote")


@query(f"SELECT {_BOARD} AS feed_id, true AS complete, 'k' || c_custkey AS external_id, c_name AS title, 'https://s.example/' || c_custkey AS url, 'Bonn, NRW' AS location, 'FULL_TIME, OTHER' AS employment_type, CASE WHEN c_custkey % 2 = 0 THEN 'remote' END AS work_arrangement, '2024-05-06' AS date_posted FROM customer")
def src06_schema_org(t: Tables):
    address = F.struct(F.lit("Bonn").alias("addressLocality"), F.lit("NRW").alias("addressRegion"), F.lit("DE").alias("addressCountry"))
    item = F.struct(
        F.lit("JobPosting").alias("@type"), F.struct(F.concat(F.lit("k"), _text()).alias("value")).alias("identifier"), F.concat(F.lit("https://s.example/"), _text()).alias("url"), c("c_name").alias("title"), F.lit("2024-05-06T10:00").alias("datePosted"),
        F.array(F.lit("FULL_TIME"), F.lit("OTHER")).alias("employmentType"), F.when(c("c_custkey") % 2 == 0, "TELECOMMUTE").alias("jobLocationType"), F.array(F.struct(address.alias("address"))).alias("jobLocation"),
    )
    row = F.struct(F.lit("DataFeedItem").alias("@type"), item.alias("item"))
    wrap = lambda rows, b: F.to_json(F.struct(F.lit("DataFeed").alias("@type"), F.size(rows).alias("numberOfItems"), rows.alias("dataFeedElement")))
    return _rows(_bodies(t, "schema_org", row, wrap), "location", "employment_type", "work_arrangement", "date_posted")


@query(f"SELECT {_BOARD} AS feed_id, {_BOARD} % 2 = 0 AS complete, c_custkey::VARCHAR AS external_id, c_name AS title, 'https://jobs.smartrecruiters.com/Acme/' || c_custkey AS url, 'Bonn, Germany' AS location, CASE WHEN c_custkey % 2 = 0 THEN 'remote' END AS work_arrangement FROM customer")
def src08_smartrecruiters(t: Tables):
    row = F.struct(
        _text().alias("id"), c("c_name").alias("name"), F.lit("PUBLIC").alias("visibility"), F.struct(F.lit("Acme").alias("identifier"), F.lit("Acme AG").alias("name")).alias("company"),
        F.struct(F.lit("Bonn").alias("city"), F.lit("de").alias("country"), (c("c_custkey") % 2 == 0).alias("remote"), F.lit(False).alias("hybrid")).alias("location"),
    )
    total = lambda rows, b: F.size(rows) + b % 2  # noqa: E731 - odd boards have another page
    wrap = lambda rows, b: F.to_json(F.struct(F.lit(0).alias("offset"), F.lit(100).alias("limit"), total(rows, b).alias("totalFound"), rows.alias("content")))
    return _rows(_bodies(t, "smartrecruiters", row, wrap), "location", "work_arrangement")


@query(f"SELECT {_BOARD} AS feed_id, false AS complete, 'id' || c_custkey AS external_id, 'Clerk / ' || c_mktsegment AS title, 'https://b' || {_BOARD} || '.example/clerk-' || lower(c_mktsegment) || '-id' || c_custkey AS url, 'Bonn' AS location, 'Acme' AS employer FROM customer WHERE c_custkey % 5 <> 0")
def src10_keyed_map(t: Tables):
    value = F.struct(F.lit("Acme").alias("company"), F.when(c("c_custkey") % 5 == 0, "Initiativbewerbung").otherwise(F.concat(F.lit("Clerk / "), "c_mktsegment")).alias("job_title"), F.lit("Bonn, Ulm").alias("city"), F.lit("Bonn").alias("location"))
    row = F.struct(F.concat(F.lit("id"), _text()).alias("key"), value.alias("value"))
    wrap = lambda rows, b: F.to_json(F.struct(F.lit(200).alias("status_code"), F.map_from_entries(rows).alias("data")))
    return _rows(_bodies(t, "telekom", row, wrap), "location", "metadata").withColumn("employer", F.try_element_at("metadata", F.lit("hiring_organization"))).drop("metadata")


def _xml(**tags: Column) -> Column:
    return F.concat(*[x for k, v in tags.items() for x in (F.lit(f"<{k}>"), v, F.lit(f"</{k}>"))])


@query(f"SELECT {_BOARD} AS feed_id, true AS complete, c_custkey::VARCHAR AS external_id, c_name AS title, 'https://b' || {_BOARD} || '.example/job/' || c_custkey AS url, 'Bonn' AS location, c_mktsegment AS department, '2024-05-06' AS date_posted, 'Build' || chr(10) || chr(10) || 'Run' AS description FROM customer")
def src05_personio(t: Tables):
    part = lambda v: F.concat(F.lit("<jobDescription>"), _xml(name=F.lit("n"), value=F.lit(f"&lt;p&gt;{v}&lt;/p&gt;")), F.lit("</jobDescription>"))
    row = F.concat(F.lit("<position>"), _xml(id=_text(), name=c("c_name"), office=F.lit("Bonn"), department=c("c_mktsegment"), createdAt=F.lit("2024-05-06T10:00:00+00:00"), jobDescriptions=F.concat(part("Build"), part("Run"))), F.lit("</position>"))
    wrap = lambda rows, b: F.concat(F.lit("<workzag-jobs>"), F.array_join(rows, ""), F.lit("</workzag-jobs>"))
    return _rows(_bodies(t, "personio", row, wrap), "location", "department", "date_posted", "description")


@query(f"SELECT {_BOARD} AS feed_id, true AS complete, c_custkey::VARCHAR AS external_id, c_name AS title, 'https://b' || {_BOARD} || '.example/o/s' || c_custkey AS url, 'Bonn' AS location, CASE c_custkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'remote' ELSE 'onsite' END AS work_arrangement FROM customer")
def src07_recruitee(t: Tables):
    flag = lambda k: F.when(c("c_custkey") % 3 == k, "true").otherwise("false")
    row = F.concat(F.lit("<offer>"), _xml(id=_text(), slug=F.concat(F.lit("s"), _text()), title=c("c_name"), city=F.lit("Bonn"), hybrid=flag(0), remote=flag(1), on_site=flag(2)), F.lit("</offer>"))
    wrap = lambda rows, b: F.concat(F.lit("<offers>"), F.array_join(rows, ""), F.lit("</offers>"))
    return _rows(_bodies(t, "recruitee", row, wrap), "location", "work_arrangement")


@query(f"SELECT {_BOARD} AS feed_id, false AS complete, 'g' || c_custkey AS external_id, c_name AS title, 'https://r.example/' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN 'Ulm' ELSE 'Bonn' END AS location, '2024-05-06' AS date_posted FROM customer WHERE c_custkey % 4 <> 1")
def src09_rss(t: Tables):
    link = F.when(c("c_custkey") % 4 == 1, F.lit("ftp://r.example/x")).otherwise(F.concat(F.lit("https://r.example/"), _text()))  # links of other schemes are left out
    place = F.when(c("c_custkey") % 2 == 0, F.lit("<x:location>Ulm</x:location>")).otherwise(F.lit(""))
    row = F.concat(F.lit("<item>"), place, _xml(title=c("c_name"), link=link, guid=F.concat(F.lit("g"), _text()), description=F.lit("Ort: Bonn | more"), pubDate=F.lit("Mon, 06 May 2024 10:00:00 GMT")), F.lit("</item>"))
    wrap = lambda rows, b: F.concat(F.lit('<rss version="2.0" xmlns:x="urn:x"><channel>'), F.array_join(rows, ""), F.lit("</channel></rss>"))
    return _rows(_bodies(t, "rss", row, wrap), "location", "date_posted").withColumn("date_posted", F.left("date_posted", F.lit(10)))


@query("""SELECT c_custkey AS feed_id, p AS provider, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 4 THEN 1 ELSE 0 END::BIGINT AS n, c_custkey % 5 = 0 AS complete, CASE c_custkey % 5 WHEN 1 THEN 'unexpected schema: lever' WHEN 2 THEN 'unexpected schema: greenhouse' WHEN 3 THEN 'unsupported provider: other' END AS error
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'lever' WHEN 1 THEN 'lever' WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'other' ELSE 'rss' END AS p FROM customer)""")
def src01_dispatch(t: Tables):
    """Providers and bodies, some unknown, some malformed, some without an address."""
    kind = c("c_custkey") % 5
    provider = F.when(kind.isin(0, 1), "lever").when(kind == 2, "greenhouse").when(kind == 3, "other").otherwise("rss")
    body = F.when(kind == 0, F.lit('[{"id": "1", "text": "T", "hostedUrl": "https://l.example/1"}]')).when(kind == 1, F.lit('[{"id": "1", "text": "T", "hostedUrl": "no address"}]')).when(kind == 2, F.lit('{"rows": []}')).when(kind == 3, F.lit("{}")).otherwise(F.lit("<rss><channel><item><title>T</title><link>https://r.example/1</link></item></channel></rss>"))
    rows = t.customer.select(c("c_custkey").alias("feed_id"), provider.alias("provider"), F.lit("https://b.example").alias("board_url"), body.alias("body"))
    return feeds.parse_feeds(rows).select("feed_id", "provider", F.size("postings").cast("bigint").alias("n"), "complete", "error")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 <> 5 THEN 'R' || c_custkey END AS external_id, CASE WHEN c_custkey % 6 <> 5 THEN CASE WHEN c_custkey % 2 = 0 THEN 'hash:h' || c_nationkey ELSE 'name:' || sha256(lower(c_name)) END END AS company_source_id,
CASE WHEN c_custkey % 6 <> 5 THEN CASE WHEN c_custkey % 3 = 0 THEN 'remote' WHEN c_custkey % 3 = 1 THEN 'hybrid' END END AS work_arrangement, CASE WHEN c_custkey % 6 <> 5 THEN 'Bonn, 53111' END AS label FROM customer""")
def src12_employment_service(t: Tables):
    k = c("c_custkey")
    row = F.struct(
        F.when(k % 6 != 5, F.concat(F.lit("R"), _text())).alias("refnr"), F.lit("Koch").alias("titel"), c("c_name").alias("firma"), F.when(k % 2 == 0, F.concat(F.lit("h"), c("c_nationkey").cast("string"))).alias("arbeitgeberKundennummerHash"),
        F.when(k % 3 == 0, "ANGABE_IN_PROZENT").alias("homeofficetyp"), F.when(k % 3 == 0, 100).alias("homeofficeprozent"), (k % 3 == 1).alias("homeofficemoeglich"), F.struct(F.lit("Bonn").alias("ort"), F.lit("53111").alias("plz")).alias("arbeitsort"),
    )
    got = t.customer.select("c_custkey", feeds.employment_service(F.to_json(row)).alias("p"))
    return got.select("c_custkey", "p.external_id", "p.company_source_id", "p.work_arrangement", F.try_element_at("p.locations", F.lit(1))["label"].alias("label"))


@query("SELECT c_nationkey AS page, count(*)::BIGINT AS n, min(c_name) AS first FROM customer GROUP BY 1")
def src13_src19_envelopes(t: Tables):
    rows = t.customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("r"))
    key = c("c_nationkey") % 3
    body = F.when(key == 0, F.to_json(F.struct(c("r").alias("jobs")))).when(key == 1, F.to_json(F.struct(c("r").alias("ergebnisliste")))).otherwise(F.to_json(F.struct(c("r").alias("stellenangebote"))))
    got = rows.select(c("c_nationkey").alias("page"), feeds.search_rows(body).alias("rows"))
    return got.select("page", F.size("rows").cast("bigint").alias("n"), F.try_element_at("rows", F.lit(1)).alias("first"))


@query("""WITH e AS (SELECT c_custkey AS seq, 'node/' || (c_custkey // 2) AS source_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name, c_mktsegment AS category, CASE WHEN c_custkey % 5 = 0 THEN 10.0 ELSE 50.0 END AS lat FROM customer)
SELECT source_id, max_by(name, seq) AS name, max_by(category, seq) AS category FROM e WHERE name <> '' AND lat = 50.0 GROUP BY 1""")
def src16_map_elements(t: Tables):
    k = c("c_custkey")
    tags = F.map_from_arrays(F.array(F.lit("name"), F.lit("office")), F.array(F.when(k % 7 == 0, F.lit(" ")).otherwise(c("c_name")), c("c_mktsegment")))
    body = F.to_json(F.struct(F.lit("node").alias("type"), F.floor(k / 2).cast("bigint").alias("id"), F.when(k % 5 == 0, 10.0).otherwise(50.0).alias("lat"), F.lit(7.0).alias("lon"), tags.alias("tags")))
    return feeds.map_elements(t.customer.select(k.alias("seq"), body.alias("body")), lat=50.0, lon=7.0, radius_km=25.0).select("source_id", "name", "category")


@query("SELECT user_id::VARCHAR AS url, max_by(event_id, ts) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def src22_captures(t: Tables):
    body = c("event_id").cast("string")
    stated = F.when(c("event_id") % 3 == 0, F.sha2(F.lit("damaged"), 256)).otherwise(F.upper(F.sha2(body, 256)))
    got = feeds.merge_captures(t.events.select(c("user_id").cast("string").alias("url"), c("ts").alias("captured_at"), stated.alias("sha256"), body.alias("body")))
    return got.select("url", c("body").cast("bigint").alias("event_id"))


@query("""SELECT n_name AS state, 40 + i * 0.5 AS south, 5 + j * 0.5 AS west, least(40 + (i + 1) * 0.5, 40 + h) AS north, least(5 + (j + 1) * 0.5, 6.25) AS east
FROM (SELECT n_name, 0.3 + n_nationkey % 4 * 0.5 AS h FROM nation) n, range(0, 4) t(i), range(0, 3) u(j) WHERE i * 0.5 < h - 1e-9""")
def src23_state_tiles(t: Tables):
    boxes = t.nation.select(c("n_name").alias("state"), F.lit(40.0).alias("south"), F.lit(5.0).alias("west"), (40 + 0.3 + c("n_nationkey") % 4 * 0.5).alias("north"), F.lit(6.25).alias("east"))
    return feeds.state_tiles(boxes)


@query("""WITH new AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'https://c/' || c_custkey END AS career_url, c_custkey % 10 AS at FROM customer), old AS (SELECT c_custkey AS k, 'old' AS name, NULL AS career_url, 5 AS at FROM customer WHERE c_custkey % 3 = 0)
SELECT n.k AS source_id, CASE WHEN o.k IS NOT NULL AND n.at < 5 THEN 'old' ELSE n.name END AS name, CASE WHEN o.k IS NOT NULL AND n.at < 5 THEN NULL ELSE n.career_url END AS career_url FROM new n LEFT JOIN old o USING (k) WHERE n.at <> 5""")
def src17_sm10_import_fixture(t: Tables):
    k = c("c_custkey")
    rows = t.customer.filter(k % 10 != 5)
    new = rows.select(k.alias("source_id"), c("c_name").alias("name"), (k % 10).alias("observed_at"))
    careers = rows.filter(k % 2 == 0).select(k.alias("source_id"), F.concat(F.lit("https://c/"), _text()).alias("career_url"), F.lit("ok").alias("status"))
    old = rows.filter(k % 3 == 0).select(k.alias("source_id"), F.lit("old").alias("name"), F.lit(None).cast("string").alias("career_url"), F.lit("old").alias("status"), F.lit(5).cast("bigint").alias("observed_at"))
    return imports.import_fixture(new, careers, old).select("source_id", "name", "career_url")


@query("SELECT c_name AS employer, 'f' || c_nationkey AS feed_url, 'x' || c_custkey || '-' || i AS external_id, c_mktsegment AS title FROM customer, range(0, 3) t(i) WHERE i < c_custkey % 3")
def ot23_supplement(t: Tables):
    jobs = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < c("c_custkey") % 3), lambda i: F.struct(F.concat(F.lit("x"), _text(), F.lit("-"), i.cast("string")).alias("id"), c("c_mktsegment").alias("title"), F.lit("u").alias("url")))
    body = F.to_json(F.array(F.struct(c("c_name").alias("name"), F.array(F.struct(F.concat(F.lit("f"), c("c_nationkey").cast("string")).alias("feed_url"), jobs.alias("jobs"))).alias("feeds"))))
    return t.customer.select(F.explode(imports.supplement_rows(body)).alias("r")).select("r.employer", "r.feed_url", "r.external_id", "r.title")


@query("""WITH n AS (SELECT o_custkey % 50 AS e, o_orderkey // 2 AS x FROM orders), f AS (SELECT DISTINCT e, x FROM n WHERE NOT (x % 5 = 0)), d AS (SELECT x, min(e) AS e FROM f GROUP BY x)
SELECT 'e' || e AS name, count(*)::BIGINT + CASE WHEN e < 10 THEN 100 ELSE 0 END AS job_count FROM d GROUP BY e UNION ALL SELECT 'e' || i AS name, 100 AS job_count FROM range(0, 10) t(i) WHERE i NOT IN (SELECT e FROM d)""")
def snk16_save_posting(t: Tables):
    new = t.orders.groupBy(F.floor(c("o_orderkey") / 2).alias("x")).agg(F.min(c("o_custkey") % 50).alias("e")).select(F.concat(F.lit("e"), c("e").cast("string")).alias("employer"), F.lit("f").alias("feed_url"), c("x").cast("string").alias("external_id"), F.lit("t").alias("title"))
    known = new.filter(c("external_id").cast("bigint") % 5 == 0).select("feed_url", "external_id", "title")
    employers = t.spark.range(10).select(F.concat(F.lit("e"), c("id").cast("string")).alias("name"), F.lit(100).cast("bigint").alias("job_count"))
    return imports.save_posting(employers, known, new)[0]


@query("""WITH s AS (SELECT c_custkey AS k, 'ok' || (c_custkey % 3) AS status, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS n FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(s.k, c.k) AS source_id, s.status, CASE WHEN s.k IS NULL THEN 'missing' WHEN c.k IS NULL THEN 'foreign' WHEN n > 1 THEN 'repeated' ELSE 'merged' END AS state FROM s FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0) c USING (k)""")
def ot17_merge_results(t: Tables):
    k = c("c_custkey")
    one = t.customer.filter(k % 5 != 0).select(k.alias("source_id"), F.lit(1).alias("slice"), F.when(k % 4 == 0, "early").otherwise(F.concat(F.lit("ok"), (k % 3).cast("string"))).alias("status"))
    two = t.customer.filter((k % 5 != 0) & (k % 4 == 0)).select(k.alias("source_id"), F.lit(2).alias("slice"), F.concat(F.lit("ok"), (k % 3).cast("string")).alias("status"))
    return imports.merge_results(one.unionByName(two), t.customer.filter(k % 7 != 0).select(k.alias("source_id")))


@query("""WITH r AS (SELECT c_custkey AS k, ['jobs_feed_found', 'unresolved', 'career_content_found', NULL][c_custkey % 4 + 1] AS n, ['jobs_extracted', 'unresolved', NULL][c_custkey % 3 + 1] AS p FROM customer)
SELECT k AS source_id, CASE WHEN p = 'jobs_extracted' AND coalesce(n, '') NOT IN ('jobs_feed_found', 'career_content_found') THEN p ELSE coalesce(n, p, 'unresolved') END AS status FROM r""")
def ot16_enrich_build(t: Tables):
    k = c("c_custkey")
    pick = lambda values, n: F.try_element_at(F.array(*map(F.lit, values)), ((k % n) + 1).cast("int"))
    base = t.customer.select(k.alias("source_id"), pick(["jobs_feed_found", "unresolved", "career_content_found", None], 4).alias("n"), pick(["jobs_extracted", "unresolved", None], 3).alias("p"))
    rows = lambda col: base.filter(c(col).isNotNull()).select("source_id", c(col).alias("status"), F.lit("u").alias("career_url"))
    return imports.enrich_build(base, rows("n"), rows("p")).select("source_id", "status")


@query("SELECT o_custkey AS page, count(*) FILTER (o_orderstatus <> 'F')::BIGINT AS kept, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS rejected, CASE WHEN count(*) FILTER (o_orderstatus <> 'F') > 0 THEN 'jobs_extracted' ELSE 'unresolved' END AS status FROM orders GROUP BY 1")
def ot15_drop_unverified(t: Tables):
    trust = F.when(c("o_orderstatus") == "F", "linked_external").when(c("o_orderstatus") == "O", "first_party").otherwise("branded_external")
    return imports.drop_unverified(t.orders.select(c("o_custkey").alias("page"), trust.alias("trust")))


@query("""WITH o AS (SELECT c_custkey AS id, lower(c_mktsegment) AS l, c_custkey + 0.5 AS y FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey AS job_id, c_mktsegment AS label, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE o.y END AS latitude FROM customer LEFT JOIN o ON o.id = c_custkey""")
def prj06_location_rows(t: Tables):
    k = c("c_custkey")
    own = F.when(k % 3 == 0, 1.0)
    new = t.customer.select(k.alias("job_id"), c("c_mktsegment").alias("label"), own.alias("latitude"), own.alias("longitude"))
    old = t.customer.filter(k % 2 == 0).select(k.alias("job_id"), F.lower("c_mktsegment").alias("label"), (k + 0.5).alias("latitude"), (k + 0.5).alias("longitude"))
    return imports.location_rows(new, old).select("job_id", "label", "latitude")


@query("SELECT rtrim(lower(url), '/') AS url, count(*)::BIGINT AS n FROM (SELECT 'https://x.example/job/' || (c_custkey // 2) || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END AS url FROM customer) GROUP BY 1 HAVING count(*) > 1")
def ot24_repeated_urls(t: Tables):
    url = F.concat(F.lit("https://X.example/job/"), F.floor(c("c_custkey") / 2).cast("string"), F.when(c("c_custkey") % 2 == 0, "/").otherwise(""))
    return imports.repeated_urls(t.customer.select(url.alias("url")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'kept, checked' WHEN c_custkey % 3 = 0 THEN 'a longer text' ELSE 'short' END AS description, c_custkey % 4 = 0 AS verified FROM customer""")
def snk09_merge_fields(t: Tables):
    k = c("c_custkey")
    now = t.customer.select(k.alias("id"), c("c_name").alias("name"), F.when(k % 4 == 0, "kept, checked").otherwise("short").alias("description"), (k % 4 == 0).alias("verified"))
    new = t.customer.select(k.alias("id"), F.when(k % 3 == 0, "new").otherwise(" ").alias("name"), F.when(k % 3 == 0, "a longer text").otherwise("s").alias("description"), F.lit(False).alias("verified"))
    return upserts.merge_fields(now, new, "id", ["name"])


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'd' || c_custkey ELSE 'new' || c_custkey END AS domain, CASE WHEN c_custkey % 3 = 0 THEN 'NW' END AS state FROM customer UNION ALL SELECT NULL, 'New ' || n_name, NULL, 'BY' FROM nation""")
def snk11_upsert_employers(t: Tables):
    k = c("c_custkey")
    now = t.customer.select(k.alias("id"), c("c_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("d"), _text())).alias("domain"), F.lit(None).cast("string").alias("state"))
    new = t.customer.select(F.when(k % 2 == 0, F.lit("another name")).otherwise(F.upper("c_name")).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("d"), _text())).otherwise(F.concat(F.lit("new"), _text())).alias("domain"), F.when(k % 3 == 0, "NW").alias("state"))
    added = t.nation.select(F.concat(F.lit("New "), "n_name").alias("name"), F.lit(None).cast("string").alias("domain"), F.lit("BY").alias("state"))
    return upserts.upsert_employers(now, new.unionByName(added))


@query("SELECT o_orderkey, coalesce(o_totalprice >= 100000, false) OR o_orderkey % 10 = 0 AS kept FROM orders")
def snk14_archive_and_restore(t: Tables):
    """Losers go to the archive; a tenth of all rows is restored from it."""
    kept, archived = upserts.split_archive(t.orders.select("o_orderkey", "o_totalprice"), c("o_totalprice") >= 100000)
    now = upserts.restore(kept, archived.filter(c("o_orderkey") % 10 == 0), ["o_orderkey"]).withColumn("kept", F.lit(True))
    return t.orders.select("o_orderkey").join(now.select("o_orderkey", "kept"), "o_orderkey", "left").select("o_orderkey", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""WITH k AS (SELECT c_custkey AS j, c_custkey // 4 AS g FROM customer), s AS (SELECT g, min(j) AS low FROM k GROUP BY g) SELECT j AS job_id, CASE WHEN g % 2 = 0 THEN -1 - g ELSE low END AS "group" FROM k JOIN s USING (g)""")
def st03_merge_incrementally(t: Tables):
    """Four postings a key; every second key has a stored group, whose id is smaller."""
    key = F.concat(F.lit("k"), F.floor(c("c_custkey") / 4).cast("string"))
    keys = t.customer.select(c("c_custkey").alias("job_id"), key.alias("key"))
    g = F.floor(c("c_custkey") / 4).cast("bigint")
    stored = t.customer.filter(g % 2 == 0).select(key.alias("key"), (-1 - g).alias("group")).distinct()
    return dedupe.merge_incrementally(stored, keys)[1]


@query("SELECT l_orderkey, min_by(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS part, min_by(l_quantity, struct_pack(a := l_linenumber, b := l_quantity)) FILTER (l_quantity > 25) AS quantity, arg_max('x' || repeat('y', (l_partkey % 7)::INT), struct_pack(a := l_partkey % 7, b := -l_linenumber)) AS description FROM lineitem GROUP BY 1")
def st08_ot37_merge_postings(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", c("l_partkey").alias("part"), F.when(c("l_quantity") > 25, c("l_quantity")).alias("quantity"), F.concat(F.lit("x"), F.expr("repeat('y', int(l_partkey % 7))")).alias("description"))
    return dedupe.merge_postings(rows, "l_orderkey", "l_linenumber", ["part", "quantity"])


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id % 40 AS a, event_id % 30 AS b, row_number() OVER (ORDER BY value, event_id) AS r FROM events WHERE event_id < 400),
g AS (SELECT r, a, b, event_id, [a] AS ta, [b] AS tb, true AS won FROM e WHERE r = 1 UNION ALL SELECT e.r, e.a, e.b, e.event_id, CASE WHEN w THEN list_append(ta, e.a) ELSE ta END, CASE WHEN w THEN list_append(tb, e.b) ELSE tb END, w
FROM (SELECT e.*, g.ta, g.tb, NOT list_contains(g.ta, e.a) AND NOT list_contains(g.tb, e.b) AS w FROM g JOIN e ON e.r = g.r + 1) e) SELECT event_id, a, b FROM g WHERE won""")
def wn05_one_to_one(t: Tables):
    rows = t.events.filter("event_id < 400").select("event_id", (c("user_id") % 40).alias("a"), (c("event_id") % 30).alias("b"), "value")
    return relational.greedy_one_to_one(rows, "a", "b", ["value", "event_id"]).select("event_id", "a", "b")


@query("""WITH r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS new FROM events))
SELECT user_id, max(ts) + INTERVAL 600 SECOND AS due_at, count(*)::BIGINT AS requests FROM r GROUP BY user_id, s""")
def sm05_debounced(t: Tables):
    return queues.debounced(t.events, "user_id", "ts", 600)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 8 >= 5 THEN 'failed' ELSE 'queued' END ELSE 'running' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN epoch(TIMESTAMP '2024-01-01') + least(3600, 60 * pow(2, o_orderkey % 8)) END AS next_s FROM orders""")
def sm09_recover(t: Tables):
    now = F.lit("2024-01-01").cast("timestamp")
    lease = F.when(c("o_orderkey") % 3 == 0, F.lit("2023-12-31").cast("timestamp")).otherwise(F.lit("2024-01-02").cast("timestamp"))
    tasks = t.orders.select("o_orderkey", F.lit("running").alias("status"), (c("o_orderkey") % 8).cast("int").alias("attempts"), lease.alias("lease_until"), F.lit(None).cast("timestamp").alias("next_at"))
    return queues.recover(tasks, now, base_s=60.0, cap_s=3600.0, most=5).select("o_orderkey", "status", (F.unix_micros("next_at") / 1e6).alias("next_s"))


@query("""WITH seen AS (SELECT user_id % 20 AS feed_id, event_id % 50 AS external_id, max(event_id % 8) AS scan FROM events GROUP BY 1, 2) SELECT feed_id, external_id, scan = 7 OR scan = 6 AND false AS is_active, (7 - scan - CASE WHEN scan < 3 THEN 1 ELSE 0 END)::INT AS misses FROM seen""")
def sm07_scan_sequence(t: Tables):
    """Eight scans of each feed, all complete but the fourth: a posting is missed by the complete scans after its last sighting."""
    batch = t.events.select((c("user_id") % 20).alias("feed_id"), (c("event_id") % 8).alias("scan"), (c("event_id") % 8 != 3).alias("complete"), (c("event_id") % 50).alias("external_id"))
    state = t.spark.createDataFrame([], "feed_id bigint, external_id bigint, is_active boolean, misses int, last_scan bigint")
    empty = t.spark.range(20).select(c("id").alias("feed_id"), F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")).alias("scan"), F.lit(None).cast("bigint").alias("external_id")).withColumn("complete", c("scan") != 3)
    return queues.apply_scans()(state, batch.unionByName(empty)).select("feed_id", "external_id", "is_active", "misses")


@query("""WITH k AS (SELECT c_custkey AS id, 'a' || (c_custkey % 60) AS alias, (c_custkey % 60) // 2 AS code FROM customer WHERE c_custkey < 120 UNION ALL SELECT c_custkey, 'a' || (c_custkey % 60), 900 FROM customer WHERE c_custkey % 60 < 10 AND c_custkey < 120)
SELECT DISTINCT 'City A' || i || ' (Main)' AS label, i // 2 AS code FROM range(10, 60) t(i)""")
def jn15_municipalities(t: Tables):
    """Word runs of labels against aliases; the first ten aliases name two codes and resolve nothing."""
    ids = t.spark.range(60).select(c("id"))
    aliases = ids.select(F.concat(F.lit("a"), c("id").cast("string")).alias("alias"), F.floor(c("id") / 2).cast("bigint").alias("code")).unionByName(ids.filter("id < 10").select(F.concat(F.lit("a"), c("id").cast("string")).alias("alias"), F.lit(900).cast("bigint").alias("code")))
    labels = ids.select(F.concat(F.lit("City A"), c("id").cast("string"), F.lit(" (Main)")).alias("label"))
    return identity.resolve_municipalities(labels, aliases)


@query("""SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 'd' || c_custkey END AS description FROM customer""")
def ot08_hydrate_details(t: Tables):
    """Details of every third posting are unambiguous, of the next missing, of the others repeated."""
    k = c("c_custkey")
    url = F.concat(F.lit("https://x.example/job/"), _text())
    stubs = t.customer.select(k.alias("job_id"), url.alias("url"), F.concat("c_name", F.lit(" (m/w/d)")).alias("title"))
    one = t.customer.filter(k % 3 != 1).select(url.alias("url"), F.upper("c_name").alias("title"), F.concat(F.lit("d"), _text()).alias("description"))
    return identity.hydrate_details(stubs, one.unionByName(one.filter(~F.col("description").isin("")).filter(F.expr("int(substring(description, 2)) % 3 = 2"))))


@query("SELECT page_id, count(*)::BIGINT AS n, min(score) AS least FROM (SELECT o_custkey AS page_id, (o_orderkey * 7 % 100)::INT AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey * 7 % 100 DESC, length('https://x/' || o_orderkey), 'https://x/' || o_orderkey) AS r FROM orders WHERE o_orderkey * 7 % 100 >= 70) WHERE r <= 3 GROUP BY 1")
def ot36_best_links(t: Tables):
    links = t.orders.select(c("o_custkey").alias("page_id"), (c("o_orderkey") * 7 % 100).cast("int").alias("score"), F.concat(F.lit("https://x/"), c("o_orderkey").cast("string")).alias("url"))
    return identity.best_links(links, "page_id", most=3).groupBy("page_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))


for _kind, _order in (("newest", "posted_at IS NULL, posted_at DESC, job_id"), ("title", "lower(title), job_id"), ("company", "lower(company), lower(title), job_id"), ("remote", "coalesce(is_remote, false) DESC, lower(title), job_id")):

    def _browse(t: Tables, kind=_kind):
        rows = t.orders.select(c("o_orderkey").alias("job_id"), F.when(c("o_orderkey") % 7 != 0, c("o_orderdate")).alias("posted_at"), c("o_orderpriority").alias("title"), (c("o_custkey") % 9).cast("string").alias("company"), F.when(c("o_orderkey") % 3 == 0, True).alias("is_remote"))
        return relational.page(rows, search.browse_order(kind), offset=20, limit=30).select("job_id", "title", "company")

    query(f"SELECT job_id, title, company FROM (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS posted_at, o_orderpriority AS title, (o_custkey % 9)::VARCHAR AS company, CASE WHEN o_orderkey % 3 = 0 THEN true END AS is_remote FROM orders) ORDER BY {_order} LIMIT 30 OFFSET 20", name=f"so01_so02_browse_{_kind}")(_browse)
