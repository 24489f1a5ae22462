"""Queries of the matching queue, of run comparisons, campaigns and failures, over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import imports, operations
from vacantia.plans.catalog import Tables, query
from vacantia.plans.rule_queries import listed, pick

c = F.col
_STATES = ("pending", "running", "done", "excluded", None)


# Tasks of two thirds of the documents, a selection by language, assessments of labelled documents, some of an old text or version.
@query(f"""WITH d AS (SELECT doc_id AS job, lang <> 'fr' AS chosen, doc_id % 3 > 0 AS had, md5(text) AS digest, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS was, CASE WHEN doc_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS ver, ({listed(_STATES)})[doc_id % 5 + 1] AS state FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id AS job, bool_or(quality = 1 AND doc_id % 11 > 0) AS current FROM labels GROUP BY 1), x AS (SELECT d.*, coalesce(current, false) AS current, chosen AND (NOT had OR was <> digest OR ver <> 'v2' OR state IS NULL OR state IN ('excluded', 'done')) AS reset FROM d LEFT JOIN l USING (job))
SELECT job, CASE WHEN NOT chosen THEN 'excluded' WHEN reset AND current THEN 'done' WHEN reset THEN 'pending' ELSE state END AS state, CASE WHEN reset OR NOT had THEN 0 ELSE 3 END AS attempts, CASE WHEN chosen THEN digest WHEN had THEN was ELSE '' END AS source_hash FROM x""")
def ot09_ot29_queue_state(t: Tables):
    d = t.documents.select(F.lit(1).alias("profile"), c("doc_id").alias("job"), F.md5("text").alias("digest"), "lang").filter("lang is not null and digest is not null")
    k = c("job")
    tasks = d.filter(k % 3 > 0).select("profile", "job", F.when(k % 7 == 0, "old").otherwise(c("digest")).alias("source_hash"), F.when(k % 5 == 0, "v1").otherwise("v2").alias("version"), pick(_STATES, k % 5).alias("state"), F.lit(3).alias("attempts"), F.lit(1).alias("priority"), F.lit("2024-01-01").cast("timestamp").alias("available_at"))
    stored = t.labels.filter("quality = 1").join(d, c("doc_id") == k).select("profile", "job", F.when(k % 11 == 0, "other").otherwise(c("digest")).alias("source_hash"), F.lit("v2").alias("version"))
    chosen = d.filter("lang <> 'fr'").select("profile", "job", c("digest").alias("source_hash"), F.lit(5).alias("priority"))
    got = operations.reconcile_queue(tasks, d, chosen, stored, version="v2", now=F.lit("2024-02-01").cast("timestamp"))
    return got.select("job", "state", "attempts", "source_hash")


@query("""WITH b AS (SELECT o_custkey AS k, max(o_totalprice) AS fit, count(*) AS checklist FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_totalprice) AS fit, count(*) AS checklist FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT k, n.fit - b.fit AS fit_delta, n.checklist - b.checklist AS checklist_delta, coalesce(n.fit >= b.fit AND n.checklist >= b.checklist, false) AS passed FROM b LEFT JOIN n USING (k)""")
def ot10_compare_scores(t: Tables):
    """A customer's orders before 1998 as the baseline, those after as the candidate."""
    early = c("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    side = lambda df: df.groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("fit"), F.count("*").alias("checklist"))
    return operations.compare_scores(side(t.orders.filter(early)), side(t.orders.filter(~early)), ["k"], ["fit", "checklist"])


@query("""SELECT c AS case_id, kind FROM (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), (VALUES ('1-URGENT'), ('5-LOW')) AS v(kind)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c AND o_orderpriority = kind AND o_orderdate >= TIMESTAMP '1998-01-01')""")
def ot10_missing_documents(t: Tables):
    early = c("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    rows = t.orders.select(c("o_custkey").alias("case_id"), c("o_orderpriority").alias("kind"), early.alias("early"))
    return operations.missing_documents(rows.filter("early"), rows.filter("not early"), "case_id", "kind", ["1-URGENT", "5-LOW"])


# The variant that leaves a nation out, and the one that has a customer twice, are not complete.
@query("""WITH r AS (SELECT v AS variant, c_custkey AS i, c_mktsegment AS status, c_custkey % 4 AS jobs, c_nationkey AS pages FROM customer, (VALUES ('all'), ('some'), ('twice')) AS x(v) WHERE v <> 'some' OR c_nationkey <> 3 UNION ALL SELECT 'twice', c_custkey, c_mktsegment, 0, 0 FROM customer WHERE c_custkey % 50 = 7),
s AS (SELECT variant, '{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}' AS statuses FROM (SELECT variant, status, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT variant, count(*) = count(DISTINCT i) AND count(DISTINCT i) = (SELECT count(*) FROM customer) AS complete, count(*) AS companies, count(*) FILTER (jobs > 0) AS companies_with_jobs, sum(jobs)::BIGINT AS job_rows, sum(pages)::BIGINT AS pages, any_value(statuses) AS statuses FROM r JOIN s USING (variant) GROUP BY 1""")
def ot12_cohort_summary(t: Tables):
    """Customers as the frozen cohort of three runs."""
    row = lambda name, df, jobs, pages: df.select(F.lit(name).alias("variant"), c("c_custkey").alias("index"), c("c_mktsegment").alias("status"), jobs.alias("job_rows"), pages.alias("pages"))
    jobs, pages, none = c("c_custkey") % 4, c("c_nationkey").cast("bigint"), F.lit(0).cast("bigint")
    runs = row("all", t.customer, jobs, pages).unionByName(row("some", t.customer.filter("c_nationkey <> 3"), jobs, pages)).unionByName(row("twice", t.customer, jobs, pages)).unionByName(row("twice", t.customer.filter("c_custkey % 50 = 7"), none, none))
    return operations.cohort_summary(runs, t.customer.select(c("c_custkey").alias("index")))


_BEFORE, _AFTER = "l_returnflag", "CASE WHEN l_partkey % 3 = 0 THEN l_linestatus ELSE l_returnflag END"


@query(f"""WITH f AS (SELECT l_suppkey % 3 > 0 AS expected, l_tax > 0 AS rendered, l_discount > 0.02 AS visible, {_BEFORE} AS a, {_AFTER} AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'O' ELSE 'N' END AS want FROM lineitem),
o AS (SELECT expected, CASE WHEN NOT rendered THEN 'unrendered' WHEN expected AND NOT visible THEN CASE WHEN a = b THEN 'not_visible' ELSE 'wrong' END WHEN expected THEN CASE WHEN b = want THEN 'filled' WHEN a = b THEN 'missed' ELSE 'wrong' END WHEN a = b THEN 'preserved' ELSE 'wrong' END AS outcome FROM f)
SELECT v.outcome, count(o.outcome) AS n, count(o.outcome) FILTER (v.outcome NOT IN ('not_visible', 'unrendered')) AS scored, count(o.outcome) FILTER (v.outcome NOT IN ('not_visible', 'unrendered') AND expected) AS fillable
FROM (VALUES ('filled'), ('missed'), ('wrong'), ('preserved'), ('not_visible'), ('unrendered')) AS v(outcome) LEFT JOIN o USING (outcome) GROUP BY 1""")
def ot14_field_outcomes(t: Tables):
    """Lines as fields of forms: values before and after, what is expected, and whether it is there and seen."""
    after = F.when(c("l_partkey") % 3 == 0, c("l_linestatus")).otherwise(c("l_returnflag"))
    want = F.when(c("l_linenumber") % 2 == 0, "O").otherwise("N")
    expected = c("l_suppkey") % 3 > 0
    o = operations.field_outcome(expected, c("l_tax") > 0, c("l_discount") > 0.02, c("l_returnflag"), after, after == want)
    return operations.outcome_totals(t.lineitem.select(o.alias("o"), expected.alias("expected")), "o", "expected")


@query("""SELECT c_custkey, CASE WHEN f + s < n THEN 'running' WHEN n > 0 AND f = n THEN 'failed' WHEN f > 0 THEN 'partial' ELSE 'completed' END AS status
FROM (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O' OR o_orderpriority <> '5-LOW' AND o_orderstatus = 'P') AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)""")
def ot20_campaign_status(t: Tables):
    """A customer's orders as a campaign: some not tried yet, some failed."""
    status = c("o_orderstatus")
    n = t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(status == "F").alias("f"), F.count_if((status == "O") | ((status == "P") & (c("o_orderpriority") != "5-LOW"))).alias("s"))
    return n.select("c_custkey", operations.campaign_status(c("n"), c("s"), c("f")).alias("status"))


_JOBS = ("queued", "running", "scheduled", "completed", "partial", "failed", "cancelled", "unknown")


@query(f"""SELECT part, count(*) AS n FROM (SELECT CASE WHEN s IN ('queued', 'running') OR b THEN 'current' WHEN s = 'scheduled' THEN 'scheduled' WHEN s <> 'unknown' THEN 'recent' END AS part FROM (SELECT {listed(_JOBS)}[o_custkey % 8 + 1] AS s, o_orderstatus = 'P' AND o_custkey % 8 = 2 AS b FROM orders)) GROUP BY 1""")
def ot25_partitions(t: Tables):
    status = pick(_JOBS, c("o_custkey") % 8)
    part = operations.client_part(status, (c("o_orderstatus") == "P") & (status == "scheduled"))
    return t.orders.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


_FETCHED, _HTTP = ("ok", "bot_challenge", "http_error", "unsupported_api", None, "timeout"), (200, 401, 403, 429, 500, None)


@query(f"""SELECT event_id, CASE WHEN s = 'ok' THEN NULL WHEN s = 'bot_challenge' THEN s WHEN h IN (401, 403) THEN 'blocked' WHEN h = 429 THEN 'throttled' WHEN s = 'unsupported_api' THEN 'unsupported' ELSE 'failed' END AS failure
FROM (SELECT event_id, {listed(_FETCHED)}[event_id % 6 + 1] AS s, {listed(_HTTP)}[user_id % 6 + 1] AS h FROM events)""")
def ot28_failure_class(t: Tables):
    """Every state of a fetch with every status."""
    return t.events.select("event_id", operations.failure_class(pick(_FETCHED, c("event_id") % 6), pick(_HTTP, c("user_id") % 6)).alias("failure"))


@query("SELECT l.doc_id AS ref, d.source, sha256(d.text) AS quote, d.source IS NOT NULL AS known FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.lang = 'en'")
def ot32_citations(t: Tables):
    """Labels cite documents; those of other languages are not in the catalogue."""
    catalogue = t.documents.filter("lang = 'en'").select(c("doc_id").alias("ref"), "source", "text")
    return imports.resolve_citations(t.labels.select(c("doc_id").alias("ref")), catalogue).select("ref", "source", F.sha2("text", 256).alias("quote"), "known")


@query("""WITH f AS (SELECT o_custkey AS company, CASE WHEN o_orderpriority = '1-URGENT' THEN 'recruitee' ELSE 'lever' END AS provider, 'https://f/' || o_orderkey AS feed_url, o_orderkey % 6 = 0 AS old FROM orders), b AS (SELECT DISTINCT o_custkey AS company FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('2-HIGH', '5-LOW'))
SELECT company, provider, feed_url FROM f WHERE old OR provider <> 'recruitee' OR company NOT IN (SELECT company FROM b)""")
def ot34_deferral(t: Tables):
    """Orders as feeds found, a sixth of them known already, and as postings that pages gave."""
    p, url = c("o_orderpriority"), F.concat(F.lit("https://f/"), c("o_orderkey").cast("string"))
    company = c("o_custkey").alias("company")
    found = t.orders.select(company, F.when(p == "1-URGENT", "recruitee").otherwise("lever").alias("provider"), url.alias("feed_url"))
    feeds = t.orders.filter("o_orderkey % 6 = 0").select(company, url.alias("feed_url"))
    postings = t.orders.select(company, F.when(p == "2-HIGH", "html_jobs").when(p == "5-LOW", "browser_html").otherwise("lever").alias("provider"), (c("o_orderstatus") == "O").alias("is_active"))
    return operations.undeferred(found, feeds, postings)


_FLAT = "regexp_replace(lower({}), '\\s+', ' ', 'g')"


@query(f"""WITH d AS (SELECT doc_id, text, split_part(text, ' ', 2) || '  ' || split_part(text, ' ', 3) AS keyword FROM documents), p AS (SELECT d.doc_id, d.keyword, d.text AS posting, n.text AS output FROM d JOIN d n ON n.doc_id = d.doc_id + 1)
SELECT keyword, contains({_FLAT.format('posting')}, {_FLAT.format('keyword')}) AS in_posting, contains({_FLAT.format('output')}, {_FLAT.format('keyword')}) AS in_output FROM p""")
def ot19_keyword_coverage(t: Tables):
    """Two words of each document against its whole text and the next document's."""
    d = t.documents.select("doc_id", c("text").alias("posting"), F.concat(F.split_part("text", F.lit(" "), F.lit(2)), F.lit("  "), F.split_part("text", F.lit(" "), F.lit(3))).alias("keyword"))
    rows = d.join(t.documents.select((c("doc_id") - 1).alias("doc_id"), c("text").alias("output")), "doc_id")
    return imports.keyword_coverage(rows, c("posting"), c("output"))


@query("""WITH e AS (SELECT event_type AS grp, user_id AS source, event_id AS seq, props AS text, count(*) OVER (PARTITION BY event_type, user_id) AS n, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS place FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY grp, source ORDER BY seq) AS turn FROM e WHERE n <= 4 OR place <= 2 OR place > n - 2), g AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY turn, source) AS spot FROM k)
SELECT 'c' || row_number() OVER (ORDER BY spot, grp) AS ref, grp, source, seq, text FROM g QUALIFY row_number() OVER (ORDER BY spot, grp) <= 300""")
def ot31_citation_catalogue(t: Tables):
    """Events as excerpts of users; the catalogue of 300 references is the feature."""
    excerpts = t.events.select(c("event_type").alias("grp"), c("user_id").alias("source"), c("event_id").alias("seq"), c("props").alias("text"))
    return imports.citation_catalogue(excerpts, limit=300, most=4)


@query("""WITH p AS (SELECT page_id % 60 AS company, max(CASE WHEN ok THEN 3 ELSE 1 END) AS p, arg_min(url, page_id) FILTER (ok) AS career_url FROM (SELECT *, url LIKE 'https%' AND page_id % 4 = 1 AS ok FROM pages) GROUP BY 1),
b AS (SELECT s_suppkey % 70 AS company, max(CASE WHEN s_nationkey % 3 = 0 THEN CASE WHEN s_nationkey % 2 = 0 THEN 5 ELSE 4 END ELSE 2 END) AS b, count(DISTINCT CASE WHEN s_nationkey % 3 = 0 THEN s_name END) AS observed FROM supplier GROUP BY 1),
o AS (SELECT n_nationkey * 3 AS company, CASE n_regionkey WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS o FROM nation)
SELECT company, ['unresolved', 'ats_identified', 'career_content_found', 'jobs_extracted', 'jobs_feed_found'][greatest(coalesce(p, 1), coalesce(b, 1), CASE WHEN o >= 3 THEN o ELSE 1 END)] AS status, career_url, coalesce(observed, 0) AS observed FROM p FULL JOIN b USING (company) FULL JOIN o USING (company)""")
def ot33_ot38_discovery_result(t: Tables):
    """Pages, boards from suppliers and an earlier run from nations, of companies that some of them do not know."""
    k = c("page_id")
    pages = t.pages.select((k % 60).alias("company"), k.alias("page_order"), "url", c("url").startswith("https").alias("trusted"), (k % 4 == 1).alias("career"))
    n = c("s_nationkey")
    boards = t.supplier.select((c("s_suppkey") % 70).alias("company"), F.when(n % 2 == 0, "lever").otherwise("html").alias("provider"), (n % 3 == 0).alias("parsed"), c("s_name").alias("external_id"))
    status = F.when(c("n_regionkey") == 0, "jobs_feed_found").when(c("n_regionkey") == 1, "career_content_found").when(c("n_regionkey") == 2, "ats_identified").otherwise("unresolved")
    prior = t.nation.select((c("n_nationkey") * 3).cast("bigint").alias("company"), status.alias("status"))
    return imports.discovery_result(pages, boards, prior)
