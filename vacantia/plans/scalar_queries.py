"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import dates, geo, records, strings, urls, vectors
from vacantia.plans.catalog import Tables, query

c = F.col
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query(f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS domain FROM pages")
def domain_key(t: Tables):
    return t.pages.select("page_id", urls.domain_key(c("url")).alias("domain"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$', ['s', 'h', 'p', 'q', 'f']) AS u FROM pages),
q AS (SELECT page_id, u, CASE WHEN rtrim(u.p, '/') = '' THEN '/' ELSE rtrim(u.p, '/') END AS path, list_sort(list_filter(string_split(ltrim(u.q, '?'), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ('gh_src', 'gclid', 'fbclid', 'msclkid', 'trk'))) AS kept,
CASE WHEN ltrim(u.f, '#') IN ('top', 'jobs', 'careers', 'main', 'content') THEN '' ELSE ltrim(u.f, '#') END AS frag FROM p)
SELECT page_id, CASE WHEN u.s = '' THEN NULL WHEN regexp_extract(path, '([^/]*)$', 1) IN ('', 'jobs', 'index.html') AND frag = '' AND NOT list_bool_or(list_transform(list_append(kept, ''), lambda x: split_part(x, '=', 1) IN ('id', 'ref') AND split_part(x, '=', 2) <> '')) THEN NULL
ELSE lower(u.s) || '://' || lower(u.h) || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || CASE WHEN frag <> '' THEN '#' || frag ELSE '' END END AS canonical FROM q""")
def url_canonical(t: Tables):
    return t.pages.select("page_id", urls.canonical_url(c("url")).alias("canonical"))


@query(f"""SELECT page_id, CASE WHEN regexp_matches({_HOST}, '^(www|m|blog)\\.[a-z-]+\\.example\\.(com|org|net)$') THEN 'demo' END AS provider, CASE WHEN regexp_matches({_HOST}, '^(www|m|blog)\\.[a-z-]+\\.example\\.(com|org|net)$') THEN split_part({_HOST}, '.', 1) END AS tenant FROM pages""")
def src15_identify_provider(t: Tables):
    found = urls.identify_provider(c("url"), extra=(("demo", r"^(www|m|blog)\.[a-z-]+\.example\.(com|org|net)$", 1),))
    return t.pages.select("page_id", found.alias("f")).select("page_id", "f.provider", "f.tenant")


@query("""SELECT doc_id, CASE WHEN contains(s, 'hybrid') THEN 'hybrid' WHEN regexp_matches(s, 'remote|work from home|telecommute') AND NOT regexp_matches(s, 'remote (options?|available)') THEN 'remote' WHEN regexp_matches(s, 'on-site|onsite|on site|office-based|vor ort') THEN 'onsite' END AS arrangement
FROM (SELECT doc_id, regexp_replace(trim(lower(text || CASE WHEN doc_id % 5 = 0 THEN ' Remote' WHEN doc_id % 5 = 1 THEN ' remote  options' WHEN doc_id % 5 = 2 THEN ' vor  Ort' ELSE '' END)), '\\s+', ' ', 'g') AS s FROM documents)""")
def sc24_work_arrangement(t: Tables):
    text = F.concat("text", F.when(c("doc_id") % 5 == 0, " Remote").when(c("doc_id") % 5 == 1, " remote  options").when(c("doc_id") % 5 == 2, " vor  Ort").otherwise(""))
    return t.documents.select("doc_id", strings.work_arrangement(text).alias("arrangement"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' (m/w/d)', '(?i)\\s*\\(m/w/d\\)\\s*$', '')) AS title FROM part")
def sc09_title_identity(t: Tables):
    return t.part.select("p_partkey", strings.title_identity(F.concat("p_name", F.lit(" (m/w/d)"))).alias("title"))


@query("SELECT o_orderkey, left(sha256(o_orderkey::VARCHAR || chr(31) || o_orderpriority), 24) AS id FROM orders")
def sc10_stable_id(t: Tables):
    return t.orders.select("o_orderkey", strings.stable_id(c("o_orderkey").cast("string"), c("o_orderpriority")).alias("id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN o_orderkey WHEN o_orderkey % 4 = 2 THEN o_orderkey ELSE NULL END AS employees FROM orders")
def sc25_employee_count(t: Tables):
    k = c("o_orderkey").cast("string")
    text = F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit("about "), k)).when(c("o_orderkey") % 4 == 1, k).when(c("o_orderkey") % 4 == 2, F.concat(k, F.lit(" – "), (c("o_orderkey") + 10).cast("string"))).otherwise(F.concat(k, F.lit("-"), F.lit("0")))
    return t.orders.select("o_orderkey", strings.employee_count(text).alias("employees"))


@query("SELECT item_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9äöüß+#]{2,}'), lambda w: w NOT IN ('the', 'and', 'of', 'to', 'in', 'a', 'for', 'with', 'der', 'die', 'das', 'und', 'in', 'mit', 'für', 'von'))) AS n FROM benchmark")
def sc27_tokenize(t: Tables):
    return t.benchmark.select("item_id", F.size(strings.tokenize(c("text"))).cast("bigint").alias("n"))


@query("SELECT item_id, contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), trim(regexp_replace(lower(substr(text, 5, 20)), '\\s+', ' ', 'g'))) AND trim(substr(text, 5, 20)) <> '' AS ok FROM benchmark")
def sc29_quote_grounding(t: Tables):
    return t.benchmark.select("item_id", strings.grounded(F.upper(F.substring("text", 5, 20)), c("text")).alias("ok"))


@query("SELECT page_id, regexp_matches(html, '(?i)just a moment|attention required|verify(ing)? (that )?you are (a )?human|captcha|access denied|ddos protection') AS challenge FROM pages")
def sc30_challenge(t: Tables):
    return t.pages.select("page_id", strings.is_challenge(c("html")).alias("challenge"))


@query("SELECT p_partkey, CASE WHEN least(len(list_distinct(a)), len(list_distinct(b))) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / least(len(list_distinct(a)), len(list_distinct(b))) ELSE 0 END AS score FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_name || ' ' || p_type), ' ') AS b FROM part)")
def sc26_identity_score(t: Tables):
    return t.part.select("p_partkey", strings.token_overlap(F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN NULL WHEN event_id % 3 = 2 THEN date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND ELSE date_trunc('second', ts) END AS at, CASE WHEN event_id % 3 = 1 THEN false WHEN event_id % 3 = 2 THEN date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND < TIMESTAMP '2024-01-15' ELSE date_trunc('second', ts) < TIMESTAMP '2024-01-15' END AS expired FROM events")
def sc40_fil12_iso_and_expiry(t: Tables):
    ts = c("ts").cast("timestamp")
    text = F.when(c("event_id") % 3 == 1, "not a date").when(c("event_id") % 3 == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return t.events.select("event_id", dates.parse_iso(text, end_of_day=True).cast("timestamp_ntz").alias("at"), dates.is_expired(text, now).alias("expired"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def sc41_epoch_millis(t: Tables):
    ts = c("ts").cast("timestamp")
    text = F.when(c("event_id") % 2 == 0, F.unix_millis(ts).cast("string")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
    return t.events.select("event_id", dates.epoch_or_prefix_date(text).alias("day"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def sc42_feed_date(t: Tables):
    ts = c("ts").cast("timestamp")
    text = F.when(c("event_id") % 2 == 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss +0000")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.events.select("event_id", dates.parse_feed_date(text).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, ts::DATE AS deadline FROM events")
def sc43_deadline(t: Tables):
    ts = c("ts").cast("timestamp")
    text = F.concat(F.lit("Apply until "), F.dayofmonth(ts).cast("string"), F.lit(". "), F.when(c("event_id") % 2 == 0, "Januar").otherwise("January"), F.lit(" "), F.year(ts).cast("string"), F.lit("!"))
    return t.events.select("event_id", dates.deadline_from_text(text).alias("deadline"))


@query("SELECT event_id, date_trunc('week', ts)::DATE AS week, floor(epoch(ts) / 900)::BIGINT AS bucket FROM events")
def freshness_bucket(t: Tables):
    ts = c("ts").cast("timestamp")
    return t.events.select("event_id", F.to_date(dates.week_start(ts)).alias("week"), dates.freshness_bucket(ts).alias("bucket"))


_FRACTION = "(('0x' || sha256('company:' || c_custkey)[1:15])::BIGINT / 1152921504606846975.0::DOUBLE)"


@query(f"SELECT c_custkey, round(8640 * 7 * (0.8 + 0.2 * {_FRACTION}), 2) AS due_in, ('0x' || sha256('company:' || c_custkey)[1:15])::BIGINT % 259200 AS spread, least(60.0 * pow(2, c_custkey % 12), 3600.0) AS wait FROM customer")
def sc46_sc47_sc48_schedule(t: Tables):
    key = F.concat(F.lit("company:"), c("c_custkey").cast("string"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    due = (F.unix_micros(dates.next_due(now, F.lit(7), key)) - F.unix_micros(now)) / 10_000_000
    return t.customer.select("c_custkey", F.round(due, 2).alias("due_in"), dates.spread(key, 259_200).alias("spread"), dates.backoff_seconds(c("c_custkey") % 12, 60, 3600).alias("wait"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-15' + to_seconds((event_id % 1000)::DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN greatest(date_trunc('second', ts), TIMESTAMP '2024-01-15') ELSE NULL END AS at FROM events")
def sc49_retry_after(t: Tables):
    ts, now = c("ts").cast("timestamp"), F.lit("2024-01-15 00:00:00").cast("timestamp")
    k = c("event_id") % 4
    header = F.when(k == 0, (c("event_id") % 1000).cast("string")).when(k == 1, "99999999").when(k == 2, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss +0000")).otherwise("soon")
    return t.events.select("event_id", dates.retry_after(header, now).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS label FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def ot26_elapsed_label(t: Tables):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    now = F.timestamp_micros(F.unix_micros(start) + (c("event_id") * 7 % 9000) * 1_000_000)
    return t.events.select("event_id", dates.elapsed_label(start, now).alias("label"))


@query("SELECT s_suppkey, round(200 / 110.0, 6) AS dlat, round(200 / (110.0 * cos(radians(46 + s_suppkey % 9))), 6) AS dlon, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 46.5 + s_suppkey % 9 END AS lat FROM supplier")
def sc51_sc52_degrees(t: Tables):
    dlat, dlon = geo.degree_deltas((46 + c("s_suppkey") % 9).cast("double"), F.lit(200.0))
    raw = F.when(c("s_suppkey") % 3 == 0, "true").when(c("s_suppkey") % 3 == 1, (46.5 + c("s_suppkey") % 9).cast("string")).otherwise("123.4")
    return t.supplier.select("s_suppkey", F.round(dlat, 6).alias("dlat"), F.round(dlon, 6).alias("dlon"), geo.latitude(raw).alias("lat"))


@query("SELECT s_suppkey, unnest([s_suppkey, s_suppkey, s_suppkey + 0.5, s_suppkey + 0.5])::DOUBLE AS south, unnest([0, 1, 0, 1])::DOUBLE AS west FROM supplier")
def sc58_quadrants(t: Tables):
    s = c("s_suppkey").cast("double")
    return t.supplier.select("s_suppkey", F.explode(geo.quadrants(s, F.lit(0.0), s + 1, F.lit(2.0))).alias("q")).select("s_suppkey", "q.south", "q.west")


@query("SELECT vec_id, CASE WHEN s >= 0.84 THEN least(59, 30 + round_even((s - 0.84) / 0.07 * 29, 0)::INT) ELSE 0 END AS score, greatest(-10, least(5, vec_id % 40 - 20)) AS clamped FROM (SELECT vec_id, 0.80::DOUBLE + vec_id % 17 / 100.0::DOUBLE AS s FROM embeddings)")
def sc55_sc57_scores(t: Tables):
    s = F.lit(0.80) + c("vec_id") % 17 / 100.0
    return t.embeddings.select("vec_id", vectors.similarity_score(s).alias("score"), vectors.clamp(c("vec_id") % 40 - 20, -10, 5).cast("bigint").alias("clamped"))


@query("SELECT o_orderkey, sha256('{\"customer\":' || o_custkey || ',\"status\":\"' || o_orderstatus || '\"}') AS key FROM orders")
def sc62_criteria_key(t: Tables):
    return t.orders.select("o_orderkey", records.canonical_hash(status=c("o_orderstatus"), customer=c("o_custkey")).alias("key"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS a, event_type || 'x' AS b FROM events")
def sc63_sc64_metadata_maps(t: Tables):
    old = F.create_map(F.lit("a"), F.when(c("event_id") % 2 == 1, c("event_type")), F.lit("b"), F.lit("old"))
    new = F.create_map(F.lit("a"), F.lit(" "), F.lit("b"), F.concat("event_type", F.lit("x")))
    merged = records.drop_empty(records.merge_maps(old, new))
    return t.events.select("event_id", F.try_element_at(merged, F.lit("a")).alias("a"), F.try_element_at(merged, F.lit("b")).alias("b"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' WHEN 2 THEN 'AT' END AS code FROM nation")
def sc65_country_code(t: Tables):
    from vacantia.operators.scope import COUNTRIES

    k = c("n_nationkey") % 4
    raw = F.when(k == 0, " de").when(k == 1, '{"address": {"addressCountry": "France"}}').when(k == 2, "Österreich").otherwise("Atlantis")
    return t.nation.select("n_nationkey", records.country_code(raw, COUNTRIES).alias("code"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN s_name || ' GmbH' END AS org FROM supplier")
def sc66_hiring_organization(t: Tables):
    k = c("s_suppkey") % 3
    meta = F.when(k == 0, F.to_json(F.struct(F.struct(c("s_name").alias("name")).alias("hiring_organization")))).when(k == 1, F.to_json(F.struct(F.concat("s_name", F.lit(" GmbH")).alias("company")))).otherwise("{}")
    return t.supplier.select("s_suppkey", records.hiring_organization(meta).alias("org"))


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 50) || chr(10) || '[…]' || chr(10) || right(text, 50) END AS bounded FROM documents")
def sc28_head_and_tail(t: Tables):
    return t.documents.select("doc_id", strings.head_and_tail(c("text"), 100).alias("bounded"))


@query()
def sc21_pack_words(t: Tables):
    return t.benchmark.select("item_id", F.posexplode(strings.pack_words(c("text"), 80)).alias("n", "chunk"))


@query()
def sc60_json_leaves(t: Tables):
    return t.events.select("event_id", F.explode(records.json_leaves(c("props"))).alias("leaf")).select("event_id", "leaf.path", "leaf.value")


@query("SELECT s_suppkey, '0721' || lpad(s_suppkey::VARCHAR, 5, '0') AS phone FROM supplier")
def ot42_phone_key(t: Tables):
    k = F.lpad(c("s_suppkey").cast("string"), 5, "0")
    raw = F.when(c("s_suppkey") % 3 == 0, F.concat(F.lit("+49 (0)721 / "), k)).when(c("s_suppkey") % 3 == 1, F.concat(F.lit("0049 721 "), k)).otherwise(F.concat(F.lit("0721-"), k))
    return t.supplier.select("s_suppkey", strings.phone_key(raw).alias("phone"))


@query()
def html_text(t: Tables):
    from vacantia.sources import html

    return t.pages.select("page_id", html.html_text(c("html")).alias("text"))


@query()
def html_links(t: Tables):
    from vacantia.sources import html

    return t.pages.select("page_id", F.explode(html.html_links(c("html"), c("url"))).alias("l")).select("page_id", "l.href", "l.text", "l.score")


@query()
def src20_inspect_pages(t: Tables):
    from vacantia.sources import html

    return html.inspect_pages(t.pages.select("page_id", "url", "html")).select("page_id", "kind", F.size("links").alias("n_links"), F.size("headings").alias("n_headings"), F.size("postings").alias("n_postings"))


@query()
def src11_page_postings(t: Tables):
    from vacantia.sources import career_pages

    p = t.pages.select("page_id", career_pages.page_postings(c("html"), c("url")).alias("p"))
    return p.select("page_id", F.size("p.postings").alias("n_postings"), F.size("p.hints").alias("n_hints"), "p.complete", "p.page_title", "p.open_signal")
