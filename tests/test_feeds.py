import json

from pyspark.sql import functions as F

from vacantia.sources import feeds, html

GH = {"jobs": [{"id": 7, "title": "Dev ", "absolute_url": "https://x.io/7", "location": {"name": "Kaiserstr 1, 76131 Karlsruhe"}, "offices": [{"name": "ACME GmbH"}], "departments": [{"name": "IT"}], "content": "&lt;p&gt;Build &amp;amp; run&lt;/p&gt;", "requisition_id": "R7"}, {"id": 8, "title": "Ops", "absolute_url": "https://x.io/8", "location": {"name": "Remote, Germany"}, "offices": []}], "meta": {"total": 3}}
LEVER = [{"id": "l1", "text": "Cook", "hostedUrl": "https://l.co/1", "categories": {"location": "Berlin", "team": "Kitchen", "commitment": "Full-time"}, "workplaceType": "hybrid", "createdAt": 1704067200000}]
ASHBY = {"jobs": [{"id": "a", "title": "PM", "jobUrl": "https://a.io/a", "isListed": True, "isRemote": True, "secondaryLocations": [{"location": "Ulm"}]}, {"id": "b", "title": "X", "jobUrl": "https://a.io/b", "isListed": False}]}
SCHEMA = {"@type": "DataFeed", "numberOfItems": 1, "dataFeedElement": [{"@type": "DataFeedItem", "item": {"@type": "JobPosting", "identifier": {"value": "s1"}, "url": "https://s.io/1", "title": "T", "employmentType": ["FULL_TIME", "OTHER"], "jobLocationType": "TELECOMMUTE", "jobLocation": [{"address": {"addressLocality": "Bonn", "addressCountry": "DE"}}], "validThrough": "2030-01-01"}}]}
SMART = {"offset": 0, "limit": 100, "totalFound": 1, "content": [{"id": "744", "name": "Dev", "visibility": "PUBLIC", "refNumber": "R1", "releasedDate": "2024-02-03T10:00:00Z", "company": {"identifier": "Acme", "name": "Acme AG"}, "location": {"city": "Bonn", "country": "de", "remote": False}}]}
MAP = {"status_code": 200, "data": {"id1": {"company": "T", "job_title": "Dev / Ops (m)", "city": "Bonn, Ulm", "location": "Bonn"}, "id2": {"company": "T", "job_title": "Initiativbewerbung", "city": "Bonn", "location": "Bonn"}}}
PERSONIO = "<workzag-jobs><position><id>11</id><name>Dev</name><office>Bonn</office><department>IT</department><createdAt>2024-01-02T00:00:00</createdAt><jobDescriptions><jobDescription><name>A</name><value>&lt;b&gt;Hi&lt;/b&gt;</value></jobDescription><jobDescription><name>B</name><value>Ho</value></jobDescription></jobDescriptions></position><position><id>12</id><name>Ops</name></position></workzag-jobs>"
RECRUITEE = "<offers><offer><id>5</id><slug>dev</slug><title>Dev</title><city>Bonn</city><country_code>de</country_code><remote>true</remote></offer></offers>"
RSS = "<rss><channel><item><title>Dev &amp; Ops</title><link>https://r.io/1</link><guid>g1</guid><description>Ort: Bonn | x</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>No link</title></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><id>urn:1</id><link href="https://r.io/a" rel="alternate"/><link href="https://r.io/self" rel="self"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>'


def parsed(spark, rows):
    df = spark.createDataFrame([(k, p, u, b if isinstance(b, str) else json.dumps(b)) for k, (p, u, b) in enumerate(rows)], "feed_id int, provider string, board_url string, body string")
    return {r.feed_id: r for r in feeds.parse_feeds(df).collect()}


def test_providers(spark):
    got = parsed(spark, [("greenhouse", "", GH), ("lever", "", LEVER), ("ashby", "", ASHBY), ("schema_org", "", SCHEMA), ("smartrecruiters", "", SMART), ("telekom", "https://c.io/de/jobs", MAP), ("personio", "https://a.jobs.personio.de", PERSONIO), ("recruitee", "https://a.recruitee.com", RECRUITEE), ("rss", "https://r.io/f", RSS), ("rss", "https://r.io/f", ATOM), ("personio", "https://a.jobs.personio.de/job/12", PERSONIO)])
    assert all(r.error is None for r in got.values()), {k: r.error for k, r in got.items()}
    assert [got[k].complete for k in range(11)] == [False, True, True, True, True, False, True, True, False, False, False]
    g = got[0].postings
    assert [p.external_id for p in g] == ["7", "8"] and g[0].title == "Dev" and [x.label for x in g[0].locations] == ["ACME GmbH", "Karlsruhe"] and g[0].metadata["requisition_id"] == "R7"
    assert g[1].is_remote and g[1].work_arrangement == "remote" and g[0].department == "IT"
    assert got[1].postings[0].date_posted == "2024-01-01" and got[1].postings[0].work_arrangement == "hybrid" and got[1].postings[0].department == "Kitchen"
    assert len(got[2].postings) == 1 and got[2].postings[0].is_remote and got[2].postings[0].locations[0].label == "Ulm"
    s = got[3].postings[0]
    assert (s.external_id, s.employment_type, s.is_remote, s.location, s.metadata["validThrough"]) == ("s1", "FULL_TIME, OTHER", True, "Bonn", "2030-01-01")
    assert got[4].postings[0].url == "https://jobs.smartrecruiters.com/Acme/744" and got[4].postings[0].locations[0].country_code == "DE"
    assert [p.url for p in got[5].postings] == ["https://c.io/de/jobs/dev-ops-m-id1"] and [x.label for x in got[5].postings[0].locations] == ["Bonn", "Ulm"]
    assert got[6].postings[0].description == "Hi\n\nHo" and got[6].postings[0].url == "https://a.jobs.personio.de/job/11" and len(got[6].postings) == 2
    assert got[7].postings[0].url == "https://a.recruitee.com/o/dev" and got[7].postings[0].is_remote
    assert [(p.external_id, p.title, p.location) for p in got[8].postings] == [("g1", "Dev & Ops", "Bonn")] and got[8].postings[0].date_posted.startswith("2024-01-01T10:00")
    assert [(p.external_id, p.url) for p in got[9].postings] == [("urn:1", "https://r.io/a")]
    assert [p.external_id for p in got[10].postings] == ["12"]


def test_unexpected_bodies_fail_closed(spark):
    bad = [("greenhouse", "", {"x": 1}), ("lever", "", "not json"), ("schema_org", "", {"@type": "Thing"}), ("smartrecruiters", "", SMART | {"totalFound": 0}), ("telekom", "", {"status_code": 500}), ("personio", "", "<html/>"), ("recruitee", "", "<!DOCTYPE x><offers></offers>"), ("rss", "", "<!DOCTYPE x>" + RSS), ("unknown", "", "{}"), ("greenhouse", "", {"jobs": [{"id": 1, "title": "", "absolute_url": "https://x"}]})]
    for r in parsed(spark, bad).values():
        assert r.error and not r.complete and r.postings == []


def test_employment_service_rows(spark):
    row = {"refnr": "A/1", "titel": "Koch", "arbeitgeber": "Hof  GmbH", "arbeitsort": {"ort": "Ulm", "plz": "89073", "koordinaten": {"lat": 48.4, "lon": 999}}, "homeofficetyp": "ANGABE_IN_PROZENT", "homeofficeprozent": 100, "gehaltsspanneVon": "10", "gehaltsspanneBis": "20", "arbeitszeitVollzeit": True, "veroeffentlichungszeitraum": {"von": "2024-01-01"}}
    page = json.dumps({"ergebnisliste": [row, {"titel": "no reference"}]})
    df = spark.createDataFrame([(page,), (json.dumps({"jobs": [row]}),), (json.dumps({"stellenangebote": []}),)], "p string").select(F.explode(feeds.search_rows(F.col("p"))).alias("r"))
    got = [r.x for r in df.select(feeds.employment_service(F.col("r")).alias("x")).collect()]
    assert [x is None for x in got] == [False, True, False]
    x = got[0]
    assert (x.external_id, x.url, x.work_arrangement, x.salary, x.employment_type, x.locations[0].label, x.locations[0].latitude) == ("A/1", "https://www.arbeitsagentur.de/jobsuche/jobdetail/A%2F1", "remote", "10 – 20", "full_time", "Ulm, 89073", None)


def test_map_elements_tiles_captures(spark):
    el = [{"type": "node", "id": 1, "lat": 49.0, "lon": 8.4, "tags": {"name": "A", "office": "it"}}, {"type": "way", "id": 2, "center": {"lat": 49.01, "lon": 8.41}, "tags": {"name": "B"}}, {"type": "node", "id": 3, "lat": 52.0, "lon": 8.4, "tags": {"name": "far"}}, {"type": "node", "id": 4, "lat": 49.0, "lon": 8.4, "tags": {}}, {"type": "node", "id": 1, "lat": 49.0, "lon": 8.4, "tags": {"name": "A2"}}]
    df = spark.createDataFrame([(k, json.dumps(e)) for k, e in enumerate(el)], "seq int, body string")
    assert {(r.source_id, r.name) for r in feeds.map_elements(df, lat=49.0, lon=8.4, radius_km=10.0).collect()} == {("node/1", "A2"), ("way/2", "B")}
    tiles = feeds.state_tiles(spark.createDataFrame([("X", 0.0, 0.0, 1.2, 0.9)], "state string, south double, west double, north double, east double")).collect()
    assert len(tiles) == 6 and max(t.north for t in tiles) == 1.2 and max(t.east for t in tiles) == 0.9
    import hashlib

    body = lambda b: (b, hashlib.sha256(b.encode()).hexdigest())
    caps = [("u", 1, *body("old")[::-1]), ("u", 2, *body("new")[::-1]), ("u", 3, "00", "forged")]
    got = feeds.merge_captures(spark.createDataFrame(caps, "url string, captured_at int, sha256 string, body string")).collect()
    assert [(r.captured_at, r.body) for r in got] == [(2, "new")]


def test_html(spark):
    page = '<html><head><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Dev","identifier":{"value":"9"},"url":"/j/9","datePosted":"2024-01-02T00:00"}]}</script><style>x</style></head><body><h1>Karriere</h1><p>Hello <b>you</b></p><a href="/karriere/jobs">Jobs</a><a href="x">x</a></body></html>'
    df = spark.createDataFrame([(1, "https://a.de/", page), (2, "https://a.de/", None), (3, None, "<p>Just a moment</p>")], "page_id int, url string, html string")
    got = {r.page_id: r for r in html.inspect_pages(df).collect()}
    assert got[1].kind == "postings" and got[1].text == "Karriere Hello you Jobs x" or got[1].text.startswith("Karriere Hello you")
    assert got[1].postings[0].url == "https://a.de/j/9" and got[1].links[0].href == "https://a.de/karriere/jobs" and got[1].headings[0].text == "Karriere"
    assert got[2].kind == "other" and got[2].links == [] and got[3].kind == "challenge"


def test_pages_are_not_read_in_large_batches(spark):
    """Arrow batches hold ten thousand pages with all that is read from them; rows of a hundred do not grow with the table."""
    df = spark.createDataFrame([(1, "https://a.de/", "<p>a</p>")], "page_id int, url string, html string")
    for out in (df.select(html.html_text(F.col("html"))), df.select(html.html_links(F.col("html"), F.col("url"))), html.inspect_pages(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_whole_text_of_a_long_page(spark):
    """Nothing in the middle of a page, or of an embedded posting's description, is left out."""
    words = " ".join(f"w{k}" for k in range(60_000))
    assert len(words) > 240_000
    script = json.dumps({"@type": "JobPosting", "title": "Dev", "url": "/j", "description": f"<p>{words}</p>"})
    page = f'<script type="application/ld+json">{script}</script><h1>Jobs</h1><p>{words}</p><p>end</p>'
    df = spark.createDataFrame([(1, "https://a.de/", page)], "page_id int, url string, html string")
    assert df.select(html.html_text(F.col("html")).alias("text")).first().text == f"Jobs {words} end"
    assert html.inspect_pages(df).first().postings[0].description == words


def test_half_a_surrogate_in_a_page(spark):
    page = '<script type="application/ld+json">{"@type":"JobPosting","title":"Dev \\ud83d","url":"/j"}</script><p>a</p>'
    got = html.inspect_pages(spark.createDataFrame([("https://a.de/", page)], "url string, html string")).first()
    assert got.kind == "postings" and got.postings[0].title.startswith("Dev ")


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("source_id;name\n1;A\n2;B\n")
    (tmp_path / "k.json").write_text(json.dumps([{"source_id": "1", "career_url": "https://a.de/jobs"}]))
    got = spark.read.csv(str(tmp_path / "c.csv"), sep=";", header=True).join(spark.read.json(str(tmp_path / "k.json"), multiLine=True), "source_id", "left")
    got.write.mode("overwrite").json(str(tmp_path / "out"))
    assert sorted((r.source_id, r.career_url) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("1", "https://a.de/jobs"), ("2", None)]


def test_employment_service_row_is_parsed_once(spark):
    rows = spark.range(1).select(F.col("id").cast("string").alias("body"))
    plan = rows.select(feeds.employment_service(F.col("body")).alias("p")).select("p.external_id", "p.title", "p.locations")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
