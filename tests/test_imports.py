import json

from pyspark.sql import functions as F

from vacantia.functions import records
from vacantia.operators import imports, search


def test_fixture_keeps_newer(spark):
    comp = spark.createDataFrame([("1", "A", 5), ("2", "B", 5), ("3", "C", None)], "source_id string, name string, observed_at int")
    car = spark.createDataFrame([("1", "u1", "ok")], "source_id string, career_url string, status string")
    old = spark.createDataFrame([("1", "A0", "u0", "old", 9), ("2", "B0", None, "old", 1)], "source_id string, name string, career_url string, status string, observed_at int")
    got = {r.source_id: (r.name, r.career_url) for r in imports.import_fixture(comp, car, old).collect()}
    assert got == {"1": ("A0", "u0"), "2": ("B", None), "3": ("C", None)}


def test_nested_and_profile(spark):
    body = json.dumps([{"name": "X", "feeds": [{"feed_url": "f", "jobs": [{"id": "1", "title": "T", "url": "u"}, {"id": "2", "title": "S", "url": "v"}]}]}])
    pref = json.dumps({"search_area": {"city": "Ulm", "latitude": 48.4, "longitude": 10, "radius_km": 5}, "skills": ["a"], "photo": "x"})
    r = spark.range(1).select(imports.supplement_rows(F.lit(body)).alias("s"), imports.saved_area(F.lit(pref)).alias("a"), imports.saved_area(F.lit("{}")).alias("n"), imports.allowed_profile(F.lit(pref), ["skills"]).alias("p")).first()
    assert [(x.employer, x.external_id) for x in r.s] == [("X", "1"), ("X", "2")] and r.a.city == "Ulm" and r.n is None and list(r.p) == ["skills"]
    src = spark.createDataFrame([("https://a.de/x?utm_source=1",), ("https://A.de/x",), ("https://b.de/y",)], "url string")
    assert [(x.url, x.n) for x in imports.repeated_urls(src).collect()] == [("https://a.de/x", 2)]


def test_locations_and_saves(spark):
    s = "job_id int, label string, latitude double, longitude double"
    new = spark.createDataFrame([(1, "Ulm", None, None), (1, "Bonn", 1.0, 2.0), (1, "Neu", None, None)], s)
    old = spark.createDataFrame([(1, "ULM", 48.4, 10.0), (1, "bonn", 9.0, 9.0)], s)
    assert {r.label: r.latitude for r in imports.location_rows(new, old).collect()} == {"Ulm": 48.4, "Bonn": 1.0, "Neu": None}
    emp, post = spark.createDataFrame([("A", 2)], "name string, job_count long"), spark.createDataFrame([("f", "1", "T")], "feed_url string, external_id string, title string")
    save = spark.createDataFrame([("A", "f", "1", "T"), ("A", "f", "2", "U"), ("B", "g", "1", "V"), ("B", "g", "1", "V")], "employer string, feed_url string, external_id string, title string")
    counts, rows = imports.save_posting(emp, post, save)
    assert {r.name: r.job_count for r in counts.collect()} == {"A": 3, "B": 1} and rows.count() == 3


def test_campaign_merges(spark):
    sl = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y"), ("z", 1, "x")], "source_id string, slice int, status string")
    co = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    assert {r.source_id: r.state for r in imports.merge_results(sl, co).collect()} == {"a": "merged", "b": "repeated", "c": "missing", "z": "foreign"}
    res, pri = spark.createDataFrame([("a", "unresolved", None), ("b", "jobs_extracted", "n")], "source_id string, status string, career_url string"), spark.createDataFrame([("a", "jobs_feed_found", "p"), ("b", "career_content_found", "q")], "source_id string, status string, career_url string")
    assert {r.source_id: (r.status, r.career_url) for r in imports.enrich_build(co, res, pri).collect()} == {"a": ("jobs_feed_found", "p"), "b": ("jobs_extracted", "n"), "c": ("unresolved", None)}
    t = spark.createDataFrame([("p", "first_party"), ("p", "linked_external"), ("q", "linked_external")], "page string, trust string")
    assert {r.page: (r.kept, r.rejected, r.status) for r in imports.drop_unverified(t).collect()} == {"p": (1, 1, "jobs_extracted"), "q": (0, 1, "unresolved")}


def test_citations(spark):
    ex = spark.createDataFrame([("g", "s", k, f"t{k}") for k in range(10)] + [("g", "r", 0, "x"), ("h", "s", 0, "y")], "grp string, source string, seq int, text string")
    cat = imports.citation_catalogue(ex, limit=6, most=4)
    rows = cat.collect()
    assert [(r.ref, r.grp, r.source, r.seq) for r in rows] == [("c1", "g", "r", 0), ("c2", "h", "s", 0), ("c3", "g", "s", 0), ("c4", "g", "s", 1), ("c5", "g", "s", 8), ("c6", "g", "s", 9)]
    cited = spark.createDataFrame([("c3",), ("c99",)], "ref string")
    assert {r.ref: (r.text, r.known) for r in imports.resolve_citations(cited, cat).collect()} == {"c3": ("t0", True), "c99": (None, False)}
    kw = spark.createDataFrame([("Data  Analysis",), ("Go",)], "keyword string")
    assert [(r.in_posting, r.in_output) for r in imports.keyword_coverage(kw, F.lit("data\nanalysis"), F.lit("go")).collect()] == [(True, False), (False, True)]


def test_discovery_result(spark):
    pages = spark.createDataFrame([("a", 2, "u2", True, True), ("a", 1, "u1", True, True), ("b", 1, "v", False, True), ("c", 1, "w", True, True)], "company string, page_order int, url string, trusted boolean, career boolean")
    boards = spark.createDataFrame([("a", "lever", True, "1"), ("a", "lever", True, "1"), ("b", "html", True, "9"), ("d", "softgarden", False, None)], "company string, provider string, parsed boolean, external_id string")
    prior = spark.createDataFrame([("c", "jobs_extracted"), ("e", "ats_identified")], "company string, status string")
    got = {r.company: (r.status, r.career_url, r.observed) for r in imports.discovery_result(pages, boards, prior).collect()}
    assert got == {"a": ("jobs_feed_found", "u1", 1), "b": ("jobs_extracted", None, 1), "c": ("jobs_extracted", "w", 0), "d": ("ats_identified", None, 0), "e": ("unresolved", None, 0)}


def test_votes(spark):
    s = "region string, ags string, name string, valid long, A long, B long"
    areas = spark.createDataFrame([("r1", "1", "Ulm", 10, 6, 4), ("r1", "1", "Ulm", 10, 2, 8), ("r1", "2", "Neu", 10, 5, 5), ("r2", "3", "Au", 10, 1, 9), ("r2", "4", "Au", 0, 0, 0)], s)
    postal = spark.createDataFrame([("r1", "ULM", 10, 6, 2), ("r2", "Au", 5, 5, 0)], "region string, name string, valid long, A long, B long")
    got = {r.ags: (r.valid, r.leading, r.leading_share, r.postal_included) for r in imports.municipality_votes(areas, postal, ["A", "B"]).collect()}
    assert got == {"1": (30, "A / B", 46.67, True), "2": (10, "A / B", 50.0, True), "3": (10, "B", 90.0, False)}


def test_search_helpers(spark):
    c = F.col
    rows = [(1, "Dev", "Acme", "2024-01-01", None, "Bonn", "long text " * 60), (2, "cook", None, "soon", True, None, None)]
    df = spark.createDataFrame(rows, "job_id int, title string, company string, posted string, is_remote boolean, place string, description string").withColumn("posted_at", search.date_rank(c("posted")))
    assert [r.job_id for r in df.orderBy(*search.browse_order("remote")).collect()] == [2, 1] and [r.job_id for r in df.orderBy(*search.browse_order("title")).collect()] == [2, 1]
    assert [r.x for r in df.select(search.candidate_filter(c("place") == "Bonn", F.lit(None).cast("boolean"), c("is_remote"), F.lit(False)).alias("x")).collect()] == [True, True]
    keys = df.select(search.snapshot_key(F.lit(1), q=c("title")).alias("a"), search.snapshot_key(F.lit(2), q=c("title")).alias("b")).first()
    assert keys.a != keys.b and len(keys.a) == 64
    r = spark.createDataFrame([({"closed": "true"},), ({"status": "published"},), ({"isActive": "0"},)], "m map<string,string>").select(records.inactive_row(c("m")).alias("x")).collect()
    assert [x.x for x in r] == [True, False, True]
    assert spark.range(1).select(records.section_modality(F.lit("a.must_have[2].b")).alias("x")).first().x == "requirements"
