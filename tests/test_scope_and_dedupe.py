import random

from pyspark.sql import functions as F

from vacantia.functions import geo, urls
from vacantia.operators import dedupe, identity, relational, scope
from vacantia.operators.components import connected_components

NOW = "2024-06-01 00:00:00"
JOB = "job_id int, valid_through string, work_arrangement string, is_remote boolean, remote_countries array<string>, remote_unresolved boolean, locations array<struct<label:string,country_code:string,latitude:double,longitude:double>>"


def now():
    return F.lit(NOW).cast("timestamp")


def classify(spark, jobs, **kw):
    df = spark.createDataFrame(jobs, JOB)
    return {r.job_id: (r.scope.eligible, r.scope.reason, r.scope.unknowns, r.scope.match_kind) for r in scope.classify(df, now=now(), **kw).collect()}


def test_scope_order_and_reasons(spark):
    ka, far, none = [("Karlsruhe", "DE", 49.0, 8.4)], [("Hamburg", "DE", 53.5, 10.0)], []
    jobs = [
        (1, "2020-01-01", "remote", True, None, None, ka), (2, None, "remote", True, ["FR"], None, none), (3, None, None, True, None, None, far), (4, None, "onsite", True, None, None, ka),
        (5, None, None, False, None, None, far), (6, "garbage", "hybrid", None, None, None, [("Remote", None, 49.01, 8.41)]), (7, None, None, None, None, None, [("Ettlingen", "DE", 48.94, 8.41)]), (8, None, None, None, None, None, [("Karlsruhe, Germany", None, None, None)]),
        (9, None, "remote", None, None, True, none), (10, None, None, None, None, None, none), (11, "2024-06-01", None, None, None, None, ka),
    ]
    got = classify(spark, jobs, lat=49.0, lon=8.4, radius_km=20.0, place="Karlsruhe", country="DE")
    assert got[1][1] == "expired" and got[2][:2] == (False, "remote_country")
    assert got[3] == (True, None, ["Remote country eligibility not stated"], "remote")
    assert got[4] == (True, None, [], "in_area") and got[5][1] == "outside_area"
    assert got[6][3] == "in_area" and got[7][3] == "in_area" and got[8][3] == "in_area"
    assert got[9][1] == "remote_country" and got[10][1] == "outside_area" and got[11][0]
    assert classify(spark, jobs, lat=49.0, lon=8.4, radius_km=20.0, selection="remote")[4][1] == "not_remote"
    assert classify(spark, jobs, selection="area")[3][1] == "remote_not_selected"


def test_location_texts_are_read_once(spark):
    jobs = spark.createDataFrame([], JOB)
    folds = lambda df: df._jdf.queryExecution().analyzed().toString().count("translate(")
    for area in ({"place": "Bonn", "country": "DE"}, {"country": "DE"}, {"state": "Bayern"}):
        assert folds(jobs.select(scope.text_scope(F.col("locations"), **area).alias("within"))) == 2
    assert folds(scope.classify(jobs, now=now(), place="Bonn", country="DE", selection="area")) == 2


def test_places_countries_states(spark):
    df = spark.createDataFrame([("Frankfurt (Oder)",), ("Frankfurt am Main",), ("MUENCHEN, Bayern",), ("Halle Westf.",), ("Sachsen-Anhalt",), ("Paris, fr",), ("Wien, Österreich",), ("Fully remote",), (None,)], "t string")
    rows = df.select("t", scope.names_place(F.col("t"), "Frankfurt").alias("f"), scope.names_place(F.col("t"), "München").alias("m"), scope.names_place(F.col("t"), "Halle").alias("h"), scope.states_in(F.col("t")).alias("s"), scope.countries_in(F.col("t")).alias("c"), scope.is_unspecified(F.col("t")).alias("u")).collect()
    assert [r.f for r in rows] == [False, True] + [False] * 7
    assert rows[2].m and rows[2].s == ["Bayern"] and not rows[3].h
    assert rows[4].s == ["Sachsen-Anhalt"] and rows[5].c == ["FR"] and rows[6].c == ["AT"]
    assert rows[7].u and not rows[2].u


def test_polygons(spark):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
    other = [[10.0, 0.0], [12.0, 0.0], [11.0, 2.0], [10.0, 0.0]]
    pts = [(0.5, 0.5, True), (1.5, 1.5, False), (4.0, 2.0, True), (1.0, 1.5, False), (11.0, 0.5, True), (20.0, 0.0, False), (10.0, 2.0, False)]
    df = spark.createDataFrame([([[ring, hole], [other]], x, y, w) for x, y, w in pts], "p array<array<array<array<double>>>>, x double, y double, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", geo.point_in_polygons("x", "y", "p")).collect())


def test_distances(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(300)] + [(10.0, 179.9, 10.0, -179.9)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    h = geo.haversine_m
    got = df.select(h(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x"), h(F.col("c"), F.col("d"), F.col("a"), F.col("b")).alias("y"), geo.in_box(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(5000.0)).alias("box")).collect()
    assert all(abs(r.x - r.y) < 1e-6 and (r.box or r.x > 5_000_000) for r in got)


def test_radius_join_finds_all_pairs(spark):
    rng = random.Random(3)
    pts = [(k, rng.uniform(-85, 85), rng.uniform(-180, 180)) for k in range(300)]
    ctr = [(k, rng.uniform(-80, 80), rng.uniform(-180, 180)) for k in range(30)] + [(99, 10.0, 179.99)]
    p, c = spark.createDataFrame(pts, "p int, lat double, lon double"), spark.createDataFrame(ctr, "c int, clat double, clon double")
    got = {(r.p, r.c) for r in relational.radius_join(p, c, lat="lat", lon="lon", c_lat="clat", c_lon="clon", radius_km=900.0).collect()}
    d = p.crossJoin(c).filter(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) <= 900_000)
    assert got == {(r.p, r.c) for r in d.collect()} and got


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            comp[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in comp}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


POSTING = "job_id long, feed_id long, external_id string, url string, title string, location_text string, date_posted string, requisition_id string, provider string, tenant string, company_id long, company_category string, company_source string, employer_id long, group_id long, is_active boolean, valid_through string, description string, n_locations int"


def test_vacancy_groups_and_winner(spark):
    base = dict(feed_id=1, title="Data Engineer Backend", location_text="Berlin", date_posted="2024-05-01", provider="greenhouse", tenant="acme", company_id=7, is_active=True, description="d", n_locations=1)
    names = [x.split()[0] for x in POSTING.split(", ")]
    specs = [
        dict(job_id=1, external_id="a", url="https://x.org/jobs/1?utm_source=a", requisition_id="R1"), dict(job_id=2, external_id="b", url="https://x.org/jobs/2", requisition_id="R1", title="Dateningenieur", description="longer text"),
        dict(job_id=3, external_id="c", url="https://X.org/jobs/2/#top", feed_id=2, company_id=8, title="Other thing", valid_through="2020-01-01", description="the longest text of all"), dict(job_id=4, external_id="d", url="https://y.org/careers", feed_id=3, company_id=9, title="Cook in chief"),
        dict(job_id=5, external_id="e", url="https://y.org/jobs", feed_id=4, company_id=9, title="Cook, in Chief", location_text="Berlin Germany"), dict(job_id=6, external_id="f", url=None, feed_id=5, company_id=10, title="Talent Pool", company_source="managed_feed"),
    ]
    df = spark.createDataFrame([tuple((base | s).get(n) for n in names) for s in specs], POSTING)
    groups = {r.job_id: r.group for r in dedupe.group_by_keys(dedupe.vacancy_keys(df)).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    winners = {r.group: r.job_id for r in dedupe.deduplicate(df, now()).collect()}
    assert winners == {1: 2, 4: 4, 6: 6}
    old, new = dedupe.vacancy_keys(df.filter("job_id <= 2")), dedupe.vacancy_keys(df.filter("job_id > 2"))
    stored = old.groupBy("key").agg(F.min("job_id").alias("group"))
    _, merged = dedupe.merge_incrementally(stored.withColumn("group", F.lit(1).cast("long")), new)
    assert {r.job_id: r.group for r in merged.collect()} == {3: 1, 4: 4, 5: 4, 6: 6}


def test_canonical_urls(spark):
    cases = {"HTTPS://A.org/x/?b=2&a=1&utm_id=3&gclid=4#top": "https://a.org/x?a=1&b=2", "https://a.org/jobs": None, "https://a.org/jobs?id=3": "https://a.org/jobs?id=3", "https://a.org/jobs#42": "https://a.org/jobs#42", "ftp://a.org/x": None, "nonsense": None, "https://a.org": None}
    df = spark.createDataFrame(list(cases.items()), "u string, w string")
    assert [(r.u, r.g) for r in df.withColumn("g", urls.canonical_url(F.col("u"))).collect()] == list(cases.items())


def test_greedy_selection(spark):
    rng = random.Random(5)
    rows = [(k, f"s{rng.randrange(12)}", f"d{rng.randrange(12)}") for k in range(60)]
    got = {r.k for r in relational.greedy_one_to_one(spark.createDataFrame(rows, "k int, s string, d string"), "s", "d", ["k"]).collect()}
    s, d, want = set(), set(), set()
    for k, a, b in rows:
        if a not in s and b not in d:
            s.add(a), d.add(b), want.add(k)
    assert got == want


def test_website_suggestions(spark):
    cand = spark.createDataFrame([("n1", "Muster Technik GmbH", None, "info@muster-technik.de; x@gmail.com"), ("n2", "Foo AG", "https://foo.de", None), ("n3", "Bar Werk", "", "a@foo.de")], "source_id string, name string, website string, email string")
    ver = spark.createDataFrame([("n1", "muster-technik.de")], "source_id string, domain string")
    mail = {(r.source_id, r.website_url): r.ineligible_reason for r in identity.suggest_from_emails(cand, ver).collect()}
    assert mail == {("n1", "https://muster-technik.de/"): None, ("n1", "https://gmail.com/"): "free_email_provider", ("n3", "https://foo.de/"): "website_domain_already_mapped"}
    refs = spark.createDataFrame([("n1", "entity", "Q1"), ("n3", "brand", "Q2")], "source_id string, relation string, entity_id string")
    claims = spark.createDataFrame([("Q1", "Muster", "https://muster.com", "preferred", False), ("Q2", "Else", "https://else.com", "normal", False)], "entity_id string, entity_name string, website_url string, claim_rank string, deprecated boolean")
    direct = identity.suggest_from_claims(cand.drop("email"), refs, claims)
    assert {r.source_id: r.eligible for r in direct.collect()} == {"n1": True, "n3": False}
    both = direct.select("source_id", "relation", "website_url", "identity_score", "eligible").unionByName(identity.suggest_from_emails(cand, ver).select("source_id", "relation", "website_url", "identity_score", "eligible"))
    assert [(r.source_id, r.website_url) for r in identity.select_websites(both).collect()] == [("n1", "https://muster.com")]


def test_pages_and_contacts(spark):
    one = spark.createDataFrame([("Muster Technik", "Hauptstr 5 76131 Karlsruhe", "Muster Technik Impressum Tel +49 (0)721 123456, 1.200 Mitarbeiter", ["x@y.de"], ["0721 123456"])], "n string, a string, t string, e array<string>, p array<string>")
    c = F.col
    r = one.select(identity.contact_matches(c("a"), c("t"), c("e"), c("p")).alias("m"), identity.employees_on_page(c("t")).alias("k"), identity.accepts_lead(c("n"), F.lit("https://muster-technik.de"), c("t"), c("t"), F.lit(True)).alias("ok"), identity.is_parked(F.lit("Buy this domain"), F.lit(0)).alias("parked"), identity.row_trust(F.lit("https://muster.de"), c("n"), F.lit("https://jobs.x.io/muster"), F.lit("https://www.muster.de/jobs"), F.lit("Muster")).alias("trust"), identity.link_score(F.lit(70), F.lit("/jobs/17"), F.lit(True)).alias("score"), identity.sitemap_links(F.array(F.lit("https://a.de/x"), F.lit("https://b.de/y"), F.lit("https://a.de/z")), F.lit("https://a.de/s.xml"), F.lit(True)).alias("links"), identity.queries_for(c("n"), F.lit("Ulm"), F.lit(None).cast("string")).alias("q")).first()
    assert (r.m, r.k, r.ok, r.parked, r.trust, r.score) == (True, 1200, True, True, "branded_external", 110)
    assert r.links == ["https://a.de/x"] and len(r.q) == 2
    labels = spark.createDataFrame([("76131 Karlsruhe, Baden",), ("Neustadt",), (None,)], "label string")
    aliases = spark.createDataFrame([("karlsruhe", 1), ("neustadt", 2), ("neustadt", 3)], "alias string, code int")
    assert [tuple(x) for x in identity.resolve_municipalities(labels, aliases).collect()] == [("76131 Karlsruhe, Baden", 1)]


def test_remote_scope(spark):
    loc = "array<struct<label:string,country_code:string,latitude:double,longitude:double>>"
    rows = [('{"remote_country_codes": ["DE", "Frankreich", "??"]}', None), ('{"applicantLocationRequirements": {"name": "Atlantis"}}', None), ('{"remote_country_codes": [], "remote_country": "at"}', None), ('{"remote_scope_source": "x", "country": "Germany"}', [("Wien", "AT", None, None)]), ("{}", [("Wien", "AT", None, None)]), (None, None)]
    got = [r.s for r in spark.createDataFrame(rows, f"m string, l {loc}").select(scope.remote_scope(F.col("m"), F.col("l")).alias("s")).collect()]
    assert [(x.countries, x.unresolved) for x in got] == [(["DE", "FR"], False), ([], True), (["AT"], False), (["AT", "DE"], False), ([], False), ([], False)]


def test_listed_locations(spark):
    loc = "array<struct<label:string,country_code:string>>"
    both = [("München", "DE"), ("Wien", "AT")]
    rows = [("Wien, Innenstadt", both), ("Munchen", both), ("Bonn", both), ("Bonn", [("Köln", "DE")]), (None, both)]
    got = [r.x.label if r.x else None for r in spark.createDataFrame(rows, f"t string, l {loc}").select(scope.listed_location(F.col("t"), F.col("l")).alias("x")).collect()]
    assert got == ["Wien", "München", None, "Köln", None]
    assert spark.range(1).select(scope.location_parts(F.lit("Bonn; Köln / Ulm|A/B")).alias("p")).first().p == ["Bonn", "Köln", "Ulm", "A/B"]


def test_vector_topk_in_blocks_of_queries(spark, monkeypatch):
    from vacantia.operators import search

    items = spark.createDataFrame([(k, [float(k % 7), float(k % 5) - 2, 1.0]) for k in range(60)], "item long, v array<float>").repartition(3)
    queries = items.filter("item % 3 = 0").withColumnRenamed("item", "query")
    ask = lambda: sorted(map(tuple, search.vector_topk(items, queries, item="item", query="query", vector="v", k=4).collect()))
    whole = ask()
    monkeypatch.setattr(search, "MAX_QUERIES", 3)
    assert len(whole) == 20 * 4 and ask() == whole


def test_vector_topk_holds_few_distances_at_once(spark, monkeypatch):
    """Any number of queries a step gives the same rows, ties by id among them."""
    from vacantia.operators import search

    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(3)) + 0.5 for _ in range(3)]) for i in range(60)]
    items = spark.createDataFrame(rows, "item long, v array<double>").repartition(2)
    queries = items.filter("item % 4 = 0").withColumnRenamed("item", "query")
    ask = lambda: sorted(map(tuple, search.vector_topk(items, queries, item="item", query="query", vector="v", k=4).collect()))
    want = ask()
    monkeypatch.setattr(search, "CELLS", 100)
    assert ask() == want and len(want) == 60


def test_or_join_gives_each_pair_once_without_shuffling_pairs(spark, monkeypatch):
    rng = random.Random(7)
    side = lambda n: [(rng.randrange(n) if rng.random() < 0.95 else None, rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None])) for _ in range(2 * n)]
    left, right = side(40), side(30)
    want = {(a, b) for a, k, m in left for b, j, n in right if ((k is not None and k == j) or (m is not None and m == n))}
    monkeypatch.setattr(relational, "BLOCK", 5)
    out = relational.or_join(spark.createDataFrame(left, "a long, k int, m string"), spark.createDataFrame(right, "b long, j int, n string"), [("k", "j"), ("m", "n")], left_id="a", right_id="b")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
