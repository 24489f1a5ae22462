from pyspark.sql import functions as F

from vacantia.operators import analytics, imports, scope

ROW = "id int, valid_through string, work_arrangement string, is_remote boolean, remote_countries array<string>, remote_unresolved boolean, locations array<struct<label:string,country_code:string,latitude:double,longitude:double>>, employer_country string, employer_state string, feed_state string, default_feed boolean"


def _row(id, spots, *, until=None, how=None, country=None, state=None, feed_state=None, feed=None, lands=None):
    return id, until, how, None, lands, False, None if spots is None else [(a, b, None, None) for a, b in spots], country, state, feed_state, feed


def _verdicts(spark, rows, **how):
    got = scope.classify_by_employer(spark.createDataFrame(rows, ROW), now=F.lit("2024-01-01").cast("timestamp"), **how)
    return {r["id"]: r["v"] for r in got.select("id", F.coalesce("scope.reason", "scope.match_kind").alias("v")).collect()}


def test_the_employer_stands_in_for_an_unsaid_place(spark):
    rows = [
        _row(1, [("Remote", None)], country="DE"), _row(2, [("Paris, France", "DE")], country="DE"), _row(3, [], state="Hessen"), _row(4, [("flexible", "de")]), _row(5, [], feed=True), _row(6, []), _row(7, [], country="AT"),
        _row(8, [("Bonn", "DE")], until="2020-01-01", country="DE"), _row(9, [("Bonn", "DE")], how="remote", lands=["FR"]), _row(10, [("Bonn", "DE")], how="remote"), _row(11, [("Bayern", None)], country="AT"), _row(12, None, country="DE"),
    ]
    got = _verdicts(spark, rows)
    inside, out = "employer_in_country", "outside_area"
    assert got == {1: inside, 2: out, 3: inside, 4: inside, 5: inside, 6: out, 7: out, 8: "expired", 9: "remote_country", 10: "remote", 11: "work_location", 12: inside}
    assert _verdicts(spark, rows, selection="remote")[1] == "not_remote" and _verdicts(spark, rows, selection="area")[10] == "remote_not_selected"
    assert _verdicts(spark, rows, country="AT")[7] == inside and _verdicts(spark, rows, country="AT")[3] == out
    assert _verdicts(spark, [], country="DE") == {}


def test_states(spark):
    rows = [_row(1, [], state="Bayern"), _row(2, [], feed_state="Bayern"), _row(3, [("Hessen", None)], state="Bayern"), _row(4, [("Bayern", "DE")], state="Hessen"), _row(5, [], country="DE")]
    assert _verdicts(spark, rows, state="Bayern") == {1: "employer_in_state", 2: "employer_in_state", 3: "outside_area", 4: "work_location", 5: "outside_area"}


def test_distinct_postings(spark):
    rows = spark.createDataFrame([(1, "e", "f", True), (2, None, "e", True), (3, None, "e", True), (4, "e", "g", None), (5, None, None, True), (6, None, "h", False)], "job_id int, employer string, company string, is_active boolean")
    groups = spark.createDataFrame([(1, 1), (2, 1), (4, 4)], "job_id int, group int")
    assert [tuple(r) for r in analytics.distinct_postings(rows, groups).collect()] == [("e", 2)]
    assert analytics.distinct_postings(rows.limit(0), groups.limit(0)).count() == 0


def test_websites_fill_gaps_only(spark):
    old = spark.createDataFrame([("a", "https://a.de", "found"), ("b", None, None), ("c", "", "found")], "source_id string, website_url string, career_status string")
    new = spark.createDataFrame([(s, f"https://www.new{s}.de/x", "m") for s in "abd"], "source_id string, website_url string, method string")
    filled = imports.fill_websites(old, new)
    assert sorted(map(tuple, filled.collect()), key=str) == [("a", "https://a.de", "found", None), ("b", "https://www.newb.de/x", "not_checked", "m"), ("c", None, "found", None), ("d", "https://www.newd.de/x", "not_checked", "m")]
    results = spark.createDataFrame([("a", "https://other.de", "s"), ("b", "http://NEWB.de/jobs", "s"), ("c", None, "s"), ("z", "https://z.de", "s")], "source_id string, website string, status string")
    assert {r["source_id"]: r["accepted"] for r in imports.accepted_results(filled, results).collect()} == {"a": False, "b": True, "c": False, "z": False}
