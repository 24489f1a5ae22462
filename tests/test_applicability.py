import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia.functions import requirements
from vacantia.operators import applicability as A
from vacantia.operators import profiles

AS_OF = "2024-01-01"
PROFILE = "profile_id int, city string, country string, relocates boolean, authorised_in string, authorised boolean, sponsorship boolean, experience_years double"
PEOPLE = [(1, "Bonn", "Germany", False, "Germany", True, False, 6.0), (2, "Paris", "France", False, "France", True, False, 2.0), (3, None, None, None, None, None, None, None), (4, "Paris", "France", True, "Germany", False, False, 9.0)]
TEXTS = [
    (1, "Your profile:\nA valid driving licence is required."), (2, "Your profile:\nWork permit for Germany required."), (3, "You must live in Bonn."), (4, "Your profile:\nThree years of experience in payroll."), (5, "Your profile:\nAt least 5 years of experience."),
    (6, "Your profile:\nA driving licence or a forklift licence is required."), (7, "Your profile:\nA driving licence is preferred and a work permit is not required."), (8, "Nice to have:\nA driving licence.\nWe offer:\nA work permit for Germany."), (9, ""), (10, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.createDataFrame(PEOPLE, PROFILE)
    jobs = spark.createDataFrame(TEXTS, "job_id int, description string")
    day = lambda y, m=1: dt.date(y, m, 1)
    credentials = spark.createDataFrame([(1, "Driving licence", None), (2, "Forklift licence", day(2030)), (4, "Driving licence", day(2020)), (3, None, None)], "profile_id int, name string, valid_to date")
    tenures = spark.createDataFrame([(1, "payroll", day(2019), day(2021), "professional"), (1, "payroll", day(2020), day(2021, 6), "professional"), (1, "sales", day(2010), day(2015), "professional"), (4, "Payroll", day(2021), None, "professional"), (2, "payroll", day(2015), day(2023), "academic"), (3, "payroll", None, day(2020), "professional")], "profile_id int, topic string, start date, end date, kind string")
    pairs = jobs.select("job_id").crossJoin(people.select("profile_id"))
    return pairs, A.job_conditions(jobs), people, credentials, tenures


def test_conditions_of_postings(tables):
    rows = [(r.job_id, r.kind, r.minimum_years, r.scope) for r in tables[1].orderBy("job_id", "condition").collect()]
    assert rows == [(1, "licence", None, None), (2, "authorisation", None, None), (3, "residence", None, None), (4, "tenure", 3.0, "payroll"), (5, "tenure", 5.0, None), (6, "licence", None, None), (6, "licence", None, None)]


def test_gates(tables):
    pairs = tables[0]
    rows = A.condition_rows(*tables, F.lit(AS_OF).cast("date"))
    got = {(r.job_id, r.profile_id): (r.eligibility, r.location) for r in A.gates(pairs, rows).collect()}
    p, u, f = "pass", "unknown", "fail"
    want = {1: (p, u, u, u), 2: (p, u, u, f), 4: (u, f, u, p), 5: (p, f, u, p), 6: (p, p, u, u), 7: (p,) * 4, 8: (p,) * 4, 9: (p,) * 4, 10: (p,) * 4}
    for job, row in want.items():
        assert tuple(got[job, k][0] for k in (1, 2, 3, 4)) == row, job
    assert tuple(got[3, k][1] for k in (1, 2, 3, 4)) == (p, f, u, u)
    assert all(r.evidence_quote is None for r in rows.filter("status = 'unknown'").collect())


def test_overlapping_spans_count_once(spark):
    d = lambda m: dt.date(2020 + m // 12, m % 12 + 1, 1)
    spans = spark.createDataFrame([(1, d(0), d(12)), (1, d(3), d(6)), (1, d(6), d(18)), (1, d(24), d(30)), (1, d(5), d(2)), (1, None, d(1)), (2, d(0), d(6)), (2, d(0), d(6))], "k int, start date, end date")
    got = {r.k: round(r.years, 1) for r in A.tenure_years(spans, ["k"]).collect()}
    assert got == {1: 2.0, 2: 0.5}


def test_reconciliation_needs_grounded_evidence(spark, tables):
    rows = A.condition_rows(*tables, F.lit(AS_OF).cast("date"))
    schema = "job_id int, profile_id int, category string, priority string, status string, job_quote string, evidence_source string, evidence_quote string"
    q = "A valid driving  licence is required."
    told = [(1, 2, "credential", "required", "supported", q, "cv", "I hold a driving licence"), (1, 3, "credential", "required", "supported", q, "cv", "driving licence since 2001"), (1, 4, "credential", "preferred", "supported", q, "cv", "driving licence"), (3, 2, "residence", None, "supported", "You must live in Bonn.", "cv", "moving to Bonn")]
    sources = spark.createDataFrame([(2, "cv", "Indeed I hold a\n driving licence."), (3, "cv", "No such words"), (4, "cv", "driving licence"), (2, "cv", "moving to Bonn")], "profile_id int, source string, text string")
    out = A.reconcile(rows, spark.createDataFrame(told, schema), sources)
    assert out.columns == rows.columns and out.count() == rows.count()
    got = {(r.job_id, r.profile_id): (r.status, r.evidence_quote) for r in out.filter("job_id in (1, 3)").collect()}
    assert got[1, 2] == ("pass", "I hold a driving licence") and got[1, 3][0] == got[1, 4][0] == "unknown" and got[3, 2][0] == "fail"


def test_empty(spark, tables):
    _, conditions, people, credentials, tenures = tables
    none = spark.createDataFrame([], "job_id int, profile_id int")
    assert A.gates(none, A.condition_rows(none, conditions, people, credentials, tenures, F.lit(AS_OF).cast("date"))).collect() == []


def test_gates_decide_in_the_composite_match(spark):
    """A failed group is a conflict, an open one a review, and tenure limits the score; a pair without rows meets everything; alternatives count by their best."""
    text = "Your profile:\nPython and SQL.\n" + "We offer:\n" + "A bright place near the station. " * 8
    jobs = requirements.enrich_distinct(spark.createDataFrame([(k, "Data Analyst", text) for k in range(5)], "job_id int, title string, description string"))
    people = spark.createDataFrame([(1, '{"skills": ["Python", "SQL"], "desired_roles": ["data analyst"]}')], "profile_id int, profile string")
    rows = [(0, "a", "g", "eligibility", "tenure", "4 years", "fail"), (1, "a", "g", "eligibility", "tenure", "4 years", "unknown"), (2, "a", "g", "location", "residence", "reside in Bonn", "unknown"), (3, "a", "g", "eligibility", "licence", "a licence", "fail"), (3, "b", "g", "eligibility", "licence", "a permit", "pass")]
    asked = spark.createDataFrame([(j, 1, *r) for j, *r in rows], "job_id int, profile_id int, condition string, group string, gate string, kind string, quote string, status string")
    got = {r["job_id"]: r for r in profiles.match(jobs.select("job_id", "title", "enriched"), people, asked).collect()}
    plain = {r["job_id"]: r for r in profiles.match(jobs.select("job_id", "title", "enriched"), people).collect()}
    assert [got[k]["score"] for k in range(5)] == [29, 59, *[plain[4]["score"]] * 3] and plain[0]["score"] > 59
    assert [got[k]["eligible"] for k in range(5)] == [False, True, True, True, True]
    assert [got[k]["mandatory_review"] for k in range(5)] == [True, True, True, False, False]
    assert [got[k]["tier"] for k in range(3)] == ["unlikely"] * 3 and got[3]["tier"] == got[4]["tier"] == plain[4]["tier"]
    assert (got[0]["conflicts"], got[2]["unknowns"], got[2]["location_gate"]) == (["Condition not met: 4 years"], ["Verify condition: reside in Bonn"], "unknown")
    assert profiles.match(jobs.select("job_id", "title", "enriched"), people, asked.limit(0)).count() == 5


def test_equal_texts_are_read_once(spark):
    jobs = spark.createDataFrame([(i, f"A driving licence is needed.{' ' * (i % 2)}") for i in range(40)], "job_id long, description string")
    rows = A.job_conditions(jobs)
    assert sorted(r.job_id for r in rows.collect()) == list(range(40))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("__rows") > 0 and "__value" in plan
