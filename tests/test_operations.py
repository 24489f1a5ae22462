import datetime as dt

from pyspark.sql import functions as F

from vacantia.operators import operations as O

TASK = "profile int, job int, source_hash string, version string, state string, attempts int, priority int, available_at timestamp"
OLD, NOW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def test_queue_keeps_attempts_and_resets_what_changed(spark):
    tasks = [(1, 1, "a", "v2", "running", 2, 7, OLD), (1, 2, "old", "v2", "failed", 2, 7, OLD), (1, 3, "c", "v1", "pending", 2, 7, OLD), (1, 4, "d", "v2", "done", 2, 7, OLD), (1, 5, "e", "v2", "excluded", 2, 7, OLD), (1, 6, "f", "v2", "running", 2, 7, OLD), (1, 9, "i", "v2", None, 2, 7, OLD)]
    selected = [(1, j, h, 4) for j, h in ((1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (7, "g"), (9, "i"))]
    stored = [(1, 4, "d", "v1"), (1, 5, "e", "v2"), (1, 5, "e", "v2"), (1, 7, "x", "v2"), (1, 2, "b", "v2")]
    got = O.reconcile_queue(
        spark.createDataFrame(tasks, TASK), spark.createDataFrame([(1, j) for j in range(1, 9)], "profile int, job int"), spark.createDataFrame(selected, "profile int, job int, source_hash string, priority int"),
        spark.createDataFrame(stored, "profile int, job int, source_hash string, version string"), version="v2", now=F.lit(NOW),
    )
    rows = {r["job"]: (r["state"], r["attempts"], r["source_hash"], r["priority"], r["available_at"]) for r in got.collect()}
    assert len(rows) == got.count() == 9
    assert rows[1] == ("running", 2, "a", 4, OLD)  # under way on the same text
    assert rows[2] == ("done", 0, "b", 4, NOW) and rows[3][:2] == ("pending", 0)  # another text, another version
    assert rows[4][:2] == ("pending", 0) and rows[5][:2] == ("done", 0)  # its assessment is of another version; selected again
    assert rows[6] == ("excluded", 2, "f", 7, OLD) and rows[8] == ("excluded", 0, "", 0, None)  # no longer, never selected
    assert rows[7][:3] == ("pending", 0, "g") and rows[9][:2] == ("pending", 0)
    empty = [spark.createDataFrame([], s) for s in (TASK, "profile int, job int", "profile int, job int, source_hash string, priority int", "profile int, job int, source_hash string, version string")]
    assert O.reconcile_queue(*empty, version="v2", now=F.lit(NOW)).count() == 0


def test_comparison_needs_every_measure(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "case string, kind string, fit double, checks double")
    base, new = rows(("a", "cv", 5.0, 5.0), ("a", "letter", 5.0, 5.0), ("b", "cv", 5.0, None), ("c", "cv", 1.0, 1.0)), rows(("a", "cv", 5.0, 6.0), ("a", "letter", 6.0, 4.0), ("b", "cv", 9.0, 9.0), ("d", "cv", 9.0, 9.0))
    got = {(r["case"], r["kind"]): r["passed"] for r in O.compare_scores(base, new, ["case", "kind"], ["fit", "checks"]).collect()}
    assert got == {("a", "cv"): True, ("a", "letter"): False, ("b", "cv"): False, ("c", "cv"): False}
    assert sorted(tuple(r) for r in O.missing_documents(base, new, "case", "kind", ["cv", "letter"]).collect()) == [("b", "letter"), ("c", "cv"), ("c", "letter")]


def test_cohort_guards(spark):
    cohort = spark.createDataFrame([(0,), (1,), (2,)], "index int")
    runs = [("whole", 0), ("whole", 1), ("whole", 2), ("short", 0), ("short", 1), ("twice", 0), ("twice", 1), ("twice", 1), ("stranger", 0), ("stranger", 1), ("stranger", 5)]
    rows = spark.createDataFrame([(v, i, "found" if i else None, i, 2) for v, i in runs], "variant string, index int, status string, job_rows int, pages int")
    got = {r["variant"]: r for r in O.cohort_summary(rows, cohort).collect()}
    assert {k: r["complete"] for k, r in got.items()} == {"whole": True, "short": False, "twice": False, "stranger": False}
    assert (got["whole"]["statuses"], got["whole"]["companies_with_jobs"], got["whole"]["job_rows"], got["whole"]["pages"]) == ('{"":1,"found":2}', 2, 3, 6)


def test_failures_fields_and_campaigns(spark):
    one = lambda *cs: list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cs)]).first())
    null = F.lit(None).cast("string")
    fail = lambda s, h: O.failure_class(null if s is None else F.lit(s), F.lit(h).cast("int"))
    assert one(fail("ok", 403), fail("bot_challenge", 403), fail("x", 401), fail(None, 429), fail("browser_unavailable", 200), fail(None, None)) == [None, "bot_challenge", "blocked", "throttled", "unsupported", "failed"]
    yes, no = F.lit(True), F.lit(False)
    field = lambda *a: O.field_outcome(*a)
    a, b = F.lit("a"), F.lit("b")
    got = one(field(yes, no, yes, a, b, yes), field(no, yes, yes, null, null, no), field(no, yes, yes, a, null, no), field(yes, yes, no, a, a, yes), field(yes, yes, no, a, b, yes), field(yes, yes, yes, a, a, yes), field(yes, yes, yes, a, a, no), field(yes, yes, yes, a, b, F.lit(None).cast("boolean")))
    assert got == ["unrendered", "preserved", "wrong", "not_visible", "wrong", "filled", "missed", "wrong"]
    run = lambda *n: O.campaign_status(*map(F.lit, n))
    assert one(run(3, 1, 1), run(3, 0, 3), run(3, 2, 1), run(3, 3, 0), run(0, 0, 0)) == ["running", "failed", "partial", "completed", "completed"]
    assert one(O.client_part(F.lit("scheduled"), yes), O.client_part(F.lit("scheduled"), F.lit(None).cast("boolean")), O.client_part(F.lit("failed"), no), O.client_part(null, no)) == ["current", "scheduled", "recent", None]
