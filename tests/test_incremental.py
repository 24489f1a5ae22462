import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from vacantia.functions import vectors
from vacantia.operators import indexing, relational, reports, sections
from vacantia.sources import fetches


def test_reports_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b",\nc', [1, 2]), (2, None, None)], "id int, t string, a array<int>")
    reports.write_report(df, f"{tmp_path}/c")
    assert sorted(map(tuple, reports.read_report(spark, f"{tmp_path}/c", "id int, t string, a string").collect())) == [(1, 'a "b",\nc', "[1,2]"), (2, None, None)]
    reports.write_report(df, f"{tmp_path}/j", "json")
    assert sorted(map(tuple, reports.read_report(spark, f"{tmp_path}/j", df.schema, "json").collect())) == [(1, 'a "b",\nc', [1, 2]), (2, None, None)]
    with pytest.raises(ValueError):
        reports.write_report(df, f"{tmp_path}/x", "xml")


def test_files_against_a_manifest(spark, tmp_path):
    for name, body in (("a.txt", b"one"), ("sub/b.txt", b"two"), ("c.txt", b"3"), ("e.txt", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a.txt", sha(b"one").upper()), ("sub/b.txt", sha(b"other")), ("d.txt", sha(b"")), ("e.txt", sha(b""))], "file string, sha256 string")
    got = dict(map(tuple, reports.verify(manifest, reports.digests(spark, str(tmp_path))).collect()))
    assert got == {"a.txt": "ok", "sub/b.txt": "mismatch", "d.txt": "missing", "e.txt": "missing", "c.txt": "unlisted"}


def test_inventory_runs_to_its_mark_and_stops(spark):
    rows = spark.createDataFrame([(k,) for k in range(1, 8)], "id int")
    owners = spark.createDataFrame([("a", "v"), ("b", "v")], "owner string, version string")
    progress = spark.createDataFrame([], "owner string, version string, cursor bigint, high_water bigint, advanced_at timestamp")
    pages = []
    for step in range(8):
        page, progress = indexing.inventory_page(rows, owners, progress, F.lit(dt.datetime(2024, 1, 1, step)).cast("timestamp"), key="id", size=3)
        pages.append([tuple(r) for r in page.collect()])
        progress = spark.createDataFrame(progress.collect(), progress.schema)
    assert [p[0][0] for p in pages[:6]] == ["a", "b"] * 3 and [[k for _, k in p] for p in pages[::2][:3]] == [[1, 2, 3], [4, 5, 6], [7]]
    assert pages[6:] == [[], []] and {r.cursor for r in progress.collect()} == {7}
    none, _ = indexing.inventory_page(rows.limit(0), owners, progress.limit(0), F.current_timestamp(), key="id")
    assert none.count() == 0


def test_relative_locations_and_edges(spark):
    cases = [("http://a/b/c?x#y", "d", "http://a/b/d"), ("http://a", "d", "http://a/d"), ("http://a/b", "/d", "http://a/d"), ("https://a/b", "//e/f", "https://e/f"), ("http://a/b?q", "?z", "http://a/b?z"), ("http://a/", "mailto:x", "mailto:x")]
    df = spark.createDataFrame(cases, "b string, l string, want string")
    assert df.filter(fetches.resolved(F.col("b"), F.col("l")) != F.col("want")).count() == 0
    responses = spark.createDataFrame([("u", 302, "u", None), ("v", 301, "", False), ("w", None, None, None)], "url string, status int, location string, challenge boolean")
    got = {r.url: (r.state, r.final_url, r.n_read) for r in fetches.outcomes(spark.createDataFrame([("http://x/u",), ("v",), ("w",), (None,), ("v",)], "url string"), responses.withColumn("url", F.when(F.col("url") == "u", "http://x/u").otherwise(F.col("url")))).collect()}
    assert got == {"http://x/u": ("redirect_limit", None, 6), "v": ("fetched", "v", 1), "w": ("fetched", "w", 1)}


def test_pool_of_nothing_is_null(spark):
    df = spark.createDataFrame([([[3.0, 4.0], [9.0, 9.0]], [1, 0]), ([[1.0, 1.0]], [0]), ([], []), (None, None)], "s array<array<double>>, m array<int>")
    assert [r.v for r in df.select(vectors.masked_mean_pool(F.col("s"), F.col("m")).alias("v")).collect()] == [[0.6, 0.8], None, None, None]


def test_sections_take_turns_and_cut_long_words(spark):
    words = " ".join(f"w{k:03d}" for k in range(40))
    rows = [(1, "a", 0, "neutral", 0, words), (1, "b", 1, "neutral", 0, "x" * 25), (1, "b", 1, "neutral", 1, "x" * 25)]
    s = spark.createDataFrame(rows, "id int, source string, source_rank int, scope string, place int, sentence string")
    got = [(r.n, r.source, r.text) for r in sections.bounded(s, id_col="id", limit=5, chunk=20).orderBy("n").collect()]
    assert got == [(1, "a", "w000 w001 w002 w003"), (2, "b", "x" * 20), (3, "a", "w036 w037 w038 w039"), (4, "b", "x" * 5), (5, "a", "w004 w005 w006 w007")]
    assert sections.bounded(s.limit(0), id_col="id", limit=5).count() == 0


def test_profile_begins_with_its_skills(spark):
    texts = spark.createDataFrame([(1, "cv", 0, "Built data pipelines in Spark.")], "id int, source string, source_rank int, text string")
    skills = spark.createDataFrame([(1, ["SQL", "Go"]), (2, [])], "id int, skills array<string>")
    got = [(r.id, r.n, r.scope, r.text) for r in sections.profile_sections(texts, skills, id_col="id").orderBy("n").collect()]
    assert got == [(1, 1, "capabilities", "Skills: SQL, Go"), (1, 2, "experience", "Built data pipelines in Spark.")]


def test_a_query_set_in_blocks_meets_every_row(spark):
    rows, asked = spark.range(7).withColumnRenamed("id", "r"), spark.range(9).withColumnRenamed("id", "q")
    want = sorted((r, q) for r in range(7) for q in range(9))
    assert all(sorted(map(tuple, relational.against_all(rows, asked, most=n).collect())) == want for n in (2, 100))
    assert relational.against_all(rows, asked.limit(0)).count() == 0
