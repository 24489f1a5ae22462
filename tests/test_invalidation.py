import csv
import io
import zipfile

from pyspark.sql import functions as F

from vacantia.operators import invalidation as I
from vacantia.sources.archives import read_members


def test_a_changed_row_drops_exactly_what_hangs_on_it(spark):
    cols = ["title", "body"]
    before = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z"), (4, "d", "q")], "id int, title string, body string")
    after = spark.createDataFrame([(1, "a", "x"), (2, "b", ""), (4, "d2", "q"), (5, "new", "n")], "id int, title string, body string")
    jobs = I.changed(before, after, "id", cols)
    assert {(r.id, r.hash is None) for r in jobs.collect()} == {(2, False), (3, True), (4, False)}
    people = I.changed(spark.createDataFrame([(1, "p"), (2, "q")], "id int, t string"), spark.createDataFrame([(1, "p"), (2, "other")], "id int, t string"), "id", ["t"])
    now = {r.id: r.h for r in after.select("id", I.content_hash(*cols).alias("h")).collect()}
    vectors = spark.createDataFrame([("job", 1, now[1]), ("job", 2, "old"), ("job", 3, "old"), ("job", 4, now[4]), ("job", 4, "old"), ("profile", 1, "p"), ("profile", 2, "q")], "kind string, id int, source_hash string")
    assessments = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 4), (4, 1)], "profile_id int, job_id int")
    out = I.cascade(jobs, people, vectors, assessments)
    assert {tuple(r) for r in out.vectors.collect()} == {("job", 1, now[1]), ("job", 4, now[4]), ("profile", 1, "p")}
    assert {tuple(r) for r in out.assessments.collect()} == {(1, 1), (4, 1)}
    assert {r.profile_id for r in out.reset.collect()} == {1, 2, 3} and {r.profile_id for r in out.profiles.collect()} == {2}


def test_vectors_meet_their_owners_in_one_join(spark):
    """Three joins in a row held the sorted rows of all of them in one task; an owner that is named twice made its vectors two."""
    jobs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "id int, hash string")
    none = spark.createDataFrame([], "id int, hash string")
    vectors = spark.createDataFrame([("job", 1, "a"), ("job", 2, "b"), ("job", 3, None), ("job", 4, None)], "kind string, id int, source_hash string")
    out = I.cascade(jobs, none, vectors, spark.createDataFrame([], "profile_id int, job_id int")).vectors
    assert sorted(tuple(r)[:2] for r in out.collect()) == [("job", 1), ("job", 4)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_results_of_an_old_generation_are_not_served(spark, tmp_path):
    store, made = I.Snapshots(spark, str(tmp_path / "s")), []

    def result():
        made.append(len(made))
        return spark.range(len(made))

    assert store.get({"a": 1, "b": "é"}, result).count() == 1 and store.get({"b": "é", "a": 1}, result).count() == 1 and len(made) == 1
    assert store.get({"a": 2}, result).count() == 2
    assert store.advance() == 1 and store.get({"a": 1, "b": "é"}, result).count() == 3
    assert store.advance() == 2 and I.Snapshots(spark, str(tmp_path / "s")).generation() == 2


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "."), body)
    return out.getvalue()


def test_tables_in_archives(spark, tmp_path):
    body = io.StringIO()
    csv.writer(body, delimiter=";").writerows([["Results of a vote"], [], ["as of; today"], ["Area", "Name", "Votes", "Votes"], ["1", "A;b", "5", "6"], [], ["2", 'say "x"'], ["3", "c", "7", "8", "extra"]])
    (tmp_path / "one.zip").write_bytes(packed(readme__txt=b"Area;x\n1;2", data__csv=("﻿" + body.getvalue()).encode(), other__csv=b"no header\n1;2\n", big__csv=("pre\n" + "Area;n\n" + "".join(f"{k};{k}\n" for k in range(9000))).encode()))
    (tmp_path / "not.zip").write_bytes(b"plain")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = read_members(files, member=".csv", first="Area").collect()
    assert [(r.row, r.cells) for r in rows if r.member == "data.csv"] == [(0, {"Area": "1", "Name": "A;b", "Votes": "5"}), (1, {"Area": "2", "Name": 'say "x"'}), (2, {"Area": "3", "Name": "c", "Votes": "7"})]
    assert [r.row for r in rows if r.member == "big.csv"] == list(range(9000)) and {r.member for r in rows} == {"data.csv", "big.csv"}
    assert read_members(files.withColumn("content", F.lit(None).cast("binary")), member=".csv", first="Area").count() == 0
