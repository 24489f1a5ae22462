import datetime as dt

from pyspark.sql import functions as F

from vacantia.operators import dedupe, upserts
from vacantia.streaming import queues, windows


def test_snapshot_diff(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    cur = [(1, "a", "A", True, 0, None), (1, "b", "B", True, 1, None), (1, "c", "C", False, 3, dt.datetime(2023, 1, 1)), (2, "a", "A", True, 0, None)]
    current = spark.createDataFrame(cur, "feed_id int, external_id string, title string, is_active boolean, misses int, closed_at timestamp")
    incoming = spark.createDataFrame([(1, "a", "A2"), (1, "n", "N"), (2, "z", "Z")], "feed_id int, external_id string, title string")
    scans = spark.createDataFrame([(1, True), (2, False)], "feed_id int, complete boolean")
    got = {(r.feed_id, r.external_id): r for r in upserts.snapshot_diff(current, incoming, scans, now, fields=["title"]).collect()}
    assert (got[1, "a"].title, got[1, "a"].change) == ("A2", "updated") and got[1, "n"].change == "inserted"
    assert (got[1, "b"].is_active, got[1, "b"].misses, got[1, "b"].change) == (False, 2, "closed") and got[1, "b"].closed_at.year == 2024
    assert got[1, "c"].misses == 4 and got[1, "c"].closed_at.year == 2023
    assert got[2, "a"].is_active and got[2, "a"].misses == 0 and got[2, "a"].change == "kept"


def test_merge_and_employers(spark):
    m = "map<string,string>"
    cur = spark.createDataFrame([(1, "T", "short", False, {"a": "1"}), (2, "V", "kept", True, None)], f"k int, title string, description string, verified boolean, meta {m}")
    inc = spark.createDataFrame([(1, " ", "much longer", None, {"a": "", "b": "2"}), (2, "W", "a longer one", None, None), (3, "N", "new", None, None)], f"k int, title string, description string, verified boolean, meta {m}")
    got = {r.k: r for r in upserts.merge_fields(cur, inc, "k", ["title"], metadata="meta").collect()}
    assert (got[1].title, got[1].description, got[1].meta) == ("T", "much longer", {"a": "1", "b": "2"})
    assert (got[2].title, got[2].description) == ("W", "kept") and got[3].title == "N"
    emp = spark.createDataFrame([(1, "Acme", "acme.de", None), (2, "Foo", None, "BY")], "id long, name string, domain string, state string")
    new = spark.createDataFrame([("Acme Corp", "acme.de", "BE"), ("FOO", "foo.de", "XX"), ("Bar", None, None)], "name string, domain string, state string")
    rows = sorted((r.id or 0, r.name, r.domain, r.state) for r in upserts.upsert_employers(emp, new).collect())
    assert rows == [(0, "Bar", None, None), (1, "Acme", "acme.de", "BE"), (2, "Foo", "foo.de", "BY")]
    kept, gone = upserts.split_archive(emp, F.col("id") == 1)
    assert kept.count() == gone.count() == 1 and upserts.restore(kept, gone, ["id"]).count() == 2


def test_merge_postings(spark):
    rows = spark.createDataFrame([("k", 1, None, "aa"), ("k", 2, "Bonn", "aaaa"), ("k", 3, "Ulm", "bbbb"), ("m", 1, None, None)], "key string, page int, location string, description string")
    got = {r.key: (r.location, r.description) for r in dedupe.merge_postings(rows, "key", "page", ["location"]).collect()}
    assert got == {"k": ("Bonn", "aaaa"), "m": (None, None)}


def _drip(spark, path, frames):
    for k, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_dirty_queue_stream(spark, tmp_path):
    schema = "job long, revision long, title string"
    frames = [spark.createDataFrame(x, schema) for x in ([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], [(1, 2, "late"), (3, 1, "y")], [(2, 5, "z")])]
    table = queues.VersionedTable(spark, str(tmp_path / "state"), "job long, revision long, title string, n int")
    step = queues.apply_dirty(lambda d: d.withColumn("n", F.length("title")), "job", "revision")
    queues.maintain(_drip(spark, str(tmp_path), frames), table, step, str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 3, "c", 1), (2, 5, "z", 1), (3, 1, "y", 1)]
    twin = queues.coalesced(frames[0].union(frames[1]).union(frames[2]), "job", "revision")
    assert sorted((r.job, r.revision) for r in twin.collect()) == [(1, 3), (2, 5), (3, 1)]
    queues.maintain(spark.readStream.schema(frames[0].schema).parquet(str(tmp_path / "in")), table, step, str(tmp_path / "cp"))
    assert table.read().count() == 3


def test_scan_closure_stream(spark, tmp_path):
    schema = "feed_id int, scan int, complete boolean, external_id string"
    frames = [spark.createDataFrame(x, schema) for x in ([(1, 1, True, "a"), (1, 1, True, "b")], [(1, 2, True, "a"), (1, 3, False, None)], [(1, 4, True, "a"), (1, 5, True, "b"), (1, 5, True, "a")])]
    table = queues.VersionedTable(spark, str(tmp_path / "state"), "feed_id int, external_id string, is_active boolean, misses int, last_scan int")
    queues.maintain(_drip(spark, str(tmp_path), frames[:2]), table, queues.apply_scans(), str(tmp_path / "cp"))
    assert {r.external_id: (r.is_active, r.misses) for r in table.read().collect()} == {"a": (True, 0), "b": (False, 1)}
    queues.maintain(_drip(spark, str(tmp_path), frames[2:]), table, queues.apply_scans(), str(tmp_path / "cp"))
    assert {r.external_id: (r.is_active, r.misses) for r in table.read().collect()} == {"a": (True, 0), "b": (True, 0)}


def test_windows_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(minutes=37 * k), k % 5, "view" if k % 3 else "click", float(k)) for k in range(200)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    frames = [spark.createDataFrame(rows[k::4], schema) for k in range(4)]
    stream = _drip(spark, str(tmp_path), frames)
    out = windows.tumbling(stream, "1 day", late="30 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName("tumble").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("tumble")) == key(windows.tumbling(spark.createDataFrame(rows, schema), "1 day"))
    first = windows.first_per_key(stream, ["user_id"], "30 days").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    first.awaitTermination()
    assert spark.table("firsts").count() == 5


def test_debounce_claim_recover(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    req = spark.createDataFrame([("k", t(0)), ("k", t(1)), ("k", t(10)), ("m", t(0))], "key string, at timestamp")
    got = sorted((r.key, r.due_at, r.requests) for r in queues.debounced(req, "key", "at", 2).collect())
    assert got == [("k", t(3), 2), ("k", t(12), 1), ("m", t(2), 1)]
    now = F.lit(t(100)).cast("timestamp")
    tasks = spark.createDataFrame([(1, "running", 1, 2, t(50), t(0)), (2, "running", 1, 9, t(50), t(0)), (3, "queued", 5, 0, None, t(99)), (4, "queued", 9, 0, None, t(200)), (5, "running", 1, 0, t(150), t(0))], "id int, status string, priority int, attempts int, lease_until timestamp, next_at timestamp")
    assert [r.id for r in queues.claimable(tasks, now, limit=3).collect()] == [3, 1, 2]
    rec = {r.id: r for r in queues.recover(tasks, now, base_s=10, cap_s=60, most=5).collect()}
    assert (rec[1].status, rec[1].next_at) == ("queued", t(140)) and rec[2].status == "failed" and rec[5].status == "running"
