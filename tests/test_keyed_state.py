import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vacantia.streaming import keyed, queues

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of every micro-batch starts a Python worker."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def drip(spark, path, frames):
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def requests(spark):
    rng = random.Random(3)
    rows = [(rng.choice(("a", "b", "c")), T0 + dt.timedelta(seconds=rng.randrange(0, 400) / 4)) for _ in range(120)] + [(None, T0), ("a", None)]
    rows += [("hot", T0 + dt.timedelta(seconds=k)) for k in range(100)]  # steady requests
    rows.sort(key=lambda r: (r[1] or T0))
    frames = [rows[k : k + 40] for k in range(0, len(rows), 40)]
    for f in frames:
        rng.shuffle(f)
    frames.append([("flush", T0 + dt.timedelta(days=1))])
    frames.append([("flush", T0 + dt.timedelta(days=2))])
    return rows, [spark.createDataFrame(f, "k string, at timestamp") for f in frames]


def brute(rows, wait, restart):
    out = []
    for key in {r[0] for r in rows} - {None}:
        group = []
        for at in sorted(r[1] for r in rows if r[0] == key and r[1]):
            if group and at < (group[-1] if restart else group[0]) + dt.timedelta(seconds=wait):
                group.append(at)
            else:
                if group:
                    out.append((key, group[0], (group[-1] if restart else group[0]) + dt.timedelta(seconds=wait), len(group)))
                group = [at]
        out.append((key, group[0], (group[-1] if restart else group[0]) + dt.timedelta(seconds=wait), len(group)))
    return sorted(out)


def test_debounced_refresh_in_several_batches(spark, tmp_path):
    rows, frames = requests(spark)
    for restart in (False, True):
        path = tmp_path / str(restart)
        stream = keyed.debounced_stream(drip(spark, str(path), frames), "k", "at", 2, late="5 seconds", restart=restart)
        query = keyed.emit(stream, str(path / "out"), str(path / "cp"))
        got = keyed.emitted(spark, str(path / "out"), "k string, first_at timestamp, due_at timestamp, requests bigint").filter("k <> 'flush'")
        assert sorted(tuple(r)[:4] for r in got.collect()) == brute(rows, 2, restart)
        assert len({r.batch for r in got.select("batch").distinct().collect()}) > 1 and query.lastProgress is not None
    batch = keyed.debounced_from_first(spark.createDataFrame(rows, "k string, at timestamp"), "k", "at", 2)
    assert sorted(map(tuple, batch.collect())) == brute(rows, 2, False)


def scans(spark, seed=1):
    rng = random.Random(seed)
    frames = []
    for scan in range(5):
        rows = []
        for feed in (1, 2):
            complete = (scan + feed) % 3 != 0
            rows += [(feed, scan, complete, i) for i in rng.sample(range(30), rng.randrange(0, 25))] + [(feed, scan, complete, None)]
        frames.append(spark.createDataFrame(rows, "feed_id long, scan long, complete boolean, external_id long"))
    return frames


def state(spark, path, total):
    schema = "feed_id bigint, external_id bigint, is_active boolean, seen_scan bigint, complete_before bigint, closed_scan bigint, revision bigint"
    now = keyed.latest(keyed.emitted(spark, path, schema), "feed_id", "external_id")
    return now.join(total, "feed_id").withColumn("misses", F.col("whole") - F.col("complete_before"))


def test_closures_in_several_batches_equal_the_batch(spark, tmp_path):
    frames = scans(spark)
    both = frames[0]
    for f in frames[1:]:
        both = both.union(f)
    total = both.filter("complete").groupBy("feed_id").agg(F.countDistinct("scan").alias("whole"))
    stream = keyed.closures_stream(drip(spark, str(tmp_path), frames), parts=3)
    query = keyed.emit(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = state(spark, str(tmp_path / "out"), total)
    want = queues.apply_scans()(spark.createDataFrame([], "feed_id bigint, external_id bigint, is_active boolean, misses int, last_scan bigint"), both)
    assert {tuple(r) for r in got.select("feed_id", "external_id", "is_active", "misses").collect()} == {tuple(r) for r in want.select("feed_id", "external_id", "is_active", "misses").collect()}
    first_miss = {}
    listed = {}
    for r in both.orderBy("scan").collect():
        listed.setdefault((r.feed_id, r.scan, r.complete), set()).add(r.external_id)
    for (feed, scan, complete), ids in sorted(listed.items()):
        for i in ids - {None}:
            first_miss[feed, i] = None
        for f, i in [k for k in first_miss if k[0] == feed and k[1] not in ids and complete and first_miss[k] is None]:
            first_miss[f, i] = scan
    assert {(r.feed_id, r.external_id): r.closed_scan for r in got.collect()} == first_miss
    # Work is in proportion to the batch: a batch that lists one posting changes no other's state unless it closes it.
    assert len(query.recentProgress) > 3


def test_state_work_is_that_of_the_batch(spark, tmp_path):
    big = spark.range(600).selectExpr("1L feed_id", "0L scan", "false complete", "id external_id").union(spark.sql("select 1L, 0L, false, cast(null as bigint)"))
    small = spark.sql("select 1L feed_id, 1L scan, false complete, 7L external_id union all select 1L, 1L, false, null")
    query = keyed.emit(keyed.closures_stream(drip(spark, str(tmp_path), [big, small]), parts=4), str(tmp_path / "out"), str(tmp_path / "cp"))
    changed = {r.batch: r["count"] for r in keyed.emitted(spark, str(tmp_path / "out"), "feed_id bigint, external_id bigint").groupBy("batch").count().collect()}
    assert changed == {0: 600, 1: 1}
    updates = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.numInputRows]
    assert updates[0] > 600 and updates[-1] < 20


def test_closed_postings_are_forgotten(spark, tmp_path):
    frames = [spark.createDataFrame(r, "feed_id long, scan long, complete boolean, external_id long") for r in ([(1, 0, True, 5), (1, 0, True, None)], [(1, 1, True, None)], [(1, 1, True, 5), (1, 2, False, 5), (1, 2, False, None)])]
    for f in frames:
        stream = keyed.closures_stream(drip(spark, str(tmp_path), [f]), parts=1, keep_closed=3600)
        keyed.emit(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    rows = keyed.emitted(spark, str(tmp_path / "out"), "feed_id bigint, external_id bigint, is_active boolean, seen_scan bigint, closed_scan bigint").orderBy("batch").collect()
    assert [(r.is_active, r.seen_scan, r.closed_scan) for r in rows] == [(True, 0, None), (False, 0, 1), (True, 2, None)]


def test_newest_revisions_are_handed_on_once(spark, tmp_path):
    frames = [spark.createDataFrame(r, "id string, rev long, body string") for r in ([("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z"), (None, 1, "n")], [("a", 2, "old"), ("b", 1, "z")], [("a", 4, "new"), ("b", None, "q")])]
    keyed.emit(keyed.newest_stream(drip(spark, str(tmp_path), frames), "id", "rev"), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = keyed.emitted(spark, str(tmp_path / "out"), "id string, rev bigint, body string").collect()
    assert sorted((r.batch, r.id, r.rev, r.body) for r in rows) == [(0, "a", 3, "y"), (0, "b", 1, "z"), (2, "a", 4, "new")]


def test_debounce_reads_and_writes_a_keys_requests_once_a_call():
    import pandas as pd

    calls = []

    class Pending:
        rows: list = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = rows

    class Handle:
        def getListState(self, name, schema):  # noqa: N802
            return Pending()

        def registerTimer(self, at):  # noqa: N802
            calls.append(at)

        def deleteTimer(self, at):  # noqa: N802
            calls.append(-at)

    step = keyed._Debounce("k", 2_000, False)
    step.init(Handle())
    list(step.handleInputRows(("a",), iter([pd.DataFrame({"at_us": [i * 1_000_000 for i in range(5, 500)]})] * 2), None))
    list(step.handleInputRows(("a",), iter([pd.DataFrame({"at_us": [4_000_000]})]), None))
    assert calls == ["put", 7_001, "get", "put", -7_001, 6_001] and step.pending.rows[:2] == [(4_000_000, 1), (5_000_000, 2)]
