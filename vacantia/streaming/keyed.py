"""Keyed state with timers: debounced refreshes, closures of postings, and newest revisions.

Each processor keeps its state by key in the state store, so a micro-batch reads and writes the keys of its rows and of
expired timers, not the whole table.  Results are appended as changes (``emit``); the newest change of a key is its state.
State lies below the query's checkpoint location and survives lost executors with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a feed's postings that hold state of their own, so that no feed is bound to one task.
PARTS = 64


class _Debounce(StatefulProcessor):
    """Pending requests by time; a timer fires once the watermark says that no request can join the first ones any more.

    The pending requests of a key are read and written whole, once a call: single entries would cost a message each.
    """

    def __init__(self, key_field: str, wait_ms: int, restart: bool):
        self.key_field, self.wait_ms, self.restart = key_field, wait_ms, restart

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, n long")

    def _read(self) -> np.ndarray:
        """The pending (time, requests) as rows; times differ and ascend."""
        rows = list(self.pending.get()) if self.pending.exists() else []
        return np.array([(r[0], r[1]) for r in rows], dtype=np.int64).reshape(-1, 2)

    def _write(self, rows: np.ndarray, old: int | None) -> None:
        """Store ``rows``; ``old`` is the time of the timer that is set, if any."""
        if len(rows):
            self.pending.put([(int(a), int(n)) for a, n in rows])
        else:
            self.pending.clear()
        new = self._due(rows) if len(rows) else None
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)

    def _end(self, at: np.ndarray) -> int:
        """How many of the pending times the first refresh takes."""
        wait = self.wait_ms * 1000
        if not self.restart:
            return int(np.searchsorted(at, at[0] + wait))
        gaps = np.flatnonzero(np.diff(at) >= wait)
        return int(gaps[0]) + 1 if len(gaps) else len(at)

    def _due(self, rows: np.ndarray) -> int:
        at = rows[:, 0]
        return int(at[self._end(at) - 1] if self.restart else at[0]) // 1000 + self.wait_ms + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self._read()
        new = np.concatenate([f["at_us"].to_numpy(dtype=np.int64) for f in rows])
        at, place = np.unique(np.concatenate([old[:, 0], new]), return_inverse=True)
        n = np.zeros(len(at), dtype=np.int64)
        np.add.at(n, place, np.concatenate([old[:, 1], np.ones(len(new), dtype=np.int64)]))
        self._write(np.stack([at, n], axis=1), self._due(old) if len(old) else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows, start, done = self._read(), 0, []
        while start < len(rows):
            end = start + self._end(rows[start:, 0])
            due = int(rows[end - 1 if self.restart else start, 0]) + self.wait_ms * 1000
            if due // 1000 >= now:
                break
            done.append((key[0], int(rows[start, 0]), due, int(rows[start:end, 1].sum())))
            start = end
        self._write(rows[start:], None)  # the timer that fired is gone
        if done:
            yield pd.DataFrame(done, columns=[self.key_field, "first_us", "due_us", "requests"])

    def close(self) -> None:
        pass


def debounced_stream(requests: DataFrame, key: str, at: str, wait_s: int, *, late: str = "0 seconds", restart: bool = False) -> DataFrame:
    """(key, first_at, due_at, requests): refreshes to run, from a stream of requests in event time.

    Requests of a key that come less than ``wait_s`` after the first one join it, so steady requests cannot put a refresh off for
    ever; with ``restart`` each request starts the wait anew.  Requests older than the watermark (``late``) are dropped by it;
    requests without key or time make no refresh.
    """
    kind = requests.schema[key].dataType.simpleString()
    rows = requests.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    out = rows.groupBy("k").transformWithStateInPandas(_Debounce(key, wait_s * 1000, restart), f"{key} {kind}, first_us bigint, due_us bigint, requests bigint", "Append", "EventTime")
    return out.select(key, F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("due_us").alias("due_at"), "requests")


def debounced_from_first(requests: DataFrame, key: str, at: str, wait_s: int) -> DataFrame:
    """The batch twin of ``debounced_stream`` without ``restart``: chains are walked per key over distinct times.

    Where a request opens a refresh depends on the one before, so the walk is a fold over a key's sorted times within
    sessions (gaps under ``wait_s``), never over a key's whole history.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("us")
    rows = requests.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, F.unix_micros(F.col(at).cast("timestamp")).alias("us")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("new", (F.coalesce(F.col("us") - F.lag("us").over(order), F.lit(wait_s * 1_000_000)) >= wait_s * 1_000_000).cast("int"))
    sessions = rows.withColumn("session", F.sum("new").over(order)).groupBy(key, "session").agg(F.array_sort(F.collect_list(F.struct("us", "n"))).alias("times"))
    folded = F.expr(
        f"aggregate(times, cast(array() as array<struct<us:bigint,n:bigint>>), (a, x) -> case when size(a) > 0 and x.us < a[size(a) - 1].us + {wait_s * 1_000_000}L "
        "then concat(slice(a, 1, size(a) - 1), array(named_struct('us', a[size(a) - 1].us, 'n', a[size(a) - 1].n + x.n))) else concat(a, array(x)) end)"
    )
    out = sessions.select(key, F.explode(folded).alias("r"))
    return out.select(key, F.timestamp_micros("r.us").alias("first_at"), F.timestamp_micros(F.col("r.us") + wait_s * 1_000_000).alias("due_at"), F.col("r.n").alias("requests"))


class _Closures(StatefulProcessor):
    """A part of a feed: open postings, closed ones (forgotten after a while), and how many complete scans there were."""

    def __init__(self, fields: tuple[str, str], keep_closed_ms: int | None):
        self.fields, self.keep_closed_ms = fields, keep_closed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = "scan long, complete_before long"
        self.scans = handle.getValueState("scans", "newest long, complete long")
        self.open = handle.getMapState("open", "id string", value)
        self.closed = handle.getMapState("closed", "id string", value, ttlDurationMs=self.keep_closed_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, complete = self.scans.get() if self.scans.exists() else (-1, 0)
        frame = pd.concat(list(rows))
        out: dict[str, tuple] = {}
        for scan, part in frame.groupby("scan", sort=True):
            scan = int(scan)
            if scan <= newest:
                continue
            newest, whole = scan, bool(part["complete"].any())
            ids = set(part["id"].dropna())
            complete += whole
            for i in ids:
                self.open.updateValue((i,), (scan, complete))
                if self.closed.containsKey((i,)):
                    self.closed.removeKey((i,))
                out[i] = (True, scan, complete, None)
            if whole:  # what is open holds the scan's own postings and those it closes
                for k, v in [(k, v) for k, v in self.open.iterator() if k[0] not in ids]:
                    self.open.removeKey(k)
                    self.closed.updateValue(k, v)
                    out[k[0]] = (False, v[0], v[1], scan)
        self.scans.update((newest, complete))
        if out:
            yield pd.DataFrame([(key[0], i, *r, newest) for i, r in out.items()], columns=[*self.fields, "is_active", "seen_scan", "complete_before", "closed_scan", "revision"]).astype({"closed_scan": "Int64"})

    def close(self) -> None:
        pass


def closures_stream(scans: DataFrame, *, feed: str = "feed_id", key: str = "external_id", parts: int = PARTS, keep_closed: int | None = None) -> DataFrame:
    """Changes of postings by scans: (feed, key, is_active, seen_scan, complete_before, closed_scan, revision).

    ``scans`` has a row for each posting a scan lists, and a row with a null key for each scan (so that every part of the feed
    learns of it); all rows of a scan come in one micro-batch.  A complete scan closes what it does not list, an incomplete one nothing;
    ``closed_scan`` stays that of the first complete scan that missed the posting.  Scans not newer than the newest of their feed are
    passed over.  ``keep_closed`` (seconds) forgets postings closed longer ago, which then come back as new.
    ``complete_before`` counts the feed's complete scans up to the sighting, so misses are the feed's complete scans less that number.
    """
    f_type, k_type = (scans.schema[c].dataType.simpleString() for c in (feed, key))
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts))
    where = F.when(F.col(key).isNull(), F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")).otherwise(F.array(part))
    rows = scans.select(F.col(feed).alias("feed"), F.explode(where).alias("part"), F.col("scan").cast("bigint").alias("scan"), F.coalesce("complete", F.lit(False)).alias("complete"), F.col(key).cast("string").alias("id"))
    schema = f"{feed} {f_type}, {key} string, is_active boolean, seen_scan bigint, complete_before bigint, closed_scan bigint, revision bigint"
    mode = "ProcessingTime" if keep_closed else "None"
    out = rows.groupBy("feed", "part").transformWithStateInPandas(_Closures((feed, key), keep_closed * 1000 if keep_closed else None), schema, "Update", mode)
    return out.withColumn(key, F.col(key).cast(k_type))


class _Newest(StatefulProcessor):
    """The newest revision of a key that was handed on."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "revision long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            top = frame.loc[[frame["revision"].idxmax()]]
            best = top if best is None or top["revision"].iloc[0] > best["revision"].iloc[0] else best
        revision = int(best["revision"].iloc[0])
        if not self.done.exists() or revision > self.done.get()[0]:
            self.done.update((revision,))
            yield best[self.columns]

    def close(self) -> None:
        pass


def newest_stream(changes: DataFrame, key: str, revision: str) -> DataFrame:
    """``changes`` that are newer than all of their key before, the newest of each micro-batch: what a dirty queue has to recompute.

    Of rows with equal revisions any one is taken, as they state the same; rows without key or revision are passed over.
    """
    fields = changes.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = changes.filter(F.col(key).isNotNull() & F.col(revision).isNotNull()).withColumn("revision", F.col(revision).cast("bigint")).withColumn("__key", F.col(key))
    return rows.groupBy("__key").transformWithStateInPandas(_Newest([f.name for f in fields]), schema, "Update", "None")


def emit(changes: DataFrame, path: str, checkpoint_dir: str, **trigger):
    """Append the changes of a keyed stream below ``path``, a folder for each micro-batch; run over all that is there, then stop.

    A stream whose state expires by the clock (``keep_closed``) always has another batch: run it with ``once=True``.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return query


def emitted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All changes that ``emit`` has written, with their ``batch``."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)


def latest(changes: DataFrame, *keys: str, by: str | Column = "batch") -> DataFrame:
    """The newest change of each key."""
    others = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(by) if isinstance(by, str) else by).alias("r")).select(*keys, "r.*")
