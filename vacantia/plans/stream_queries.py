"""Queries that run a stream over a table, written as files in several parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators.storage import checkpoint, shared_dir
from vacantia.plans.catalog import Tables, query
from vacantia.streaming import keyed

c = F.col


def _streamed(t: Tables, parts: list[DataFrame]) -> tuple[DataFrame, str]:
    """A file stream that takes one part a micro-batch, and the folder it lies in."""
    path = f"{shared_dir(t.spark)}/vacantia/stream-{uuid.uuid4().hex}"
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return t.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


_FROM_FIRST = """WITH RECURSIVE s AS (SELECT user_id, min(ts) AS f FROM events GROUP BY 1
UNION ALL SELECT s.user_id, n.f FROM s JOIN LATERAL (SELECT min(e.ts) AS f FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.f + INTERVAL 21600 SECOND) n ON true WHERE n.f IS NOT NULL)
SELECT s.user_id, s.f AS first_at, s.f + INTERVAL 21600 SECOND AS due_at, (SELECT count(*) FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.f AND e.ts < s.f + INTERVAL 21600 SECOND)::BIGINT AS requests FROM s"""


@query(_FROM_FIRST)
def sm05_from_first(t: Tables):
    return keyed.debounced_from_first(t.events, "user_id", "ts", 21_600)


@query(_FROM_FIRST)
def sm05_keyed_timers(t: Tables):
    """Events as requests in three parts by time; two requests of nobody far ahead let all timers expire."""
    low, high = t.events.agg(F.min("ts"), F.max("ts")).first()
    rows = t.events.select("user_id", "ts")
    cuts = [low + (high - low) * k / 3 for k in (1, 2)]
    flush = [t.spark.sql(f"select -1L user_id, timestamp'2100-01-0{k} 00:00:00' ts") for k in (1, 2)]
    stream, path = _streamed(t, [rows.filter(c("ts") < cuts[0]), rows.filter((c("ts") >= cuts[0]) & (c("ts") < cuts[1])), rows.filter(c("ts") >= cuts[1]), *flush])
    keyed.emit(keyed.debounced_stream(stream, "user_id", "ts", 21_600, late="1 second"), f"{path}/out", f"{path}/state")
    out = keyed.emitted(t.spark, f"{path}/out", "user_id bigint, first_at timestamp, due_at timestamp, requests bigint")
    return out.filter("user_id >= 0").drop("batch")


@query("""WITH seen AS (SELECT user_id % 20 AS feed_id, event_id % 50 AS external_id, max(event_id % 8) AS scan FROM events GROUP BY 1, 2)
SELECT feed_id, external_id, scan = 7 AS is_active, (7 - scan - CASE WHEN scan < 3 THEN 1 ELSE 0 END)::BIGINT AS misses, CASE WHEN scan = 2 THEN 4 WHEN scan < 7 THEN scan + 1 END::BIGINT AS closed_scan FROM seen""")
def sm07_keyed_closures(t: Tables):
    """Eight scans of each feed in two parts, all complete but the fourth, as keyed state."""
    listed = t.events.select((c("user_id") % 20).alias("feed_id"), (c("event_id") % 8).alias("scan"), (c("event_id") % 8 != 3).alias("complete"), (c("event_id") % 50).alias("external_id")).distinct()
    marks = t.spark.range(160).select((c("id") % 20).alias("feed_id"), F.floor(c("id") / 20).alias("scan"), (F.floor(c("id") / 20) != 3).alias("complete"), F.lit(None).cast("bigint").alias("external_id"))
    rows = checkpoint(listed.unionByName(marks), "scans")
    stream, path = _streamed(t, [rows.filter("scan < 4"), rows.filter("scan >= 4")])
    keyed.emit(keyed.closures_stream(stream, parts=2), f"{path}/out", f"{path}/state")
    schema = "feed_id bigint, external_id bigint, is_active boolean, seen_scan bigint, complete_before bigint, closed_scan bigint, revision bigint"
    whole = rows.filter("complete").groupBy("feed_id").agg(F.countDistinct("scan").alias("whole"))
    now = keyed.latest(keyed.emitted(t.spark, f"{path}/out", schema), "feed_id", "external_id")
    return now.join(whole, "feed_id").select("feed_id", "external_id", "is_active", (c("whole") - c("complete_before")).alias("misses"), "closed_scan")
