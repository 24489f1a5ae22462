"""Writes as joins of two generations of a table: the stored one and what came in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(current: DataFrame, incoming: DataFrame, scans: DataFrame, now: Column, *, feed: str = "feed_id", key: str = "external_id", fields: Sequence[str] = ()) -> DataFrame:
    """One feed scan applied to stored postings.

    current: feed, key, fields, is_active, misses, closed_at.  incoming: feed, key, fields.  scans: feed, complete.
    Seen postings are inserted or updated, active, with no misses; unseen ones of a complete scan get a miss more and are
    closed (the first closing time stays); unseen ones of other scans stay as they are.
    """
    seen = incoming.withColumn("__seen", F.lit(True))
    both = current.withColumn("__old", F.lit(True)).alias("c").join(seen.alias("i"), (F.col(f"c.{feed}") == F.col(f"i.{feed}")) & (F.col(f"c.{key}") == F.col(f"i.{key}")), "full")
    is_seen, missed = F.coalesce(F.col("i.__seen"), F.lit(False)), F.coalesce(F.col("complete"), F.lit(False)) & F.col("i.__seen").isNull()
    joined = both.withColumn("__feed", F.coalesce(f"c.{feed}", f"i.{feed}")).join(scans.select(F.col(feed).alias("__feed"), "complete"), "__feed", "left")
    active = F.when(is_seen, True).when(missed, False).otherwise(F.col("c.is_active"))
    return joined.select(
        F.col("__feed").alias(feed),
        F.coalesce(f"c.{key}", f"i.{key}").alias(key),
        *[F.when(is_seen, F.col(f"i.{f}")).otherwise(F.col(f"c.{f}")).alias(f) for f in fields],
        active.alias("is_active"),
        F.when(is_seen, 0).when(missed, F.col("c.misses") + 1).otherwise(F.col("c.misses")).alias("misses"),
        F.when(is_seen, None).when(missed & F.col("c.is_active"), F.coalesce("c.closed_at", now)).otherwise(F.col("c.closed_at")).alias("closed_at"),
        F.when(F.col("c.__old").isNull(), "inserted").when(is_seen, "updated").when(missed & F.col("c.is_active"), "closed").otherwise("kept").alias("change"),
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO UPDATE: incoming rows replace stored rows of the same key."""
    return incoming.select(current.columns).unionByName(current.join(incoming.select(*keys), list(keys), "left_anti").select(current.columns))


def insert_new(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return current.unionByName(incoming.join(current.select(*keys), list(keys), "left_anti").select(current.columns))


def upsert_keeping_previous(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New statuses; previous_status becomes the old one where it changed, else stays."""
    new = incoming.select(*keys, F.col("status").alias("__new"))
    joined = current.join(new, list(keys), "full")
    changed = F.col("__new").isNotNull() & F.col("status").isNotNull() & (F.col("__new") != F.col("status"))
    return joined.select(*keys, F.coalesce("__new", "status").alias("status"), F.when(changed, F.col("status")).otherwise(F.col("previous_status")).alias("previous_status"))


#: States that no closing changes, and the states that a closing rejects (fixed values).
FINAL = ("accepted", "rejected", "closed")
APPLIED = ("applied", "interview", "offer")


def close_states(applications: DataFrame, closed_jobs: DataFrame, *, job: str = "job_id") -> DataFrame:
    """Applications of closed jobs: applied ones become rejected, other open ones closed; the old state is kept."""
    hit = applications.join(closed_jobs.select(job).distinct().withColumn("__closed", F.lit(True)), job, "left")
    changes = F.col("__closed").isNotNull() & ~F.col("status").isin(*FINAL)
    new = F.when(changes & F.col("status").isin(*APPLIED), "rejected").when(changes, "closed").otherwise(F.col("status"))
    return hit.withColumn("previous_status", F.when(changes, F.col("status")).otherwise(F.col("previous_status"))).withColumn("status", new).drop("__closed").select(applications.columns)


def replace_range(current: DataFrame, derived: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Delete the derived rows of the keys in scope and put in the recomputed ones."""
    return current.join(scope.select(key).distinct(), key, "left_anti").select(current.columns).unionByName(derived.select(current.columns))


def replace_children(old: DataFrame, new: DataFrame) -> DataFrame:
    """Multiset difference of child rows: (…, change) with kept, added and removed."""
    return (
        old.intersectAll(new).withColumn("change", F.lit("kept")).unionByName(new.exceptAll(old).withColumn("change", F.lit("added"))).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))
    )


def merge_fields(current: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str], *, text: str = "description", verified: str = "verified", metadata: str | None = None) -> DataFrame:
    """Field-wise import: a non-empty new value wins, the longer text wins unless the stored one is verified, metadata merges."""
    from vacantia.functions.records import merge_maps

    c, i = current.alias("c"), incoming.alias("i")
    j = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full")
    filled = lambda f: F.when(F.trim(F.col(f"i.{f}").cast("string")) != "", F.col(f"i.{f}"))
    longer = F.when(F.coalesce(F.col(f"c.{verified}"), F.lit(False)), F.col(f"c.{text}")).when(F.length(F.coalesce(f"i.{text}", F.lit(""))) > F.length(F.coalesce(f"c.{text}", F.lit(""))), F.col(f"i.{text}")).otherwise(F.col(f"c.{text}"))
    extra = []
    if metadata:
        none = F.expr("cast(map() as map<string,string>)")
        extra = [merge_maps(F.coalesce(f"c.{metadata}", none), F.coalesce(f"i.{metadata}", none)).alias(metadata)]
    return j.select(F.coalesce(f"c.{key}", f"i.{key}").alias(key), *[F.coalesce(filled(f), F.col(f"c.{f}")).alias(f) for f in fields], longer.alias(text), F.coalesce(f"c.{verified}", f"i.{verified}", F.lit(False)).alias(verified), *extra)


def preserve_detail(old: DataFrame, new: DataFrame, key: str, *, summary: str = "summary", detail: str = "detail") -> DataFrame:
    """Keep the stored verified detail where the summary it was fetched for is unchanged."""
    j = new.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
    same = F.coalesce(F.col(f"o.{summary}").eqNullSafe(F.col(f"n.{summary}")) & F.col(f"o.{key}").isNotNull(), F.lit(False))
    return j.select(F.col(f"n.{key}").alias(key), F.col(f"n.{summary}").alias(summary), F.when(same, F.coalesce(f"n.{detail}", f"o.{detail}")).otherwise(F.col(f"n.{detail}")).alias(detail))


def upsert_employers(employers: DataFrame, incoming: DataFrame) -> DataFrame:
    """Match by domain, else by name; new employers are added, stored ones only filled where null.

    employers: id, name, domain, state.  incoming: name, domain, state (one row an employer).
    """
    by_domain = employers.filter("domain is not null").groupBy("domain").agg(F.min("id").alias("d_id"))
    by_name = employers.groupBy(F.lower("name").alias("lname")).agg(F.min("id").alias("n_id"))
    matched = incoming.join(by_domain, "domain", "left").withColumn("lname", F.lower("name")).join(by_name, "lname", "left").withColumn("id", F.coalesce("d_id", "n_id"))
    fill = matched.filter("id is not null").groupBy("id").agg(F.min("domain").alias("i_domain"), F.min("state").alias("i_state"))
    stored = employers.join(fill, "id", "left").select("id", "name", F.coalesce("domain", "i_domain").alias("domain"), F.coalesce("state", "i_state").alias("state"))
    added = matched.filter("id is null").groupBy("lname").agg(F.min("name").alias("name"), F.min("domain").alias("domain"), F.min("state").alias("state")).select(F.lit(None).cast("bigint").alias("id"), "name", "domain", "state")
    return stored.unionByName(added)


def split_archive(rows: DataFrame, winner: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, archived)."""
    flagged = rows.withColumn("__w", F.coalesce(winner, F.lit(False)))
    return flagged.filter("__w").drop("__w"), flagged.filter("not __w").drop("__w")


def restore(current: DataFrame, archive: DataFrame, keys: Sequence[str]) -> DataFrame:
    return insert_new(current, archive, keys)


def enqueue(queue: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Work queue: one row a key with the first queueing time and the newest revision."""
    return queue.select(key, "queued_at", "revision").unionByName(incoming.select(key, "queued_at", "revision")).groupBy(key).agg(F.min("queued_at").alias("queued_at"), F.max("revision").alias("revision"))
