"""Running the engine: the matching queue, comparisons of runs, outcomes of fields, campaigns, and failures of feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CHALLENGES, UNSUPPORTED = ("bot_challenge",), ("unsupported_api", "browser_unavailable")
OUTCOMES = ("filled", "missed", "wrong", "preserved", "not_visible", "unrendered")


def reconcile_queue(tasks: DataFrame, inventory: DataFrame, selected: DataFrame, stored: DataFrame, *, version: str, now: Column) -> DataFrame:
    """The matching queue after a change of sources: (profile, job, source_hash, version, state, attempts, priority, available_at).

    tasks: that row, one a pair.  inventory: profile, job of active postings.  selected: profile, job, source_hash, priority.  stored: profile, job, source_hash, version
    of assessments.  A pair out of the selection is ``excluded``.  A selected one is ``done`` if an assessment of its text and of
    ``version`` is stored, else ``pending``; it is set so, with no attempts and available from ``now``, where it is new, its text or the
    version changed, or it was excluded or done before.  Attempts under way or failed on the same text keep their state.  Several stored assessments count as one.
    """
    key = ["profile", "job"]
    held = stored.filter(F.col("version") == version).select(*key, F.col("source_hash").alias("digest")).distinct().withColumn("current", F.lit(True))
    mine = selected.select(*key, F.col("source_hash").alias("digest"), F.col("priority").alias("rank"), F.lit(True).alias("chosen")).join(held, [*key, "digest"], "left")
    old = tasks.select(*key, "source_hash", "version", "state", "attempts", "priority", "available_at", F.lit(True).alias("had"))
    pairs = old.join(mine, key, "full").join(inventory.select(*key).distinct().withColumn("active", F.lit(True)), key, "full")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    changed = ~yes("had") | ~F.col("source_hash").eqNullSafe(F.col("digest")) | ~F.col("version").eqNullSafe(F.lit(version)) | F.coalesce(F.col("state").isin("excluded", "done"), F.lit(True))
    reset = yes("chosen") & changed
    pick = lambda if_chosen, else_: F.when(yes("chosen"), if_chosen).otherwise(else_)
    return pairs.select(
        *key, pick(F.col("digest"), F.coalesce("source_hash", F.lit(""))).alias("source_hash"), pick(F.lit(version), F.coalesce("version", F.lit(version))).alias("version"),
        F.when(~yes("chosen"), "excluded").when(reset & yes("current"), "done").when(reset, "pending").otherwise(F.col("state")).alias("state"),
        F.when(reset, 0).otherwise(F.coalesce("attempts", F.lit(0))).alias("attempts"), pick(F.coalesce("rank", F.lit(0)), F.coalesce("priority", F.lit(0))).alias("priority"),
        F.when(reset, now).otherwise(F.col("available_at")).alias("available_at"),
    )


def compare_scores(baseline: DataFrame, candidate: DataFrame, key: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(key, <measure>_delta …, passed) of each baseline row: passed if the candidate has it and no measure fell (null in either: not passed).  One row a key on both sides."""
    new = candidate.select(*key, *[F.col(m).alias(f"__{m}") for m in measures])
    delta = lambda m: F.col(f"__{m}") - F.col(m)
    passed = F.lit(True)
    for m in measures:
        passed = passed & F.coalesce(delta(m) >= 0, F.lit(False))
    return baseline.join(new, list(key), "left").select(*key, *[delta(m).alias(f"{m}_delta") for m in measures], passed.alias("passed"))


def missing_documents(baseline: DataFrame, candidate: DataFrame, case: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """(case, kind) that each case of the baseline should have and the candidate has not."""
    expected = baseline.select(case).distinct().withColumn(kind, F.explode(F.array(*map(F.lit, kinds))))
    return expected.join(candidate.select(case, kind), [case, kind], "left_anti")


def cohort_summary(rows: DataFrame, cohort: DataFrame) -> DataFrame:
    """(variant, complete, companies, companies_with_jobs, job_rows, pages, statuses) of runs over a frozen cohort.

    rows: variant, index, status, job_rows, pages.  cohort: index.  complete: the variant has every member of the cohort exactly once and nothing else;
    the figures of an incomplete one compare with nothing.  statuses is JSON of counts by status, by name.
    """
    members = cohort.select("index").distinct().withColumn("member", F.lit(True))
    size = members.agg(F.count("*").alias("size"))
    joined = rows.join(members, "index", "left").groupBy("variant", "status").agg(
        F.count("*").alias("n"), F.count_if(F.col("member")).alias("known"), F.count_if(F.col("job_rows") > 0).alias("with_jobs"), F.sum("job_rows").alias("job_rows"), F.sum("pages").alias("pages")
    )
    distinct = rows.select("variant", "index").distinct().groupBy("variant").agg(F.count("*").alias("distinct"))
    by = joined.groupBy("variant").agg(
        F.sum("n").alias("companies"), F.sum("known").alias("known"), F.sum("with_jobs").alias("companies_with_jobs"), F.sum("job_rows").alias("job_rows"), F.sum("pages").alias("pages"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("status", F.lit("")).alias("status"), "n"))))).alias("statuses"),
    )
    by = by.join(distinct, "variant").crossJoin(F.broadcast(size))  # one row
    complete = (F.col("companies") == F.col("size")) & (F.col("known") == F.col("size")) & (F.col("distinct") == F.col("size"))
    return by.select("variant", complete.alias("complete"), "companies", "companies_with_jobs", "job_rows", "pages", "statuses")


def field_outcome(expected: Column, rendered: Column, visible: Column, before: Column, after: Column, matches: Column) -> Column:
    """What became of a form's field: a field without an expectation should stay as it was, an expected one that is not shown, too."""
    same = before.eqNullSafe(after)
    return (
        F.when(~rendered, "unrendered")
        .when(~expected, F.when(same, "preserved").otherwise("wrong"))
        .when(~visible, F.when(same, "not_visible").otherwise("wrong"))
        .when(F.coalesce(matches, F.lit(False)), "filled").when(same, "missed").otherwise("wrong")
    )


def outcome_totals(fields: DataFrame, outcome: str, expected: str) -> DataFrame:
    """(outcome, n, scored, fillable) with zeros for outcomes that did not occur; what is not shown is not scored, what has no expectation not fillable."""
    shown = ~F.col(outcome).isin("not_visible", "unrendered")
    n = fields.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"), F.count_if(shown).alias("scored"), F.count_if(shown & F.col(expected)).alias("fillable"))
    every = fields.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    return every.join(n, "outcome", "left").na.fill(0)


def campaign_status(total: Column, succeeded: Column, failed: Column) -> Column:
    """running until every candidate was tried; then failed if all failed (and there was one), partial if some did, else completed."""
    return F.when(succeeded + failed < total, "running").when((failed == total) & (total > 0), "failed").when(failed > 0, "partial").otherwise("completed")


def client_part(status: Column, between_sections: Column) -> Column:
    """The list that shows a discovery job: current (also one between two sections of a country), scheduled, recent, or none."""
    between = F.coalesce(between_sections, F.lit(False))
    return F.when(status.isin("queued", "running") | between, "current").when(status == "scheduled", "scheduled").when(status.isin("completed", "partial", "failed", "cancelled"), "recent")


def failure_class(state: Column, http_status: Column) -> Column:
    """Why a feed was not read, by its fetch's state and HTTP status; null where the state is ok.  A challenge goes before the status."""
    known = F.coalesce(state, F.lit(""))
    return F.when(known == "ok", None).when(known.isin(*CHALLENGES), "bot_challenge").when(http_status.isin(401, 403), "blocked").when(http_status == 429, "throttled").when(known.isin(*UNSUPPORTED), "unsupported").otherwise("failed")


def undeferred(found: DataFrame, feeds: DataFrame, postings: DataFrame, *, provider: str = "recruitee", read_from: Sequence[str] = ("html_jobs", "browser_html")) -> DataFrame:
    """Feeds found (company, provider, feed_url) without those to be put off: new ones of ``provider`` whose company has active postings read from pages.

    feeds: company, feed_url that exist already; these go on.  postings: company, provider, is_active.
    """
    key = ["company", "feed_url"]
    fresh = found.join(feeds.select(*key).distinct().withColumn("__old", F.lit(True)), key, "left")
    busy = postings.filter(F.col("provider").isin(*read_from) & F.col("is_active")).select("company").distinct().withColumn("__busy", F.lit(True))
    later = F.col("__old").isNull() & F.coalesce(F.col("provider") == provider, F.lit(False)) & F.col("__busy").isNotNull()
    return fresh.join(busy, "company", "left").filter(~later).select(*found.columns)
