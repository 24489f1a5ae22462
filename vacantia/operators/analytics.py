"""Counts, shares, streaks and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import strings
from vacantia.operators.storage import checkpoint

WEEKLY_GOAL = 10
#: Terms of queries that are broadcast at once, on average.
MOST_TERMS = 500_000
#: Terms that documents and queries share, in one task on average.
TASK_TERMS = 2_000_000


def health_counts(roots: DataFrame, now: Column) -> DataFrame:
    """One row of schedule counts over companies: interval (days, null counts as 7) and next_at."""
    days = F.coalesce("interval_days", F.lit(7))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    due = F.col("next_at") <= now
    return roots.agg(
        F.count("*").alias("total"),
        count(days == 1).alias("daily"),
        count(days == 7).alias("weekly"),
        count(days == 30).alias("monthly"),
        count(~days.isin(1, 7, 30)).alias("other"),
        count(due).alias("due"),
        count(F.col("next_at") <= now - F.expr("interval 24 hours")).alias("overdue"),
        count(F.col("next_at").isNull()).alias("unscheduled"),
    )


def weekly_streak(events: DataFrame, now: Column, *, goal: int = WEEKLY_GOAL) -> DataFrame:
    """One row (applied_this_week, lifetime, successful_weeks) of events (job, occurred_at, is_legacy).

    A job counts once, in its earliest week; the streak ends in this week, or in the last one while this week is still short of the goal.
    """
    week_now = F.date_trunc("week", now)
    lifetime = events.agg(F.countDistinct("job").alias("lifetime"))
    first = events.filter("not is_legacy").groupBy("job").agg(F.date_trunc("week", F.min("occurred_at")).alias("week"))
    weeks = first.groupBy("week").agg(F.count("*").alias("n"))
    good = weeks.filter(F.col("n") >= goal)
    # Weeks of one run share week - 7 days * row number: one row a week, so the window is as long as the calendar.
    island = F.unix_date(F.to_date("week")) - 7 * F.row_number().over(Window.orderBy("week"))
    runs = good.withColumn("island", island).groupBy("island").agg(F.max("week").alias("last"), F.count("*").alias("length"))
    this = weeks.filter(F.col("week") == week_now).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("applied_this_week"))
    streak = runs.filter((F.col("last") == week_now) | (F.col("last") == week_now - F.expr("interval 7 days"))).agg(F.max(F.struct("last", "length")).alias("r"))
    return lifetime.crossJoin(this).crossJoin(streak).select("applied_this_week", "lifetime", F.coalesce("r.length", F.lit(0)).cast("bigint").alias("successful_weeks"))


def rolling_count(events: DataFrame, by: Sequence[str], at: str, hours: int) -> DataFrame:
    """Events of each row's last ``hours``, itself included; a row exactly that old has expired."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    frame = Window.partitionBy(*by).orderBy(seconds).rangeBetween(-hours * 3_600_000_000 + 1, 0)
    return events.withColumn("in_window", F.count("*").over(frame))


def shares_with_ties(votes: DataFrame, place: Sequence[str], party: str, n: str) -> DataFrame:
    """(place, total, leading, leading_share): the leading parties, ties joined by `` / ``, and their share in percent."""
    per = votes.groupBy(*place, party).agg(F.sum(n).alias("n"))
    top = per.groupBy(*place).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    lead = per.join(top, list(place)).filter((F.col("n") == F.col("most")) & (F.col("n") > 0))
    return lead.groupBy(*place, "total", "most").agg(F.array_join(F.array_sort(F.collect_list(party)), " / ").alias("leading")).select(*place, "total", "leading", F.round(100 * F.col("most") / F.col("total"), 2).alias("leading_share"))


def best_weight_coverage(rows: DataFrame, by: Sequence[str], key: str, weight: str, got: str) -> DataFrame:
    """Sum of each key's largest ``got`` over the sum of its largest ``weight``."""
    per = rows.groupBy(*by, key).agg(F.max(weight).alias("w"), F.max(got).alias("g"))
    return per.groupBy(*by).agg((F.sum("g") / F.greatest(F.lit(1.0), F.sum("w"))).alias("coverage"))


def requirement_credit(status: Column, distance: Column, category: Column) -> Column:
    """supported 1; transferable .8 if close and a capability or experience, else .5; anything else 0."""
    close = (distance == "close") & F.coalesce(category, F.lit("capability")).isin("capability", "experience")
    return F.when(status == "supported", 1.0).when(status == "transferable", F.when(F.coalesce(close, F.lit(False)), 0.8).otherwise(0.5)).otherwise(0.0)


def requirement_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(coverage, completeness) in percent; preferred requirements weigh a quarter, unknown ones only lower completeness."""
    w = F.when(F.col("priority") == "preferred", 0.25).otherwise(1.0)
    known = F.when(F.col("status") != "unknown", w).otherwise(0.0)
    credit = known * requirement_credit(F.col("status"), F.col("evidence_distance"), F.col("category"))
    return rows.groupBy(*by).agg(F.bround(F.try_divide(100 * F.sum(credit), F.nullif(F.sum(known), F.lit(0.0))), 0).cast("bigint").alias("coverage"), F.bround(100 * F.sum(known) / F.sum(w), 0).cast("bigint").alias("completeness"))


def role_relevance(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean credit of each clause, weighted mean of each importance, 85 parts core and 15 supporting (100 core where there is none)."""
    kept = rows.filter(~F.coalesce("category", F.lit("capability")).isin("education", "credential", "language", "location", "work_authorization", "work_style") & (F.col("priority") != "logistics"))
    credit = requirement_credit(F.col("status"), F.col("evidence_distance"), F.col("category"))
    clause = kept.groupBy(*by, "importance", "priority", "job_quote").agg(F.avg(credit).alias("credit"))
    w = F.when(F.col("priority") == "preferred", 0.25).otherwise(1.0)
    side = lambda name: F.try_divide(F.sum(F.when(F.col("importance") == name, w * F.col("credit"))), F.sum(F.when(F.col("importance") == name, w)))
    sides = clause.groupBy(*by).agg(side("core").alias("core"), side("supporting").alias("supporting"))
    value = F.when(F.col("core").isNull(), 0.0).otherwise(F.col("core") * F.when(F.col("supporting").isNotNull(), 85).otherwise(100) + F.coalesce(F.col("supporting") * 15, F.lit(0.0)))
    return sides.select(*by, F.bround(value, 0).cast("bigint").alias("score"))


def weighted_component(rows: DataFrame, by: Sequence[str], score: str, weight: str) -> DataFrame:
    """Weighted mean of the scores that are there, weights renormalised."""
    there = F.when(F.col(score).isNotNull(), F.col(weight))
    return rows.groupBy(*by).agg((F.sum(F.col(score) * F.col(weight)) / F.sum(there)).alias("component"))


def ranking_metrics(ranked: DataFrame, labels: DataFrame, *, query: str, doc: str, k: int = 10, found: DataFrame | None = None) -> DataFrame:
    """(query, precision_k, recall, ndcg_k) of ranked (query, doc, rank) against labels (query, doc, gain), or (doc, gain) for all queries alike.

    ``ranked`` may end at rank k if ``found`` has all (query, doc) that a query found.
    """
    own = query in labels.columns
    on = [query, doc] if own else [doc]
    dcg = lambda place: (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(place + 1)
    j = ranked.filter(F.col("rank") <= k).join(labels, on, "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    got = j.groupBy(query).agg(F.sum(dcg(F.col("rank"))).alias("dcg"), F.avg((F.col("gain") > 0).cast("double")).alias("p"))
    hits = (ranked if found is None else found).join(labels.filter("gain > 0").select(*on), on).groupBy(query).agg(F.count("*").alias("hits"))
    got = got.join(hits, query, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    relevant = F.sum((F.col("gain") > 0).cast("int")).alias("relevant")
    by_gain = Window.partitionBy(query).orderBy(F.col("gain").desc(), doc) if own else Window.orderBy(F.col("gain").desc(), doc)
    best = (labels if own else labels.orderBy(F.col("gain").desc(), doc).limit(k)).withColumn("place", F.row_number().over(by_gain)).filter(F.col("place") <= k)
    key = [query] if own else []
    ideal, total = best.groupBy(*key).agg(F.sum(dcg(F.col("place"))).alias("ideal")), labels.groupBy(*key).agg(relevant, F.count("*").alias("n")).filter("n > 0")
    j = got.join(ideal, query).join(total, query) if own else got.crossJoin(F.broadcast(ideal)).crossJoin(F.broadcast(total))  # one row each
    return j.select(query, F.round("p", 4).alias("precision_k"), F.round(F.try_divide("hits", "relevant"), 4).alias("recall"), F.round(F.try_divide("dcg", "ideal"), 4).alias("ndcg_k"))


def top_ranks(scored: DataFrame, *, query: str, doc: str, k: int) -> DataFrame:
    """The first k rows of each query by score (six places), then document, with their rank; each task keeps its own first k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 6).desc(), doc))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def places(rows: DataFrame, wanted: DataFrame, *, query: str, doc: str) -> DataFrame:
    """(query, doc, rank): the places of the ``wanted`` (query, doc) among a query's ``rows`` in the documents' order, counted without sorting them."""
    at = wanted.select(query, F.col(doc).alias("__at"))
    return rows.join(at, query).filter(F.col(doc) <= F.col("__at")).groupBy(query, "__at").agg(F.count("*").alias("rank")).withColumnRenamed("__at", doc)


def bm25(docs: DataFrame, queries: DataFrame, *, doc: str, query: str, text: str = "text", k1: float = 1.2, b: float = 0.75, most: int = MOST_TERMS) -> DataFrame:
    """(query, doc, score) of all documents that share a term with a query; a query's repeated terms count once.

    Documents are read once; the counts of query terms are written, corpus statistics with them.  A document's counts then meet the
    queries in one task, which adds up its scores: only counts are shuffled, not the terms of all pairs.  The terms of queries are
    broadcast in blocks of ``most`` rows on average, so any number of queries will do.
    """
    terms = queries.select(query, F.explode(F.array_distinct(strings.tokenize(F.col(text)))).alias("term"))
    blocks = max(1, -(-terms.count() // most))
    small = F.broadcast if blocks == 1 else lambda df: df
    every = F.lit("")  # no token is empty: this one stands for the document itself
    wanted = terms.select("term").union(docs.sparkSession.range(1).select(every.alias("term"))).distinct()
    tokens = docs.select(doc, strings.tokenize(F.col(text)).alias("t"))
    # The length is taken before the terms are spread out, or each of a document's rows would carry all its terms.
    words = tokens.select(doc, F.size("t").alias("dl"), F.concat(F.coalesce("t", F.array().cast("array<string>")), F.array(every)).alias("t"))
    found = words.select(doc, "dl", F.explode("t").alias("term"))
    tf = checkpoint(found.join(small(wanted), "term", "left_semi").groupBy(doc, "dl", "term").agg(F.count("*").alias("tf")), "bm25-tf")
    stats = tf.filter(F.col("term") == every).agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).alias("avgdl"))
    postings = tf.filter(F.col("term") != every)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weights = checkpoint(df.crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"), "avgdl"), "bm25-idf")  # stats: one row
    pairs = weights.join(terms, "term").agg(F.sum("df")).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_TERMS))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))))
    # The sum by query and document needs no shuffle of its own: rows lie by document already.
    parts = postings.join(small(weights), "term").select(doc, "term", part.alias("part")).repartition(tasks, doc)
    block = F.pmod(F.xxhash64(query), F.lit(blocks))
    scored = [parts.join(F.broadcast(terms.filter(block == n) if blocks > 1 else terms), "term").groupBy(query, doc).agg(F.sum("part").alias("score")) for n in range(blocks)]
    return reduce(DataFrame.unionByName, scored)


def fuse_ranks(first: DataFrame, second: DataFrame, *, query: str, doc: str, weight: float, k: int = 60, size: DataFrame | None = None) -> DataFrame:
    """Reciprocal ranks 1 / (k + r1) + weight / (k + r2); a document missing in the second list ranks behind all of it.

    The second list may be cut to documents of the first if ``size`` (query, last) has the rank behind its whole.
    """
    if size is None:
        size = second.groupBy(query).agg((F.max("rank") + 1).alias("last"))
    j = first.withColumnRenamed("rank", "r1").join(second.withColumnRenamed("rank", "r2"), [query, doc], "left").join(size, query, "left")
    return j.select(query, doc, (1 / (k + F.col("r1")) + weight / (k + F.coalesce("r2", "last", F.lit(1)))).alias("score"))


def stage_yield(found: DataFrame, stage: str, key: str) -> DataFrame:
    """(stage, found, new, total): keys of each stage, those no earlier stage had, and the running union."""
    first = found.groupBy(key).agg(F.min(stage).alias(stage)).groupBy(stage).agg(F.count("*").alias("new"))
    all_ = found.groupBy(stage).agg(F.countDistinct(key).alias("found"))
    running = F.sum("new").over(Window.orderBy(stage).rowsBetween(Window.unboundedPreceding, 0))  # one row a stage
    return all_.join(first, stage, "left").withColumn("new", F.coalesce("new", F.lit(0))).withColumn("total", running)


def crawl_rank(employees: Column, recent: Column, positive: Column, empty_checks: Column, paused: Column) -> Column:
    """struct(priority, interval_days) of an employer's evidence."""
    tier = lambda p, d: F.struct(F.lit(p).alias("priority"), F.lit(d).cast("int").alias("interval_days"))
    t = lambda c: F.coalesce(c, F.lit(False))
    return F.when(t(paused), tier(0, None)).when(t(employees >= 250), tier(100, 1)).when(t(recent), tier(90, 1)).when(t(positive), tier(60, 3)).when(t(empty_checks >= 2), tier(10, 30)).otherwise(tier(30, 7))


def location_adjustment(share: Column, weight: Column) -> Column:
    """Points in +- weight (at most 20) by how far a reference share is from 25 percent; 0 without a share."""
    w = F.greatest(F.lit(0), F.least(F.lit(20), weight))
    return F.coalesce(F.greatest(-w, F.least(w, F.bround((25 - F.round(share, 2)) / 25 * w, 0).cast("int"))), F.lit(0))


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in fields])


def distinct_postings(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(company, postings): active postings of each company after duplicates: a group counts once, a posting without one as itself.

    postings: job_id, employer, company, is_active (null: not active).  groups: job_id, group, one row a posting.  The employer stands for the company of the feed where it is known; rows with neither count for none.
    """
    live = postings.filter("is_active").join(groups, "job_id", "left")
    one = live.select(F.coalesce("employer", "company").alias("company"), F.coalesce(F.col("group"), F.col("job_id")).alias("one")).filter("company is not null")
    return one.distinct().groupBy("company").agg(F.count("*").alias("postings"))
