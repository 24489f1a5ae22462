"""Best-first discovery over captured pages, all employers at once, and searches under a budget.

Each round takes every employer's best open link (score, then the order in which links came in), looks it up among the
captured pages, and adds the page's links.  As one link an employer is taken in a round, the order is that of a heap an employer,
and rounds are bounded by the page budget and the redirects to pages already seen.  A round is a few joins and an
aggregate that is combined before its shuffle; its tables are written, and the next round reads only what is still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.storage import checkpoint, drop

#: Score of an employer's own address.
SEED = 200


def discover(seeds: DataFrame, captures: DataFrame, *, max_pages: int = 24, max_depth: int = 5) -> DataFrame:
    """(employer, place, requested_url, url, state, depth, parent): the pages each employer's search reads, in order from 0.

    seeds: employer, url.  captures: url, final_url (null: url), state, links (array<struct<url, score>> in page order); one row a URL.
    A URL is read once, by its requested or final address: a redirect to a page already read takes no place.  Pages that were not captured are
    read as ``not_captured``; only pages whose state is ``ok`` give links, up to ``max_depth``; ``max_pages`` counts all pages read.
    Null URLs are no links; of an employer's several seeds each is an open link.
    """
    pages = captures.select("url", F.coalesce("final_url", "url").alias("final_url"), "state", "links")
    start = seeds.filter(F.col("url").isNotNull() & F.col("employer").isNotNull()).distinct()
    open_ = checkpoint(start.select("employer", "url", F.lit(SEED).cast("double").alias("score"), F.lit(0).alias("round"), F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), "open")
    read: list[DataFrame] = []  # one table a round: what was taken, and whether it took a place
    seen = checkpoint(start.select("employer", F.col("url").alias("seen")).limit(0), "seen")
    number = 0
    while True:
        number += 1
        spent = reduce(DataFrame.unionByName, read).filter("counts").groupBy("employer").agg(F.count("*").alias("spent")) if read else None
        best = open_.groupBy("employer").agg(F.min(F.struct((-F.col("score")).alias("low"), "round", "at", "url", "depth", "parent")).alias("b"))
        if spent is not None:
            best = best.join(spent, "employer", "left").filter(F.coalesce("spent", F.lit(0)) < max_pages)
        taken = best.select("employer", F.col("b.url").alias("requested_url"), F.col("b.depth").alias("depth"), F.col("b.parent").alias("parent"))
        got = taken.join(pages, taken["requested_url"] == pages["url"], "left").select("employer", "requested_url", F.coalesce("final_url", "requested_url").alias("url"), F.coalesce("state", F.lit("not_captured")).alias("state"), "depth", "parent", "links")
        again = seen.select("employer", F.col("seen").alias("url"), F.lit(True).alias("again"))
        got = got.join(again, ["employer", "url"], "left").withColumn("counts", (F.col("url") == F.col("requested_url")) | F.col("again").isNull()).withColumn("place", F.lit(number))
        got = checkpoint(got.drop("again"), "read")
        if got.isEmpty():
            drop(got)
            break
        read.append(got.drop("links"))
        addresses = got.select("employer", F.explode(F.array_distinct(F.when(F.col("counts"), F.array("requested_url", "url")).otherwise(F.array("requested_url")))).alias("seen"))
        later = checkpoint(seen.unionByName(addresses), "seen")
        more = got.filter((F.col("state") == "ok") & F.col("counts") & (F.col("depth") < max_depth)).select("employer", (F.col("depth") + 1).alias("depth"), F.col("url").alias("parent"), F.posexplode("links").alias("at", "link"))
        more = more.select("employer", F.col("link.url").alias("url"), F.col("link.score").cast("double").alias("score"), F.lit(number).alias("round"), "at", "depth", "parent").filter("url is not null")
        rest = checkpoint(open_.unionByName(more).join(later.withColumnRenamed("seen", "url"), ["employer", "url"], "left_anti").select(open_.columns), "open")
        drop(open_)
        drop(seen)
        open_, seen = rest, later
    drop(open_)
    drop(seen)
    if not read:
        return start.select("employer", F.lit(0).cast("bigint").alias("place"), F.col("url").alias("requested_url"), "url", F.lit("").alias("state"), F.lit(0).alias("depth"), F.lit("").alias("parent")).limit(0)
    every = reduce(DataFrame.unionByName, read).filter("counts")
    order = Window.partitionBy("employer").orderBy("place")  # at most max_pages rows
    return every.select("employer", (F.row_number().over(order) - 1).cast("bigint").alias("place"), "requested_url", "url", "state", "depth", "parent")


def budgeted_searches(plan: DataFrame, budget: int) -> DataFrame:
    """(company, stage, query, runs, answered) of the searches that come up: which ones a budget pays for, and which have an answer.

    plan: company, rank, stage (from 0), query, resolves (whether the answer settles the company); a company has one query a stage.
    Every stage but the last may spend two thirds of what is left (one at least), the last all of it; what a stage leaves carries over.
    Within a stage companies come by rank; a query already answered costs nothing, one that several companies ask is paid by the first; settled
    companies ask no more.  The number of stages is the number of rounds; ``budget`` bounds what a round takes in order.
    """
    plan = plan.filter("company is not null and query is not null")
    stages = sorted(r[0] for r in plan.select("stage").distinct().collect())
    left, out = max(0, budget), []
    answers = plan.select("query").limit(0)
    settled = plan.select("company").limit(0)
    for k in stages:
        asked = checkpoint(plan.filter(F.col("stage") == k).join(settled, "company", "left_anti"), "asked")
        allowed = left if k == stages[-1] else min(left, max(1, left * 2 // 3))
        fresh = asked.join(answers, "query", "left_anti").groupBy("query").agg(F.min(F.struct("rank", "company")).alias("first"))
        paid = checkpoint(fresh.orderBy("first", "query").limit(allowed), "paid")
        left -= paid.count()
        answers = checkpoint(answers.union(paid.select("query")).distinct(), "answers")
        payer = paid.select("query", F.col("first.company").alias("payer"))
        rows = asked.join(answers.withColumn("answered", F.lit(True)), "query", "left").join(payer, "query", "left")
        out.append(rows.select("company", "stage", "query", F.coalesce(F.col("payer") == F.col("company"), F.lit(False)).alias("runs"), F.coalesce("answered", F.lit(False)).alias("answered")))
        settled = checkpoint(settled.union(asked.filter("resolves").join(answers, "query", "left_semi").select("company")).distinct(), "settled")
    return reduce(DataFrame.unionByName, out) if out else plan.select("company", "stage", "query", F.lit(False).alias("runs"), F.lit(False).alias("answered"))
