"""One vacancy, many postings: identity keys, groups and winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import dates, strings, urls
from vacantia.operators.components import connected_components
from vacantia.operators.relational import best_per_group

#: Titles that name no vacancy of their own, company sources that stand for no employer (fixed values).
OPEN_TITLES = ("initiativbewerbung", "general application", "unsolicited application", "talent pool")
MANAGED = ("default_job_feed", "managed_feed")


def vacancy_keys(postings: DataFrame) -> DataFrame:
    """(job_id, key): a posting's identity keys, exploded; postings that share a key are one vacancy.

    postings: job_id, feed_id, external_id, url, title, location_text, date_posted, requisition_id, provider, tenant, company_id,
    company_category, company_source, employer_id, group_id (null where unknown).
    """
    part = lambda *c: F.when(sum((x.isNull().cast("int") for x in c), F.lit(0)) == 0, F.concat_ws("\x1f", *[x.cast("string") for x in c]))
    c, tag = F.col, F.lit
    own = F.when((F.coalesce(c("company_category"), tag("")) != "job_board_source") & ~F.coalesce(c("company_source"), tag("")).isin(*MANAGED), c("company_id"))
    employer = F.coalesce(c("employer_id"), own)
    requisition = F.nullif(c("requisition_id"), tag(""))
    title, place = strings.text_key(c("title")), strings.text_key(c("location_text"))
    posted = F.when(F.length(c("date_posted")) > 0, F.substring("date_posted", 1, 10))
    vacancy = F.when((F.length(title) >= 8) & (place != "") & ~title.isin(*OPEN_TITLES), part(tag("employer-vacancy"), employer, title, place, posted))
    keys = F.array(
        part(tag("source"), c("feed_id"), c("external_id")),
        part(tag("retained-vacancy"), c("group_id")),
        part(tag("url"), urls.canonical_url(c("url"))),
        part(tag("requisition"), c("provider"), tag("company"), c("company_id"), requisition),
        part(tag("requisition"), c("provider"), tag("tenant"), F.nullif(c("tenant"), tag("")), requisition),
        part(tag("requisition"), tag("employer"), employer, requisition),
        vacancy,
    )
    return postings.select("job_id", F.explode(F.array_compact(keys)).alias("key"))


def group_by_keys(keys: DataFrame, *, id_col: str = "job_id", key_col: str = "key") -> DataFrame:
    """(id_col, group): rows that share a key, transitively, with their smallest id.

    Each key links its rows to its smallest id (an aggregate), so a key of many rows gives as many edges, not pairs.
    """
    low = keys.groupBy(key_col).agg(F.min(id_col).alias("__low"), F.count("*").alias("__n")).filter("__n > 1")
    edges = keys.join(low, key_col).filter(F.col(id_col) != F.col("__low")).select(F.col(id_col).alias("src"), F.col("__low").alias("dst"))
    found = connected_components(edges)
    return keys.select(id_col).distinct().join(found.withColumnRenamed("node", id_col), id_col, "left").select(id_col, F.coalesce("component", id_col).alias("group"))


def richness(now: Column) -> list[Column]:
    """Order of the postings of a vacancy: open first, then the longest description, the most locations, the smallest id."""
    live = F.col("is_active") & ~dates.is_expired(F.col("valid_through"), now)
    return [live.desc(), F.length(F.coalesce("description", F.lit(""))).desc(), F.coalesce("n_locations", F.lit(0)).desc(), F.col("job_id").asc()]


def deduplicate(postings: DataFrame, now: Column) -> DataFrame:
    """The richest posting of each vacancy, with its ``group``."""
    grouped = postings.drop("group").join(group_by_keys(vacancy_keys(postings)), "job_id")
    return best_per_group(grouped, ["group"], richness(now))


def merge_incrementally(stored: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New postings' keys joined to a stored (key, group) table: the rewritten key table and (job_id, group) of the new postings."""
    nodes = keys.select(F.col("job_id").alias("node"), "key").unionByName(stored.select(F.col("group").alias("node"), "key"))
    groups = group_by_keys(nodes, id_col="node")
    table = nodes.join(groups, "node").groupBy("key").agg(F.min("group").alias("group"))
    return table, keys.select(F.col("job_id").alias("node")).distinct().join(groups, "node").select(F.col("node").alias("job_id"), "group")


def canonical_per_domain(companies: DataFrame, *, id_col: str = "id", url_col: str = "website_url") -> DataFrame:
    """(id_col, root): the company that stands for a website's domain is its smallest unpaused id, else its smallest."""
    keyed = companies.select(F.col(id_col), F.col("paused"), urls.domain_key(F.col(url_col)).alias("__d"))
    roots = keyed.filter("__d is not null").groupBy("__d").agg(F.coalesce(F.min(F.when(~F.col("paused"), F.col(id_col))), F.min(id_col)).alias("root"))
    found = keyed.filter("__d is not null").join(roots, "__d").select(id_col, "root")
    return found.unionByName(keyed.filter("__d is null").select(id_col, F.col(id_col).alias("root")))


def merge_postings(rows: DataFrame, key: str, order: str, fields: list[str], *, text: str = "description") -> DataFrame:
    """One row a key: the first non-null value of each field in page order, the longest text."""
    first = lambda f: F.min(F.when(F.col(f).isNotNull(), F.struct(order, f)))[f]
    best = F.max(F.when(F.col(text).isNotNull(), F.struct(F.length(text).alias("n"), (-F.col(order)).alias("o"), F.col(text).alias("t"))))["t"]
    return rows.groupBy(key).agg(*[first(f).alias(f) for f in fields], best.alias(text))
