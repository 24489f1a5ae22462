"""Batch imports and merges: fixtures, supplements, campaign results, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import urls


def import_fixture(companies: DataFrame, careers: DataFrame, stored: DataFrame) -> DataFrame:
    """Companies with their career results (left join by source id) over stored ones; an older observation never overwrites a newer.

    companies: source_id, name, observed_at.  careers: source_id, career_url, status.  stored: source_id, name, career_url, status, observed_at.
    """
    new = companies.join(careers, "source_id", "left").select("source_id", "name", "career_url", "status", "observed_at")
    both = stored.select(new.columns).unionByName(new)
    rest = [c for c in new.columns if c != "source_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.col("observed_at").isNotNull(), "observed_at"))
    return both.groupBy("source_id").agg(best.alias("r")).select("source_id", "r.*")


def supplement_rows(body: Column) -> Column:
    """Nested employers -> feeds -> postings (JSON) as array<struct<employer, feed_url, external_id, title, url>>."""
    e = F.from_json(body, "array<struct<name:string,feeds:array<struct<feed_url:string,jobs:array<struct<id:string,title:string,url:string>>>>>>")
    rows = F.transform(e, lambda c: F.flatten(F.transform(c["feeds"], lambda f: F.transform(f["jobs"], lambda j: F.struct(c["name"].alias("employer"), f["feed_url"].alias("feed_url"), j["id"].alias("external_id"), j["title"].alias("title"), j["url"].alias("url"))))))
    return F.flatten(rows)


def repeated_urls(sources: DataFrame, url_col: str = "url") -> DataFrame:
    """Configured URLs that stand more than once, in canonical form."""
    return sources.groupBy(F.coalesce(urls.canonical_url(F.col(url_col)), F.lower(url_col)).alias("url")).agg(F.count("*").alias("n")).filter("n > 1")


def saved_area(preferences: Column) -> Column:
    """struct(city, country_code, latitude, longitude, radius_km) of a profile's JSON; null without coordinates."""
    a = F.from_json(F.get_json_object(preferences, "$.search_area"), "city string, country_code string, latitude double, longitude double, radius_km double")
    return F.when(a["latitude"].isNotNull() & a["longitude"].isNotNull(), a)


def allowed_profile(preferences: Column, fields: Sequence[str]) -> Column:
    """A profile's map with the allowed keys only."""
    return F.map_filter(F.from_json(preferences, "map<string,string>"), lambda k, _: k.isin(*fields))


def location_rows(new: DataFrame, old: DataFrame) -> DataFrame:
    """Locations (job_id, label, latitude, longitude); coordinates of the old location with the same label fill missing ones."""
    known = old.groupBy("job_id", F.lower("label").alias("__l")).agg(F.max_by(F.struct("latitude", "longitude"), F.col("latitude").isNotNull()).alias("o"))
    j = new.withColumn("__l", F.lower("label")).join(known, ["job_id", "__l"], "left")
    missing = F.col("latitude").isNull() | F.col("longitude").isNull()
    return j.select("job_id", "label", F.when(missing, F.col("o.latitude")).otherwise(F.col("latitude")).alias("latitude"), F.when(missing, F.col("o.longitude")).otherwise(F.col("longitude")).alias("longitude"))


def within_feed_area(locations: Column, lat: float, lon: float, radius_km: float) -> Column:
    """Whether any location of a posting lies in a feed's saved area (its scan then counts as windowed)."""
    from vacantia.functions import geo

    return F.exists(locations, lambda x: F.coalesce(geo.within_radius(x["latitude"], x["longitude"], F.lit(lat), F.lit(lon), F.lit(radius_km)), F.lit(False)))


def save_posting(employers: DataFrame, postings: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual saves (employer, feed_url, external_id, title): employers and postings that are not there are added; each employer's count grows by its new postings.

    employers: name, job_count.  postings: feed_url, external_id, title.
    """
    fresh = new.dropDuplicates(["feed_url", "external_id"]).join(postings, ["feed_url", "external_id"], "left_anti")
    added = fresh.groupBy(F.col("employer").alias("name")).agg(F.count("*").alias("n"))
    counts = employers.join(added, "name", "full").select("name", (F.coalesce("job_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("job_count"))
    return counts, postings.unionByName(fresh.select(postings.columns))


def merge_results(slices: DataFrame, cohort: DataFrame, key: str = "source_id") -> DataFrame:
    """Results of crawl slices with a ``state``: merged, repeated (in several slices), missing (in the cohort only) or foreign."""
    per = slices.groupBy(key).agg(F.countDistinct("slice").alias("n"), F.max_by("status", "slice").alias("status"))
    j = per.withColumn("__r", F.lit(True)).join(cohort.select(key).withColumn("__c", F.lit(True)), key, "full")
    return j.select(key, "status", F.when(F.col("__r").isNull(), "missing").when(F.col("__c").isNull(), "foreign").when(F.col("n") > 1, "repeated").otherwise("merged").alias("state"))


def enrich_build(candidates: DataFrame, results: DataFrame, prior: DataFrame, key: str = "source_id") -> DataFrame:
    """New results over prior ones; positive evidence that is only in the prior result stays."""
    good = ("jobs_feed_found", "jobs_extracted", "career_content_found")
    j = candidates.select(key).join(results.select(key, F.col("status").alias("__n"), F.col("career_url").alias("__nu")), key, "left").join(prior.select(key, F.col("status").alias("__p"), F.col("career_url").alias("__pu")), key, "left")
    keep = F.coalesce(F.col("__p").isin(*good) & ~F.coalesce(F.col("__n").isin(*good), F.lit(False)), F.lit(False))
    return j.select(key, F.when(keep, F.col("__p")).otherwise(F.coalesce("__n", "__p", F.lit("unresolved"))).alias("status"), F.when(keep, F.col("__pu")).otherwise(F.coalesce("__nu", "__pu")).alias("career_url"))


def fill_websites(existing: DataFrame, selected: DataFrame) -> DataFrame:
    """Imported companies (source_id, website_url, career_status) with the websites selected for those that have none, and ``method`` of a website filled in.

    selected: source_id, website_url, method, one row a source (``identity.select_websites``).  Sources that are not there are added, not yet checked; a website that is there
    stays, and an empty one counts as none.
    """
    new = selected.select("source_id", F.col("website_url").alias("__url"), "method")
    own = F.nullif("website_url", F.lit(""))
    j = existing.select("source_id", "website_url", "career_status").join(new, "source_id", "full")
    return j.select("source_id", F.coalesce(own, "__url").alias("website_url"), F.coalesce("career_status", F.lit("not_checked")).alias("career_status"), F.when(own.isNull(), F.col("method")).alias("method"))


def accepted_results(companies: DataFrame, results: DataFrame) -> DataFrame:
    """Career results (source_id, website, status) with ``accepted``: only those of a company with a website, tested on that website's host; rows of unknown companies are not."""
    from vacantia.functions import urls

    site = lambda u: F.regexp_replace(urls.host(F.col(u)), r"^www\.", "")
    j = results.join(companies.select("source_id", "website_url"), "source_id", "left")
    return j.select("source_id", "website", "status", F.coalesce(site("website") == site("website_url"), F.lit(False)).alias("accepted"))


def drop_unverified(rows: DataFrame) -> DataFrame:
    """Rows (page, trust, …) of verified provenance only; a page that loses all its rows becomes ``unresolved``."""
    ok = F.col("trust").isin("first_party", "branded_external")
    per = rows.groupBy("page").agg(F.count_if(ok).alias("kept"), F.count("*").alias("all"))
    return per.select("page", "kept", (F.col("all") - F.col("kept")).alias("rejected"), F.when(F.col("kept") > 0, "jobs_extracted").otherwise("unresolved").alias("status"))


def keyword_coverage(keywords: DataFrame, posting: Column, output: Column) -> DataFrame:
    """(keyword, in_posting, in_output) by literal presence in normalised text."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    return keywords.select("keyword", F.contains(norm(posting), norm(F.col("keyword"))).alias("in_posting"), F.contains(norm(output), norm(F.col("keyword"))).alias("in_output"))


def citation_catalogue(excerpts: DataFrame, *, limit: int, most: int = 128) -> DataFrame:
    """Citable excerpts (grp, source, seq, text): of a source with more than ``most``, the first and last halves; then round robin over groups and sources, up to ``limit``, with ids in that order."""
    n = F.count("*").over(Window.partitionBy("grp", "source"))
    own = F.row_number().over(Window.partitionBy("grp", "source").orderBy("seq"))
    kept = excerpts.withColumn("n", n).withColumn("place", own).filter((F.col("n") <= most) | (F.col("place") <= most // 2) | (F.col("place") > F.col("n") - most // 2))
    turn = F.row_number().over(Window.partitionBy("grp", "source").orderBy("seq"))
    in_group = F.row_number().over(Window.partitionBy("grp").orderBy("turn", "source"))
    rows = kept.withColumn("turn", turn).withColumn("at", in_group).orderBy("at", "grp").limit(limit)
    ref = F.row_number().over(Window.orderBy("at", "grp"))  # at most ``limit`` rows
    return rows.withColumn("ref", F.concat(F.lit("c"), ref.cast("string"))).select("ref", "grp", "source", "seq", "text")


def resolve_citations(cited: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(…, source, text, known): references not in the catalogue are errors (known false)."""
    return cited.join(catalogue.select("ref", "source", "text"), "ref", "left").withColumn("known", F.col("source").isNotNull())


def discovery_result(pages: DataFrame, boards: DataFrame, prior: DataFrame) -> DataFrame:
    """(company, status, career_url, observed): the best status of boards, pages and the prior run (positive ones stick), the first trusted career page, distinct posting ids.

    pages: company, page_order, url, trusted, career.  boards: company, provider, parsed, external_id.  prior: company, status.
    """
    order = {"jobs_feed_found": 5, "jobs_extracted": 4, "career_content_found": 3, "ats_identified": 2, "unresolved": 1}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    back = F.create_map(*[F.lit(x) for k, v in order.items() for x in (v, k)])
    b = boards.groupBy("company").agg(F.max(F.when(F.col("parsed") & (F.col("provider") != "html"), 5).when(F.col("parsed"), 4).otherwise(2)).alias("b"), F.countDistinct(F.when(F.col("parsed"), F.col("external_id"))).alias("observed"))
    ok = F.col("trusted") & F.col("career")
    p = pages.groupBy("company").agg(F.max(F.when(ok, 3).otherwise(1)).alias("p"), F.min_by("url", F.when(ok, F.col("page_order"))).alias("career_url"), F.bool_or(ok).alias("any"))
    j = p.join(b, "company", "full").join(prior.select("company", rank[F.col("status")].alias("o")), "company", "full")
    old = F.when(F.col("o") >= 3, F.col("o"))
    best = F.greatest(F.coalesce("b", F.lit(1)), F.coalesce("p", F.lit(1)), F.coalesce(old, F.lit(1)))
    return j.select("company", back[best].alias("status"), F.when(F.coalesce("any", F.lit(False)), F.col("career_url")).alias("career_url"), F.coalesce("observed", F.lit(0)).alias("observed"))


def municipality_votes(areas: DataFrame, postal: DataFrame, parties: Sequence[str]) -> DataFrame:
    """Votes of municipalities with postal votes added where one municipality of the region has the name, else the region is marked incomplete.

    areas: region, ags, name, valid, one column a party (district rows).  postal: region, name, valid, one column a party.
    """
    from vacantia.functions import strings

    key = strings.words_of(strings.fold(F.col("name")))
    votes = ["valid", *parties]
    city = areas.groupBy("region", "ags", "name").agg(*[F.sum(v).alias(v) for v in votes]).withColumn("__k", key)
    unique = city.groupBy("region", "__k").agg(F.count("*").alias("n"), F.min("ags").alias("ags")).filter("n = 1").drop("n")
    mail = postal.withColumn("__k", key).groupBy("region", "__k").agg(*[F.sum(v).alias(v) for v in votes]).join(unique, ["region", "__k"], "left")
    by_mail = mail.filter("ags is not null").groupBy("ags").agg(*[F.sum(v).alias(f"m_{v}") for v in votes])
    shared = mail.filter("ags is null").select("region").distinct().withColumn("__shared", F.lit(True))
    j = city.join(by_mail, "ags", "left").join(shared, "region", "left")
    total = {v: F.col(v) + F.coalesce(f"m_{v}", F.lit(0)) for v in votes}
    rows = j.select("ags", "name", *[e.alias(v) for v, e in total.items()], F.col("__shared").isNull().alias("postal_included"))
    most = F.greatest(*parties) if len(parties) > 1 else F.col(parties[0])
    lead = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when((F.col(p) == most) & (F.col(p) > 0), F.lit(p)) for p in parties]))), " / ")
    return rows.filter("valid > 0").withColumn("leading", lead).withColumn("leading_share", F.round(100 * most / F.col("valid"), 2))
