"""Posting feeds to one normalised schema.

``parse_feeds`` takes (feed_id, provider, board_url, body) and gives one row a feed: its postings, whether the feed is
complete (only then may absent postings be closed), and an error for a body of an unexpected shape, which then has
no postings.  JSON and XML are parsed by Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, strings

POSTING = (
    "struct<external_id:string,title:string,url:string,location:string,locations:array<struct<label:string,country_code:string>>,description:string,"
    "work_arrangement:string,is_remote:boolean,employment_type:string,department:string,seniority:string,date_posted:string,salary:string,metadata:map<string,string>>"
)
_NONE = f"cast(array() as array<{POSTING}>)"


def _posting(**fields) -> Column:
    null = {"locations": "array<struct<label:string,country_code:string>>", "is_remote": "boolean", "metadata": "map<string,string>"}
    names = [p.split(":")[0] for p in ("external_id", "title", "url", "location", "locations", "description", "work_arrangement", "is_remote", "employment_type", "department", "seniority", "date_posted", "salary", "metadata")]
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(*[(fields[n] if n in null and n in fields else text(fields[n]) if n in fields else F.lit(None).cast(null.get(n, "string"))).alias(n) for n in names])


def _labels(labels: Column, country: Column | None = None) -> Column:
    kept = F.filter(labels, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return F.transform(kept, lambda x: F.struct(F.trim(x).alias("label"), (F.lit(None).cast("string") if country is None else country).alias("country_code")))


def _meta(**fields: Column) -> Column:
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[c.cast("string") for c in fields.values()]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (F.trim(v) != ""))


def _remote(arrangement: Column) -> Column:
    return F.when(arrangement == "remote", True)


def _millis_date(raw: Column) -> Column:
    return dates.epoch_or_prefix_date(raw)


def greenhouse(body: Column) -> tuple[Column, Column, Column]:
    d = F.from_json(body, "jobs array<struct<id:string,title:string,absolute_url:string,location:struct<name:string>,departments:array<struct<name:string>>,offices:array<struct<name:string>>,content:string,requisition_id:string,updated_at:string>>, meta struct<total:long>")

    def row(r: Column) -> Column:
        offices = F.transform(F.coalesce(r["offices"], F.array().cast("array<struct<name:string>>")), lambda o: F.trim(o["name"]))
        address = F.coalesce(r["location"]["name"], F.lit(""))
        local = F.transform(F.regexp_extract_all(address, F.lit(r"\b\d{5}\s+([^,;]+)"), F.lit(1)), lambda x: F.trim(x))
        known = F.exists(offices, lambda o: (F.lower(o) == F.lower(F.trim(address))) | F.lower(F.trim(address)).startswith(F.concat(F.lower(o), F.lit(","))))
        extra = F.when(F.size(local) > 0, local).when((F.trim(address) != "") & ~F.coalesce(known, F.lit(False)), F.array(F.trim(address))).otherwise(F.array().cast("array<string>"))
        arrangement = F.when(F.trim(address) != "", strings.work_arrangement(address)).otherwise(strings.work_arrangement(F.array_join(offices, " ")))
        return _posting(
            external_id=r["id"], title=r["title"], url=r["absolute_url"], location=address, locations=_labels(F.array_distinct(F.concat(F.array_compact(offices), extra))), description=strings.plain_text(r["content"]),
            work_arrangement=arrangement, is_remote=_remote(arrangement), department=F.array_join(F.transform(r["departments"], lambda x: x["name"]), ", "), metadata=_meta(requisition_id=r["requisition_id"], updated_at=r["updated_at"]),
        )

    return F.transform(d["jobs"], row), F.coalesce(d["meta"]["total"], F.size(d["jobs"]).cast("bigint")) == F.size(d["jobs"]), d["jobs"].isNotNull()


def lever(body: Column) -> tuple[Column, Column, Column]:
    rows = F.from_json(body, "array<struct<id:string,text:string,hostedUrl:string,categories:struct<location:string,department:string,team:string,commitment:string>,workplaceType:string,descriptionPlain:string,description:string,createdAt:string,salaryRange:string>>")

    def row(r: Column) -> Column:
        arrangement, c = strings.work_arrangement(r["workplaceType"]), r["categories"]
        return _posting(
            external_id=r["id"], title=r["text"], url=r["hostedUrl"], location=c["location"], department=F.coalesce(c["department"], c["team"]), employment_type=c["commitment"], work_arrangement=arrangement,
            is_remote=_remote(arrangement), description=strings.plain_text(F.coalesce(r["descriptionPlain"], r["description"])), date_posted=_millis_date(r["createdAt"]), salary=r["salaryRange"], metadata=_meta(workplace_type=r["workplaceType"]),
        )

    return F.transform(rows, row), F.size(rows) < 100, rows.isNotNull()


def ashby(body: Column) -> tuple[Column, Column, Column]:
    d = F.from_json(body, "jobs array<struct<id:string,title:string,jobUrl:string,location:string,secondaryLocations:array<struct<location:string>>,isListed:boolean,isRemote:boolean,workplaceType:string,departmentName:string,teamName:string,employmentType:string,descriptionPlain:string,description:string,publishedAt:string,compensationTierSummary:string>>")

    def row(r: Column) -> Column:
        arrangement = F.when(r["isRemote"], "remote").otherwise(strings.work_arrangement(r["workplaceType"]))
        return _posting(
            external_id=F.coalesce(r["id"], r["jobUrl"]), title=r["title"], url=r["jobUrl"], location=r["location"], locations=_labels(F.transform(r["secondaryLocations"], lambda x: x["location"])),
            department=F.coalesce(r["departmentName"], r["teamName"]), employment_type=r["employmentType"], work_arrangement=arrangement, is_remote=_remote(arrangement),
            description=strings.plain_text(F.coalesce(r["descriptionPlain"], r["description"])), date_posted=_millis_date(r["publishedAt"]), salary=r["compensationTierSummary"],
        )

    listed = F.filter(d["jobs"], lambda r: F.coalesce(r["isListed"], F.lit(True)))
    return F.transform(listed, row), F.lit(True), d["jobs"].isNotNull()


def schema_org(body: Column) -> tuple[Column, Column, Column]:
    place = "struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>"
    post = f"`@type`:string,identifier:string,url:string,title:string,datePosted:string,employmentType:string,description:string,jobLocationType:string,validThrough:string,jobLocation:array<{place}>"
    d = F.from_json(body, f"`@type` string, numberOfItems long, dataFeedElement array<struct<{post},item:struct<{post}>>>")

    def row(e: Column) -> Column:
        wrapped = e["@type"] == "DataFeedItem"
        g = lambda k: F.when(wrapped, e["item"][k]).otherwise(e[k])
        key = F.when(g("identifier").startswith("{"), F.get_json_object(g("identifier"), "$.value")).otherwise(g("identifier"))
        kinds = F.from_json(g("employmentType"), "array<string>")
        label = lambda x: F.array_join(F.array_compact(F.array(x["address"]["addressLocality"], x["address"]["addressRegion"])), ", ")
        home = g("jobLocationType") == "TELECOMMUTE"
        return _posting(
            external_id=F.coalesce(key, g("url")), title=g("title"), url=g("url"), location=F.array_join(F.transform(g("jobLocation"), label), "; "),
            locations=F.transform(g("jobLocation"), lambda x: F.struct(label(x).alias("label"), x["address"]["addressCountry"].alias("country_code"))),
            description=strings.plain_text(g("description")), employment_type=F.when(g("employmentType").startswith("["), F.array_join(kinds, ", ")).otherwise(g("employmentType")),
            date_posted=F.substring(g("datePosted"), 1, 10), work_arrangement=F.when(home, "remote"), is_remote=F.when(home, True), metadata=_meta(validThrough=g("validThrough")),
        )

    rows = d["dataFeedElement"]
    ok = (d["@type"] == "DataFeed") & rows.isNotNull() & F.forall(rows, lambda e: F.coalesce(F.when(e["@type"] == "DataFeedItem", e["item"]["@type"]).otherwise(e["@type"]) == "JobPosting", F.lit(False)))
    return F.transform(rows, row), F.coalesce(d["numberOfItems"], F.size(rows).cast("bigint")) == F.size(rows), ok


def smartrecruiters(body: Column) -> tuple[Column, Column, Column]:
    d = F.from_json(
        body,
        "offset long, limit long, totalFound long, content array<struct<id:string,name:string,visibility:string,ref:string,refNumber:string,releasedDate:string,company:struct<identifier:string,name:string>,"
        "location:struct<city:string,region:string,country:string,fullLocation:string,remote:boolean,hybrid:boolean>,department:struct<label:string>,typeOfEmployment:struct<label:string>,experienceLevel:struct<label:string>>>",
    )

    def row(r: Column) -> Column:
        p = r["location"]
        label = F.coalesce(F.nullif(F.trim(p["fullLocation"]), F.lit("")), F.array_join(F.filter(F.array(p["city"], p["region"], F.when(F.lower(p["country"]) == "de", "Germany").otherwise(p["country"])), lambda x: x.isNotNull() & (x != "")), ", "))
        arrangement = F.when(p["hybrid"], "hybrid").when(p["remote"], "remote")
        return _posting(
            external_id=r["id"], title=r["name"], url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), r["company"]["identifier"], F.lit("/"), r["id"]), location=label, locations=_labels(F.array(label), F.upper(p["country"])),
            department=r["department"]["label"], employment_type=r["typeOfEmployment"]["label"], seniority=r["experienceLevel"]["label"], date_posted=F.substring(r["releasedDate"], 1, 10), work_arrangement=arrangement,
            is_remote=_remote(arrangement), metadata=_meta(requisition_id=r["refNumber"], smartrecruiters_ref=r["ref"], hiring_organization=r["company"]["name"]),
        )

    rows, n = d["content"], F.size(d["content"])
    bounds = (d["offset"] >= 0) & d["limit"].between(1, 100) & (d["totalFound"] >= 0) & (n <= d["limit"]) & (d["offset"] + n <= d["totalFound"])
    public = F.forall(rows, lambda r: F.coalesce((r["visibility"] == "PUBLIC") & r["id"].rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$") & (F.trim(r["name"]) != ""), F.lit(False)))
    distinct = F.size(F.array_distinct(F.transform(rows, lambda r: r["id"]))) == n
    return F.transform(rows, row), (d["offset"] == 0) & (n == d["totalFound"]), bounds & public & distinct


def keyed_map(body: Column, board_url: Column) -> tuple[Column, Column, Column]:
    """A map of postings keyed by id, capped by its source and so never complete."""
    d = F.from_json(body, "status_code int, data map<string,struct<company:string,job_title:string,city:string,location:string,job_type:string,category:string,experience_level:string>>")
    title = lambda r: F.trim(r["job_title"])
    slug = lambda t: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[\s/%]", "-"), "[^a-zA-Z0-9-]", ""), "-+", "-"), "^-|-$", ""))
    rows = F.filter(F.map_entries(d["data"]), lambda e: ~e["value"]["job_title"].rlike(r"(?i)initiativbewerbung|unsolicited application|talent ?pool"))

    def row(e: Column) -> Column:
        r = e["value"]
        return _posting(
            external_id=e["key"], title=title(r), url=F.concat(board_url, F.lit("/"), slug(title(r)), F.lit("-"), e["key"]), location=r["location"], locations=_labels(F.split(r["city"], ",")), employment_type=r["job_type"],
            department=r["category"], seniority=r["experience_level"], metadata=_meta(hiring_organization=r["company"], extraction_method=F.lit("keyed_map")),
        )

    whole = F.forall(F.map_entries(d["data"]), lambda e: F.coalesce(e["key"].rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$") & (F.trim(e["value"]["company"]) != "") & (F.trim(e["value"]["job_title"]) != "") & (F.trim(e["value"]["city"]) != "") & (F.trim(e["value"]["location"]) != ""), F.lit(False)))
    return F.transform(rows, row), F.lit(False), (d["status_code"] == 200) & d["data"].isNotNull() & whole


def personio(body: Column, board_url: Column) -> tuple[Column, Column, Column]:
    d = F.from_xml(F.when(body.contains("<workzag-jobs"), body), "position array<struct<id:string,name:string,office:string,department:string,employmentType:string,recruitingCategory:string,seniority:string,createdAt:string,country:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>")
    root, only = F.regexp_extract(board_url, "^(https?://[^/]+)", 1), F.nullif(F.regexp_extract(board_url, r"/job/(\d+)/?$", 1), F.lit(""))

    def row(r: Column) -> Column:
        arrangement = F.coalesce(strings.work_arrangement(r["office"]), F.when(F.trim(r["office"]) != "", "onsite"))
        parts = F.filter(F.transform(r["jobDescriptions"]["jobDescription"], lambda x: strings.plain_text(x["value"])), lambda x: x.isNotNull())
        return _posting(
            external_id=r["id"], title=r["name"], url=F.concat(root, F.lit("/job/"), r["id"]), location=r["office"], locations=_labels(F.array(r["office"]), F.when(F.length(r["country"]) == 2, F.upper(r["country"]))), description=F.array_join(parts, "\n\n"),
            work_arrangement=arrangement, is_remote=_remote(arrangement), employment_type=F.coalesce(r["employmentType"], r["recruitingCategory"]), department=r["department"], seniority=r["seniority"], date_posted=F.substring(r["createdAt"], 1, 10),
        )

    kept = F.filter(d["position"], lambda r: F.coalesce(r["id"] == only, F.lit(True)))
    ok = body.contains("<workzag-jobs") & F.coalesce(F.forall(d["position"], lambda r: r["id"].isNotNull() & r["name"].isNotNull()), F.lit(True))
    return F.coalesce(F.transform(kept, row), F.expr(_NONE)), only.isNull(), ok


def recruitee(body: Column, board_url: Column) -> tuple[Column, Column, Column]:
    d = F.from_xml(F.when(body.contains("<offers"), body), "offer array<struct<id:string,slug:string,title:string,description:string,requirements:string,location:string,city:string,country_code:string,remote:string,hybrid:string,on_site:string,department:string,employment_type_code:string,experience_code:string,published_at:string,company_name:string,careers_url:string>>")
    root = F.regexp_extract(board_url, "^(https?://[^/]+)", 1)

    def row(r: Column) -> Column:
        arrangement = F.when(r["hybrid"] == "true", "hybrid").when(r["remote"] == "true", "remote").when(r["on_site"] == "true", "onsite")
        return _posting(
            external_id=r["id"], title=r["title"], url=F.coalesce(r["careers_url"], F.concat(root, F.lit("/o/"), r["slug"])), location=F.coalesce(r["location"], r["city"]), locations=_labels(F.array(F.coalesce(r["city"], r["location"])), F.upper(r["country_code"])),
            description=strings.plain_text(F.concat_ws(" ", r["description"], r["requirements"])), work_arrangement=arrangement, is_remote=_remote(arrangement), department=r["department"], employment_type=r["employment_type_code"],
            seniority=r["experience_code"], date_posted=F.substring(r["published_at"], 1, 10), metadata=_meta(hiring_organization=r["company_name"]),
        )

    safe = body.contains("<offers") & ~body.rlike("(?i)<!DOCTYPE|<!ENTITY")
    unique = F.size(F.array_distinct(F.transform(d["offer"], lambda r: r["id"]))) == F.size(d["offer"])
    return F.coalesce(F.transform(d["offer"], row), F.expr(_NONE)), F.lit(True), safe & F.coalesce(unique, F.lit(True)) & F.coalesce(F.forall(d["offer"], lambda r: r["id"].isNotNull() & r["title"].isNotNull()), F.lit(True))


def rss(body: Column, feed_url: Column) -> tuple[Column, Column, Column]:
    """RSS items, RDF items and Atom entries: a rolling window, never complete; declarations of entities are refused."""
    item = "struct<title:string,link:string,guid:string,description:string,location:string,pubDate:string,category:array<string>>"
    plain = F.regexp_replace(body, r"<(/?)(?:[A-Za-z]+):", "<$1")
    r = F.from_xml(F.when(body.rlike(r"<rss\b"), plain), f"channel struct<item:array<{item}>>")["channel"]["item"]
    rdf = F.from_xml(F.when(body.rlike(r"<(?:rdf:)?RDF\b"), plain), f"item array<{item}>")["item"]
    atom = F.from_xml(F.when(body.rlike(r"<feed\b"), plain), "entry array<struct<title:string,id:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,updated:string,published:string>>")["entry"]
    one = lambda title, link, key, text, place, at: _posting(external_id=F.when(F.length(key) > 255, F.concat(F.lit("rss:"), F.sha2(key, 256))).otherwise(key), title=strings.plain_text(title), url=link, location=place, locations=_labels(F.array(place), F.lit("DE")), description=F.left(strings.plain_text(text), F.lit(1000)), date_posted=F.coalesce(F.date_format(dates.parse_feed_date(at), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.left(at, F.lit(80))), metadata=_meta(source=F.lit("rss"), source_feed_url=feed_url))
    place = lambda x: F.coalesce(x["location"], F.nullif(F.trim(F.regexp_extract(strings.plain_text(x["description"]), r"(?i)\b(?:Ort|Standort|Arbeitsort)\s*:\s*([^|;\n]+)", 1)), F.lit("")))
    from_items = lambda rows: F.transform(rows, lambda x: one(x["title"], F.coalesce(x["link"], x["guid"]), F.coalesce(x["guid"], x["link"]), x["description"], place(x), x["pubDate"]))

    def from_entry(x: Column) -> Column:
        links = F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
        url = F.coalesce(F.try_element_at(links, F.lit(1))["_href"], x["id"])
        return one(x["title"], url, F.coalesce(x["id"], url), F.coalesce(x["summary"], x["content"]), F.lit(None).cast("string"), F.coalesce(x["published"], x["updated"]))

    rows = F.coalesce(from_items(r), from_items(rdf), F.transform(atom, from_entry))
    usable = F.filter(rows, lambda p: p["title"].isNotNull() & F.coalesce(p["url"].rlike("^https?://[^/?#@]+(?:[/?#]|$)"), F.lit(False)))
    return F.coalesce(usable, F.expr(_NONE)), F.lit(False), body.rlike(r"<rss\b|<(?:rdf:)?RDF\b|<feed\b") & ~body.rlike(r"(?i)<!\s*(?:DOCTYPE|ENTITY)\b")


PROVIDERS: dict[str, Callable] = {
    "greenhouse": lambda b, u: greenhouse(b), "lever": lambda b, u: lever(b), "ashby": lambda b, u: ashby(b), "schema_org": lambda b, u: schema_org(b), "smartrecruiters": lambda b, u: smartrecruiters(b),
    "telekom": keyed_map, "personio": personio, "recruitee": recruitee, "rss": rss,
}


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """(feed_id, provider, postings, complete, error) of each feed; a failed feed has no postings and is not complete.

    One pass over the feeds: each row meets the parser of its provider only.
    """
    read = F.lit(None)
    for name, parse in PROVIDERS.items():
        rows, complete, ok = parse(F.col("body"), F.col("board_url"))
        own = F.struct(rows.cast(f"array<{POSTING}>").alias("rows"), F.coalesce(complete, F.lit(False)).alias("complete"), F.coalesce(ok, F.lit(False)).alias("ok"))
        read = F.when(F.col("provider") == name, own).otherwise(read)
    known = F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False))
    sound = F.forall(F.col("__r.rows"), lambda p: F.coalesce((p["title"] != "") & (p["external_id"] != "") & p["url"].rlike("^https?://"), F.lit(False)))
    valid = F.col("__r.ok") & F.coalesce(sound, F.lit(False))
    out = feeds.withColumn("__r", read).withColumn("__ok", F.coalesce(valid, F.lit(False)))
    error = F.when(~known, F.concat(F.lit("unsupported provider: "), "provider")).when(~F.col("__ok"), F.concat(F.lit("unexpected schema: "), "provider"))
    return out.select("feed_id", "provider", F.when(F.col("__ok"), F.col("__r.rows")).otherwise(F.expr(_NONE)).alias("postings"), (F.col("__ok") & F.coalesce("__r.complete", F.lit(False))).alias("complete"), error.alias("error"))


def postings(parsed: DataFrame) -> DataFrame:
    return parsed.select("feed_id", F.explode("postings").alias("p")).select("feed_id", "p.*")


def pages_complete(pages: DataFrame, *, feed: str, page: str, ids: str, total: str, page_size: int, cap: int) -> DataFrame:
    """(feed, rows, complete): all rows of a stable total, no id twice, no page short but the last, no more pages than the cap.

    pages: one row a posting of a page.
    """
    per = pages.groupBy(feed, page).agg(F.count("*").alias("n"))
    sizes = per.groupBy(feed).agg(F.max(page).alias("last"), F.count("*").alias("pages"), F.count_if((F.col("n") > page_size)).alias("over"))
    all_ = pages.groupBy(feed).agg(F.count("*").alias("rows"), F.countDistinct(ids).alias("ids"), F.min(total).alias("t0"), F.max(total).alias("t1"))
    ok = (F.col("rows") == F.col("ids")) & (F.col("t0") == F.col("t1")) & (F.col("rows") == F.col("t1")) & (F.col("over") == 0) & (F.col("pages") <= cap)
    return all_.join(sizes, feed).select(feed, "rows", F.coalesce(ok, F.lit(False)).alias("complete"))


def employment_service(rows: Column) -> Column:
    """A public employment service's JSON row to struct(external_id, title, company_name, company_source_id, url, locations, …); null if invalid."""
    loc = "adresse:struct<ort:string,plz:string,land:string>,ort:string,plz:string,land:string,breite:string,laenge:string,koordinaten:struct<lat:string,lon:string>"
    fields = f"referenznummer string, refnr string, stellenangebotsTitel string, titel string, firma string, arbeitgeber string, arbeitgeberKundennummerHash string, stellenlokationen array<struct<{loc}>>, arbeitsorte array<struct<{loc}>>, arbeitsort struct<{loc}>, homeofficemoeglich boolean, homeofficetyp string, homeofficeprozent double, festgehalt string, gehaltsspanneVon string, gehaltsspanneBis string, arbeitszeitVollzeit boolean, veroeffentlichungszeitraum struct<von:string,bis:string>, stellenangebotsBeschreibung string"
    from vacantia.functions import geo
    from vacantia.functions.strings import once

    def read(d: Column) -> Column:
        pick = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c])
        ref, title, firm = pick(d["referenznummer"], d["refnr"]), pick(d["stellenangebotsTitel"], d["titel"]), pick(d["firma"], d["arbeitgeber"])
        company = F.coalesce(F.concat(F.lit("hash:"), pick(d["arbeitgeberKundennummerHash"])), F.concat(F.lit("name:"), F.sha2(F.regexp_replace(F.lower(firm), r"\s+", " "), 256)))
        places = F.coalesce(F.when(F.size(d["stellenlokationen"]) > 0, d["stellenlokationen"]), F.when(F.size(d["arbeitsorte"]) > 0, d["arbeitsorte"]), F.when(d["arbeitsort"].isNotNull(), F.array(d["arbeitsort"])), F.array().cast(f"array<struct<{loc}>>"))

        def place(x: Column) -> Column:
            lat, lon = geo.coordinate(F.coalesce(x["breite"], x["koordinaten"]["lat"]), -90.0, 90.0), geo.coordinate(F.coalesce(x["laenge"], x["koordinaten"]["lon"]), -180.0, 180.0)
            both = lat.isNotNull() & lon.isNotNull()
            label = F.array_join(F.array_compact(F.array(pick(x["adresse"]["ort"], x["ort"]), pick(x["adresse"]["plz"], x["plz"]))), ", ")
            return F.struct(F.coalesce(F.nullif(label, F.lit("")), pick(x["adresse"]["land"], x["land"]), F.lit("Location unspecified")).alias("label"), F.when(both, lat).alias("latitude"), F.when(both, lon).alias("longitude"))

        remote = F.coalesce((d["homeofficetyp"] == "ANGABE_IN_PROZENT") & (d["homeofficeprozent"] == 100), F.lit(False))
        salary = F.nullif(F.array_join(F.array_compact(F.array(d["festgehalt"], d["gehaltsspanneVon"], d["gehaltsspanneBis"])), " – "), F.lit(""))
        out = F.struct(
            ref.alias("external_id"), title.alias("title"), firm.alias("company_name"), company.alias("company_source_id"), F.concat(F.lit("https://www.arbeitsagentur.de/jobsuche/jobdetail/"), F.url_encode(ref)).alias("url"),
            F.transform(places, place).alias("locations"), remote.alias("is_remote"), F.when(remote, "remote").when(d["homeofficemoeglich"], "hybrid").alias("work_arrangement"), F.when(d["arbeitszeitVollzeit"], "full_time").alias("employment_type"),
            d["veroeffentlichungszeitraum"]["von"].alias("date_posted"), d["veroeffentlichungszeitraum"]["bis"].alias("expires"), salary.alias("salary"), d["stellenangebotsBeschreibung"].alias("description"),
        )
        return F.when(ref.isNotNull() & title.isNotNull() & firm.isNotNull(), out)

    return once(F.from_json(rows, fields), read)


def search_rows(payload: Column) -> Column:
    """Rows (JSON texts) of a search page in any of its accepted envelopes."""
    d = F.from_json(payload, "jobs array<string>, ergebnisliste array<string>, stellenangebote array<string>")
    return F.coalesce(d["jobs"], d["ergebnisliste"], d["stellenangebote"])


def map_elements(elements: DataFrame, *, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Map-data elements (body JSON, seq) to candidates: named, placed, within the radius; the last of an id wins."""
    from vacantia.functions import geo
    from vacantia.operators.relational import best_per_group

    d = F.from_json("body", "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    e = elements.withColumn("d", d)
    tag = lambda k: F.try_element_at("d.tags", F.lit(k))
    y, x = F.when(F.col("d.type") == "node", F.col("d.lat")).otherwise(F.col("d.center.lat")), F.when(F.col("d.type") == "node", F.col("d.lon")).otherwise(F.col("d.center.lon"))
    rows = e.select("seq", F.concat_ws("/", "d.type", F.col("d.id").cast("string")).alias("source_id"), F.trim(tag("name")).alias("name"), F.coalesce(tag("website"), tag("contact:website")).alias("website_url"), F.coalesce(tag("office"), tag("craft"), tag("industrial")).alias("category"), geo.latitude(y).alias("latitude"), geo.longitude(x).alias("longitude"))
    kept = rows.filter((F.col("name") != "") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & geo.within_radius(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon), F.lit(radius_km)))
    return best_per_group(kept, ["source_id"], [F.col("seq").desc()]).drop("seq")


def state_tiles(boxes: DataFrame, *, size: float = 0.5) -> DataFrame:
    """(state, south, west, north, east) tiles of each state's box."""
    steps = lambda a, b: F.explode(F.sequence(F.lit(0), (F.ceil((F.col(b) - F.col(a)) / size) - 1).cast("int")))
    t = boxes.withColumn("i", steps("south", "north")).withColumn("j", steps("west", "east"))
    return t.select("state", (F.col("south") + F.col("i") * size).alias("south"), (F.col("west") + F.col("j") * size).alias("west"), F.least(F.col("south") + (F.col("i") + 1) * size, "north").alias("north"), F.least(F.col("west") + (F.col("j") + 1) * size, "east").alias("east"))


def merge_captures(captures: DataFrame) -> DataFrame:
    """The latest capture of each URL whose body has the stated SHA-256 (url, captured_at, sha256, body)."""
    ok = captures.filter(F.sha2("body", 256) == F.lower("sha256"))
    return ok.groupBy("url").agg(F.max_by(F.struct("captured_at", "sha256", "body"), F.col("captured_at")).alias("c")).select("url", "c.*")
