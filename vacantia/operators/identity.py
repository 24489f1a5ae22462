"""Which website, page or posting belongs to which employer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import strings, urls
from vacantia.operators.relational import greedy_one_to_one

# Mail services anyone can use, words that name no employer, suggestion sources by strength.
FREE_MAIL = ("gmail.com", "gmx.de", "gmx.net", "web.de", "t-online.de", "outlook.com", "hotmail.com", "yahoo.com", "yahoo.de", "icloud.com", "aol.com", "freenet.de")
COMMON_WORDS = ("gmbh", "ag", "kg", "ohg", "gbr", "ug", "se", "inc", "ltd", "llc", "mbh", "co", "und", "and", "der", "die", "das", "the", "group", "gruppe", "holding", "deutschland", "germany", "international", "services", "service")
STRENGTH = {"entity": 0, "brand": 1, "operator": 2, "osm_url_tag": 3, "osm_email_tag": 4}


def brand_tokens(name: Column) -> Column:
    """Distinct words of a name that can identify it."""
    words = F.split(strings.words_of(strings.fold(name)), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON_WORDS)))


def domain_tokens(url: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(urls.domain_key(url), r"\.[a-z]+$", ""), "[^a-z0-9]+"), lambda w: w != "")


def identity_score(name: Column, url: Column) -> Column:
    """Name words that stand in the domain, as a part of the smaller set; a word inside the joined domain counts."""
    brand, dom = brand_tokens(name), domain_tokens(url)
    joined = F.array_join(dom, "")
    hits = F.size(F.filter(brand, lambda w: F.contains(joined, w)))
    n = F.least(F.size(brand), F.size(dom))
    return F.when(n > 0, F.least(F.lit(1.0), hits / n)).otherwise(F.lit(0.0))


def suggest_from_claims(candidates: DataFrame, references: DataFrame, claims: DataFrame) -> DataFrame:
    """Website suggestions of candidates without one, through their tags' references to entities with website claims.

    candidates: source_id, name, website.  references: source_id, relation, entity_id.  claims: entity_id, entity_name, website_url, claim_rank, deprecated.
    """
    mapped = candidates.select(urls.domain_key(F.col("website")).alias("d")).filter("d is not null").distinct().withColumn("mapped", F.lit(True))
    open_ = candidates.filter(F.coalesce(F.trim("website"), F.lit("")) == "").drop("website")
    j = open_.join(references, "source_id").join(claims, "entity_id").withColumn("d", urls.domain_key(F.col("website_url"))).join(mapped, "d", "left")
    score = F.greatest(identity_score(F.col("name"), F.col("website_url")), strings.token_overlap(brand_tokens(F.col("name")), brand_tokens(F.col("entity_name"))))
    j = j.withColumn("identity_score", F.round(score, 3))
    fits = (F.col("relation") == "entity") | (F.col("identity_score") >= 0.5)
    why = F.when(F.col("mapped"), F.when(F.col("relation") == "operator", "operator_domain_already_mapped").otherwise("website_domain_already_mapped")).when(F.col("deprecated"), "claim_is_deprecated").when(~fits, "name_does_not_match")
    return j.select("source_id", "name", "entity_id", "relation", "website_url", "claim_rank", "identity_score", why.isNull().alias("eligible"), why.alias("ineligible_reason"))


def suggest_from_emails(candidates: DataFrame, verified: DataFrame) -> DataFrame:
    """Suggestions from mail domains: first reason of free provider, mapped, not identifying (below 0.8), not verified.

    candidates: source_id, name, website, email.  verified: source_id, domain.
    """
    mapped = candidates.select(urls.domain_key(F.col("website")).alias("domain")).filter("domain is not null").distinct().withColumn("mapped", F.lit(True))
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("email", F.lit("")), F.lit(r"[\w.+-]+@([\w-]+(?:\.[\w-]+)+)"), F.lit(1)), F.lower))
    rows = candidates.filter(F.coalesce(F.trim("website"), F.lit("")) == "").withColumn("domain", F.explode(found)).withColumn("domain", F.regexp_replace("domain", r"^www\.", ""))
    j = rows.join(mapped, "domain", "left").join(verified.select("source_id", "domain").distinct().withColumn("ok", F.lit(True)), ["source_id", "domain"], "left")
    url = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))
    j = j.withColumn("website_url", url).withColumn("identity_score", F.round(identity_score(F.col("name"), url), 3))
    why = F.when(F.col("domain").isin(*FREE_MAIL), "free_email_provider").when(F.col("mapped"), "website_domain_already_mapped").when(F.col("identity_score") < 0.8, "email_domain_does_not_identify_candidate").when(F.col("ok").isNull(), "email_domain_identity_not_verified")
    return j.select("source_id", "name", F.lit("osm_email_tag").alias("relation"), "website_url", "identity_score", why.isNull().alias("eligible"), why.alias("ineligible_reason"))


def select_websites(suggestions: DataFrame) -> DataFrame:
    """At most one eligible website a source and one source a domain, in order of evidence."""
    table = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    h = urls.host(F.col("website_url"))
    locale = F.when(h.endswith(".de"), 0).when(h.rlike(r"\.(?:com|org|eu)$"), 1).otherwise(2)
    rows = suggestions.filter("eligible and website_url is not null").withColumn("domain", urls.domain_key(F.col("website_url"))).withColumn("p", F.coalesce(F.try_element_at(table, F.col("relation")), F.lit(9))).withColumn("q", -F.col("identity_score")).withColumn("l", locale)
    return greedy_one_to_one(rows, "source_id", "domain", ["p", "q", "source_id", "l", "website_url"]).drop("p", "q", "l")


def contact_matches(candidate_address: Column, page_text: Column, emails: Column, phones: Column) -> Column:
    """Address words all on the page, or a shared mail address, or a shared phone number."""
    words = F.split(strings.words_of(strings.fold(page_text)), " ")
    address = F.filter(F.split(strings.words_of(strings.fold(candidate_address)), " "), lambda w: w != "")
    at = (F.size(address) > 0) & (F.size(F.array_except(address, words)) == 0)
    page_mail = F.transform(F.regexp_extract_all(page_text, F.lit(r"([\w.+-]+@[\w.-]+\.[a-zA-Z]{2,})"), F.lit(1)), F.lower)
    page_phone = F.transform(F.regexp_extract_all(page_text, F.lit(r"(?<!\w)((?:\+\s*)?\d[\d ()/.-]{5,}\d)(?!\w)"), F.lit(1)), strings.phone_key)
    own_phone = F.filter(F.transform(phones, strings.phone_key), lambda p: p.isNotNull())
    yes = lambda x: F.coalesce(x, F.lit(False))
    return yes(at) | yes(F.arrays_overlap(page_mail, F.transform(emails, F.lower))) | yes(F.arrays_overlap(page_phone, own_phone))


PARKED = r"(?i)\b(?:domain (?:is )?for sale|buy this domain|domain steht zum verkauf|domain[- ]?parking)\b"
DIRECTORY = r"(?i)\b(?:branchenbuch|business directory|gelbe seiten|yellow pages|firmenverzeichnis)\b"


def is_parked(text: Column, n_links: Column) -> Column:
    return F.coalesce(text.rlike(PARKED), F.lit(False)) & (F.coalesce(n_links, F.lit(0)) == 0)


def accepts_lead(name: Column, url: Column, text: Column, headings: Column, contact: Column) -> Column:
    """A page is the employer's: all its name's words there, its brand in domain and headings, a contact shared, neither parked nor a directory."""
    brand, words = brand_tokens(name), F.split(strings.words_of(strings.fold(text)), " ")
    head = F.split(strings.words_of(strings.fold(headings)), " ")
    return (F.size(brand) > 0) & (F.size(F.array_except(brand, words)) == 0) & F.arrays_overlap(brand, head) & (identity_score(name, url) > 0) & contact & ~text.rlike(PARKED) & ~text.rlike(DIRECTORY)


def queries_for(name: Column, city: Column, phone: Column) -> Column:
    """Search phrases by stage: exact, contact, official."""
    q = F.concat(F.lit('"'), name, F.lit('"'))
    return F.filter(F.array(F.concat_ws(" ", q, city), F.when(phone.isNotNull(), F.concat_ws(" ", q, phone)), F.concat_ws(" ", name, city, F.lit("official website"))), lambda x: x.isNotNull())


def row_trust(seed_url: Column, seed_name: Column, page_url: Column, parent_url: Column, page_title: Column) -> Column:
    """first_party, branded_external, linked_external or unverified_external_source."""
    same = lambda u: F.coalesce(urls.employer_domain(u) == urls.employer_domain(seed_url), F.lit(False))
    brand = brand_tokens(seed_name)
    seen = F.split(strings.words_of(strings.fold(F.concat_ws(" ", page_title, page_url))), " ")
    return F.when(same(page_url), "first_party").when(same(parent_url) & F.coalesce(F.arrays_overlap(brand, seen), F.lit(False)), "branded_external").when(same(parent_url), "linked_external").otherwise("unverified_external_source")


def link_score(base: Column, path: Column, branded: Column) -> Column:
    """+20 for the employer's own host, +20 for a posting's page, else +8 for a list of postings."""
    detail = path.rlike(r"(?i)/(?:jobs?|stellen(?:angebote?)?|vacanc(?:y|ies)|positions?)/[^/]+")
    listing = path.rlike(r"(?i)/(?:jobs?|stellen(?:angebote?)?|karriere|careers?|vacancies)/?$")
    return base + F.when(branded, 20).otherwise(0) + F.when(detail, 20).when(listing, 8).otherwise(0)


def best_links(links: DataFrame, page: str, *, most: int = 24, least: int = 70) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.col("score").desc(), F.length("url"), "url"))
    return links.filter(F.col("score") >= least).withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")


def sitemap_links(locations: Column, sitemap_url: Column, is_index: Column) -> Column:
    """Career links of a sitemap (of an index, its first two entries if none), on the same host, at most four."""
    career = F.filter(locations, lambda u: u.rlike("(?i)career|karriere|jobs?|stellen|vacanc"))
    chosen = F.when(is_index & (F.size(career) == 0), F.slice(locations, 1, 2)).otherwise(career)
    return F.filter(F.slice(chosen, 1, 4), lambda u: urls.host(u) == urls.host(sitemap_url))


def employees_on_page(text: Column) -> Column:
    """A stated number of employees, unless customers or partners are counted."""
    pattern = r"(?i)(?<![\d.,])([1-9]\d{0,2}(?:[., ]\d{3})+|[1-9]\d*)\s*\+?\s*(?:Mitarbeit(?:er(?:innen)?|ende(?:n)?)|Beschäftigte(?:n)?|employees)\b"
    at = F.regexp_instr(text, F.lit(pattern))
    before = F.substring(text, F.greatest(at - 160, F.lit(1)), F.least(at - 1, F.lit(160)))
    return F.when((at > 0) & ~before.rlike(r"(?i)\b(?:Kunden?|customers?|clients?|Partner(?:n)?|participants?|Teilnehmer)\b"), strings.employee_count(F.regexp_extract(text, pattern, 1)))


def hydrate_details(stubs: DataFrame, details: DataFrame) -> DataFrame:
    """Descriptions for postings without one, where exactly one detail has the same canonical URL and title identity.

    stubs: job_id, url, title.  details: url, title, description.
    """
    key = [urls.canonical_url(F.col("url")).alias("u"), F.lower(strings.title_identity(F.col("title"))).alias("t")]
    one = details.select(*key, "description").groupBy("u", "t").agg(F.count("*").alias("n"), F.first("description").alias("description")).filter("n = 1").drop("n")
    return stubs.select("job_id", *key).join(one, ["u", "t"], "left").select("job_id", "description")


def resolve_municipalities(labels: DataFrame, aliases: DataFrame, *, words: int = 4) -> DataFrame:
    """(label, code) where the label's word runs name exactly one municipality.  aliases: alias (normalised), code."""
    w = F.filter(F.split(strings.words_of(strings.fold(F.col("label"))), " "), lambda x: x != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(words)), lambda n: F.array_join(F.slice(F.col("w"), i, n), " "))))
    spread = labels.select("label").distinct().withColumn("w", w).filter(F.size("w") > 0).select("label", F.explode(F.array_distinct(runs)).alias("alias"))
    hit = spread.join(aliases, "alias").groupBy("label").agg(F.min("code").alias("code"), F.max("code").alias("other"))
    return hit.filter("code = other").select("label", "code")
