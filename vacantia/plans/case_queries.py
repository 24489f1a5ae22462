"""Scope, suggestions and assessments over rows of customers that differ by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators import identity, profiles, scope
from vacantia.plans.catalog import Tables, query

c = F.col


def area_rows(t: Tables, *more: Column) -> DataFrame:
    k = c("c_custkey") % 8
    spot = lambda label, code=None, lat=None, lon=None: F.array(F.struct(F.lit(label).alias("label"), F.lit(code).cast("string").alias("country_code"), F.lit(lat).cast("double").alias("latitude"), F.lit(lon).cast("double").alias("longitude")))
    return t.customer.select(
        "c_custkey", F.when(k == 0, "2020-01-01").alias("valid_through"), F.when(k.isin(1, 2, 3), "remote").alias("work_arrangement"), F.lit(None).cast("boolean").alias("is_remote"),
        F.when(k == 1, F.array(F.lit("FR"))).when(k == 2, F.array(F.lit("DE"))).alias("remote_countries"), F.lit(False).alias("remote_unresolved"),
        F.when(k == 4, spot("Bonn")).when(k == 5, spot("Ulm", "DE", 50.73, 7.1)).when(k == 6, spot("Ulm", "DE", 48.4, 10.0)).when(k == 7, spot("Ulm")).otherwise(spot("Bonn")).alias("locations"), *more,
    )


def area(**more) -> dict:
    """Around Bonn, at the start of 2024."""
    return {"now": F.lit("2024-01-01").cast("timestamp"), "lat": 50.73, "lon": 7.1, "radius_km": 25.0, "place": "Bonn", "country": "DE", **more}


def _classified(t: Tables, **more) -> DataFrame:
    return scope.classify(area_rows(t), **area(**more))


@query("""SELECT c_custkey, c_custkey % 8 IN (2, 3, 4, 5) AS eligible, CASE c_custkey % 8 WHEN 0 THEN 'expired' WHEN 1 THEN 'remote_country' WHEN 6 THEN 'outside_area' WHEN 7 THEN 'outside_area' END AS reason, CASE WHEN c_custkey % 8 IN (1, 2, 3) THEN 'remote' WHEN c_custkey % 8 IN (4, 5) THEN 'in_area' END AS match_kind,
CASE WHEN c_custkey % 8 = 3 THEN 1 ELSE 0 END AS unknowns FROM customer""")
def fil15_fil17_classify(t: Tables):
    return _classified(t).select("c_custkey", "scope.eligible", "scope.reason", "scope.match_kind", F.size("scope.unknowns").alias("unknowns"))


@query("SELECT r AS reason, count(*)::BIGINT AS n FROM (SELECT CASE c_custkey % 8 WHEN 0 THEN 'expired' WHEN 1 THEN 'remote_country' WHEN 2 THEN 'remote_not_selected' WHEN 3 THEN 'remote_not_selected' WHEN 6 THEN 'outside_area' WHEN 7 THEN 'outside_area' END AS r FROM customer) WHERE r IS NOT NULL GROUP BY 1")
def fil20_rejected_by_reason(t: Tables):
    return scope.rejected_by_reason(_classified(t, selection="area"))


@query("""SELECT c_custkey AS source_id, CASE c_custkey % 4 WHEN 0 THEN true ELSE false END AS eligible, CASE c_custkey % 4 WHEN 1 THEN 'free_email_provider' WHEN 2 THEN 'email_domain_does_not_identify_candidate' WHEN 3 THEN 'email_domain_identity_not_verified' END AS ineligible_reason FROM customer WHERE c_custkey > 0""")
def ot18_suggest_from_emails(t: Tables):
    k, n = c("c_custkey") % 4, c("c_custkey").cast("string")
    domain = F.when(k == 1, F.lit("gmail.com")).when(k == 2, F.lit("other.de")).otherwise(F.concat(F.lit("firm"), n, F.lit(".de")))
    rows = t.customer.filter("c_custkey > 0").select(c("c_custkey").alias("source_id"), F.concat(F.lit("Firm"), n, F.lit(" GmbH")).alias("name"), F.lit("").alias("website"), F.concat(F.lit("info@"), domain).alias("email"))
    verified = t.customer.filter(k == 0).select(c("c_custkey").alias("source_id"), F.concat(F.lit("firm"), n, F.lit(".de")).alias("domain"))
    return identity.suggest_from_emails(rows, verified).select("source_id", "eligible", "ineligible_reason")


@query("""SELECT c_custkey AS source_id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'name_does_not_match' ELSE 'claim_is_deprecated' END AS ineligible_reason FROM customer WHERE c_custkey > 0""")
def jn19_suggest_from_claims(t: Tables):
    k, n = c("c_custkey"), c("c_custkey").cast("string")
    rows = t.customer.filter("c_custkey > 0")
    candidates = rows.select(k.alias("source_id"), F.concat(F.lit("Firm"), n).alias("name"), F.lit(None).cast("string").alias("website"))
    references = rows.select(k.alias("source_id"), F.lit("brand").alias("relation"), n.alias("entity_id"))
    claims = rows.select(n.alias("entity_id"), F.lit("Entity").alias("entity_name"), F.concat(F.lit("https://"), F.when(k % 3 == 1, "other").otherwise("firm"), n, F.lit(".de")).alias("website_url"), F.lit(1).alias("claim_rank"), (k % 3 == 2).alias("deprecated"))
    return identity.suggest_from_claims(candidates, references, claims).select("source_id", "ineligible_reason")


@query("""SELECT 's' || (c_custkey // 2) AS source_id, 'https://d' || (c_custkey // 2) || '.de' AS website_url FROM customer WHERE c_custkey % 2 = 0""")
def ot05_select_websites(t: Tables):
    """Two suggestions a source: the operator's domain loses to the entity's, and the second source of a domain gets none."""
    half = F.floor(c("c_custkey") / 2).cast("string")
    even = c("c_custkey") % 2 == 0
    rows = t.customer.select(F.concat(F.lit("s"), half).alias("source_id"), F.concat(F.when(even, "https://d").otherwise("https://e"), half, F.lit(".de")).alias("website_url"), F.when(even, "entity").otherwise("operator").alias("relation"), F.lit(1.0).alias("identity_score"), F.lit(True).alias("eligible"))
    return identity.select_websites(rows).select("source_id", "website_url")


@query("""SELECT c_custkey AS profile, c_nationkey AS job, CASE WHEN c_custkey % 4 = 0 THEN 70 WHEN c_custkey % 4 = 1 THEN 80 END AS score, c_custkey % 4 < 2 AS valid FROM customer""")
def mt10_validate_assessments(t: Tables):
    k = c("c_custkey") % 4
    dims = lambda a, b: F.to_json(F.struct(F.struct(F.struct(F.lit(a).cast("double").alias("score")).alias("skills"), F.struct(F.lit(b).cast("double").alias("score")).alias("tasks")).alias("dimensions"), F.struct(F.struct(F.when(k == 3, "maybe").otherwise("pass").alias("status")).alias("language")).alias("gates")))
    text = F.when(k == 0, dims(80, 60)).when(k == 1, dims(80, None)).when(k == 2, dims(180, 60)).otherwise(dims(80, 60))
    text = F.when(k == 1, F.lit('{"dimensions": {"skills": {"score": 80}, "tasks": {}}, "gates": {"language": {"status": "pass"}}}')).otherwise(text)
    rows = t.customer.select(c("c_custkey").alias("profile"), c("c_nationkey").alias("job"), text.alias("assessment"))
    return profiles.validate_assessments(rows, {"skills": 1.0, "tasks": 1.0})
