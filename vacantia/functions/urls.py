"""URLs: canonical forms, domain keys, provider rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track (besides utm_*), fragments that only scroll, paths that name no posting, keys that do (fixed values).
TRACKING = ("gh_src", "gclid", "fbclid", "msclkid", "trk")
SCROLL = ("top", "jobs", "careers", "main", "content")
GENERIC = (
    "", "jobs", "job", "careers", "career", "stellenangebote", "stellen", "vacancies", "openings", "positions", "open-positions", "job-openings", "all-jobs", "join-us",
    "careers.html", "career.html", "jobs.html", "index.html", "index.php",
)
IDENTITY = (
    "id", "ref", "jobid", "job_id", "job-id", "gh_jid", "gh_job", "jid", "requisitionid", "requisition_id", "reqid", "req_id", "vacancyid", "vacancy_id", "positionid", "position_id",
    "reference", "referenznummer",
)
_PARTS = r"^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def host(url: Column) -> Column:
    """Lower-case host without user or port; null without one."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def domain_key(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def employer_domain(url: Column) -> Column:
    """The domain key without a leading careers subdomain."""
    return F.regexp_replace(domain_key(url), r"^(?:careers?|jobs?|karriere|stellen)\.(?=[^.]+\.)", "")


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, tracking keys dropped, the query sorted; null if not a URL or if it names no one posting."""
    u = F.regexp_replace(url, r"^([A-Za-z]+)(?=://)", "$1")
    part = lambda k: F.regexp_extract(u, "(?i)" + _PARTS, k)
    path = F.regexp_replace(part(3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.filter(F.split(part(4), "&"), lambda p: p != "")
    key = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.array_sort(F.filter(pairs, lambda p: ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING)))
    fragment = F.when(F.lower(part(5)).isin(*SCROLL), "").otherwise(part(5))
    identified = F.exists(kept, lambda p: key(p).isin(*IDENTITY) & (F.trim(F.split_part(p, F.lit("="), F.lit(2))) != ""))
    last = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    built = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when(part(1) != "", F.when(~(last.isin(*GENERIC) & ~identified & (fragment == "")), built))


def host_suffixes(h: Column) -> Column:
    """a.b.c, b.c, c."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


#: Provider, host pattern, tenant group (0: first path part, 1: first host label).
PROVIDERS = (
    ("greenhouse", r"^(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io$", 0),
    ("lever", r"^jobs(?:\.eu)?\.lever\.co$", 0),
    ("personio", r"^[\w-]+\.jobs\.personio\.(?:de|com)$", 1),
    ("ashby", r"^jobs\.ashbyhq\.com$", 0),
    ("recruitee", r"^[a-z0-9-]+\.recruitee\.com$", 1),
    ("smartrecruiters", r"^(?:jobs|careers)\.smartrecruiters\.com$", 0),
    ("workday", r"^[\w-]+\.wd[0-9]+\.myworkdayjobs\.com$", 1),
    ("softgarden", r"^(?!certificate\.)[\w-]+\.softgarden\.(?:io|de)$", 1),
    ("onlyfy", r"^[\w-]+\.onlyfy\.jobs$", 1),
)


def identify_provider(url: Column, extra: tuple = ()) -> Column:
    """struct(provider, tenant) of a posting system's URL, or null; static files are none."""
    h, path = host(url), F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1)
    first = F.regexp_extract(path, "^/*([^/]+)", 1)
    out = F.lit(None).cast("struct<provider:string,tenant:string>")
    for name, pattern, place in reversed((*PROVIDERS, *extra)):
        tenant = F.split_part(h, F.lit("."), F.lit(1)) if place else first
        fits = h.rlike(pattern) & (tenant != "")
        out = F.when(fits, F.struct(F.lit(name).alias("provider"), tenant.alias("tenant"))).otherwise(out)
    return F.when(~path.rlike(r"(?i)\.(?:js|css|png|jpg|svg|woff2?)$"), out)
