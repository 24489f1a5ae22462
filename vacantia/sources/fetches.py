"""Outcomes of requests over a table of captured responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Redirecting status codes, and responses read for one request (fixed values).
REDIRECTS = (301, 302, 303, 307, 308)
MOST = 6


def resolved(base: Column, location: Column) -> Column:
    """``location`` as an absolute URL: absolute, without scheme, from the root, or beside the last part of ``base``'s path."""
    origin = F.regexp_extract(base, "^[^:/?#]+://[^/?#]*", 0)
    place = F.regexp_extract(base, "^[^?#]*", 0)
    beside = F.when(F.length(place) > F.length(origin), F.regexp_extract(place, "^(.*/)", 1)).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(location.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), location)
        .when(location.startswith("//"), F.concat(F.regexp_extract(base, "^[^:/?#]+:", 0), location))
        .when(location.startswith("/"), F.concat(origin, location))
        .when(location.startswith("?"), F.concat(place, location))
        .otherwise(F.concat(beside, location))
    )


def outcomes(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(url, state, final_url, n_read) of each distinct request, following redirects over at most ``MOST`` responses.

    responses: url (one row each), status, location, challenge boolean.  States: ``fetched``; ``bot_challenge``; ``not_captured`` (a URL
    on the way has no response); ``redirect_limit`` (no final URL).  One join a step; requests that have ended get a key of
    their own there, so they neither match nor gather.
    """
    r = responses.select(F.col("url").alias("r_url"), "status", "location", F.coalesce("challenge", F.lit(False)).alias("challenge"), F.lit(True).alias("found"))
    rows = requests.select("url").filter("url is not null").distinct().withColumns({"at": F.col("url"), "state": F.lit(None).cast("string"), "n_read": F.lit(0)})
    for _ in range(MOST):
        key = F.when(F.col("state").isNull(), F.col("at")).otherwise(F.concat(F.lit("ended "), F.col("url")))
        j = rows.withColumn("key", key).join(r, F.col("key") == F.col("r_url"), "left")
        going = F.col("state").isNull()
        onward = F.coalesce(F.col("status").isin(*REDIRECTS) & (F.col("location") != ""), F.lit(False))
        state = F.when(~going, F.col("state")).when(F.col("found").isNull(), "not_captured").when(F.col("challenge"), "bot_challenge").when(~onward, "fetched")
        step = F.when(going & F.col("found").isNotNull() & ~F.col("challenge") & onward, resolved(F.col("at"), F.col("location"))).otherwise(F.col("at"))
        rows = j.select("url", step.alias("at"), state.alias("state"), (F.col("n_read") + (going & F.col("found").isNotNull()).cast("int")).alias("n_read"))
    return rows.select("url", F.coalesce("state", F.lit("redirect_limit")).alias("state"), F.when(F.col("state").isNotNull(), F.col("at")).alias("final_url"), "n_read")
