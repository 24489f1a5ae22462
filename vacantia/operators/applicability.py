"""Whether a profile may take a posting at all: three-valued gates over conditions as rows.

``job_conditions`` reads a posting's required members (``functions.modality``) for licences, work authorisation, residence and
tenure.  ``condition_rows`` holds each against a profile's saved facts: ``pass`` and ``fail`` need a fact that says so, everything
else is ``unknown``.  Alternatives (*or*) form a group that its best member decides; ``gates`` takes the worst group of each gate.
``reconcile`` turns unknown conditions into passed ones where an assessment cites evidence that stands in the profile.

All steps are joins and aggregates over pairs that the caller chooses; nothing meets every profile with every posting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import requirements as R
from vacantia.operators.relational import once_per_value

# Wording of conditions, number words, and words that are no scope of a tenure.
LICENCES = r"approbation|berufszulassung|staplerschein|fahrerlaubnis|führerschein|(?:driving|driver's|forklift|professional|medical|pharmacist|nursing) licen[cs]e"
AUTHORISATIONS = r"work (?:authori[sz]ation|permits?|rights?)|rights? to work|arbeitserlaubnis|arbeitsberechtigung"
RESIDENCES = r"(?:reside|live|resident|residence|residency|based|wohnsitz|wohnhaft) in"
NUMBERS = {"one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "ein": 1.0, "zwei": 2.0, "drei": 3.0, "vier": 4.0, "fünf": 5.0, "sechs": 6.0}
NO_SCOPE = r"(?i)\b(?:at least|of|in|with|as|mit|als|experience|erfahrung|berufserfahrung|professional|work|working|relevant|is|are|ist|sind|required|mandatory|necessary|needed|erforderlich|notwendig)\b|[.,;:+]"
DENIED = r"(?i)\b(?:not|never|no|expired|revoked|without|incomplete|kein\w*|nicht|ohne|abgelaufen)\b"
#: The gate that a kind of condition belongs to, and the category an assessment files it under.
GATES = {"licence": "eligibility", "authorisation": "eligibility", "tenure": "eligibility", "residence": "location"}
CATEGORIES = {"licence": "credential", "authorisation": "authorization", "tenure": "experience", "residence": "residence"}

_TENURE = r"(?i)(\d{1,2}(?:[.,]\d)?|" + "|".join(NUMBERS) + r")\+?\s+(years?|months?|jahren?|jahre|monaten?|monate)\b(.*)"


def _flat(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def job_conditions(jobs: DataFrame, *, text: str = "description") -> DataFrame:
    """(job_id, condition, group, kind, quote, minimum_years, scope): what a posting requires, by its own words.

    Sentences under headings of benefits or options, and members that are optional or waived, require nothing.  Members that *or* joins share a ``group``.
    A tenure's ``scope`` is what its years are asked in, null if in nothing particular.
    """
    read = once_per_value(jobs.select("job_id", text), [text], __rows=R.placed(F.col(text)))
    rows = read.select("job_id", F.posexplode("__rows").alias("place", "r")).filter(~F.col("r.scope").isin("benefits", "optional"))
    parts = rows.select("job_id", "place", "r.sentence", F.posexplode("r.parts").alias("member", "m"))
    piece = F.substring(F.col("sentence"), F.col("m.s") + 1, F.col("m.e") - F.col("m.s"))
    parts = parts.withColumn("piece", piece).withColumn("either", F.col("piece").rlike(r"(?i)^(?:or|oder)\b"))
    order = Window.partitionBy("job_id", "place").orderBy("member")
    parts = parts.withColumn("group", F.sum((~F.col("either")).cast("int")).over(order)).filter(F.col("m.modality") == "required")
    quote = F.trim(F.regexp_replace("piece", r"(?i)^(?:[;,\n]|and\b|und\b|or\b|oder\b|but\b|aber\b|sowie\b)\s*", ""))
    kinds = {"licence": LICENCES, "authorisation": AUTHORISATIONS, "residence": RESIDENCES}
    found = [F.when(quote.rlike(rf"(?i)\b(?:{p})"), F.lit(k)) for k, p in kinds.items()] + [F.when(quote.rlike(_TENURE), F.lit("tenure"))]
    parts = parts.select("job_id", F.concat_ws("/", "place", "group").alias("group"), F.concat_ws("/", "place", "member").alias("condition"), quote.alias("quote"), F.explode(F.array_compact(F.array(*found))).alias("kind"))
    number, unit, rest = (F.regexp_extract("quote", _TENURE, k) for k in (1, 2, 3))
    words = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    count = F.coalesce(F.regexp_replace(number, ",", ".").try_cast("double"), F.try_element_at(words, F.lower(number)))
    years = F.when(F.lower(unit).rlike("^mon"), F.round(count / 12, 2)).otherwise(count)
    scope = _flat(F.regexp_replace(rest, NO_SCOPE, " "))
    tenure = F.col("kind") == "tenure"
    return parts.select("job_id", "condition", "group", "kind", "quote", F.when(tenure, years).alias("minimum_years"), F.when(tenure & (scope != ""), scope).alias("scope"))


def tenure_years(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, years): the length of the union of (start, end) dates, to a hundredth, so that overlapping jobs count once; open or reversed spans count nothing."""
    order = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") > F.col("start"))).withColumn("upto", F.max("end").over(order))
    days = F.greatest(F.lit(0), F.datediff("end", F.greatest("start", F.coalesce("upto", "start"))))
    return rows.groupBy(*keys).agg(F.round(F.sum(days) / 365.25, 2).alias("years"))


def condition_rows(pairs: DataFrame, conditions: DataFrame, profiles: DataFrame, credentials: DataFrame, tenures: DataFrame, as_of: Column) -> DataFrame:
    """(job_id, profile_id, condition, group, gate, kind, quote, minimum_years, scope, status, evidence_source, evidence_quote).

    profiles: profile_id, city, country, relocates, authorised_in, authorised, sponsorship, experience_years.  credentials: profile_id, name, valid_to.
    tenures: profile_id, topic, start, end (null: ``as_of``), kind; academic ones are no tenure.  Any of a profile's facts may be null or missing.

    A licence passes by a valid credential that names it; authorisation by a permission of the country named (a denied one fails); residence by the city or
    country named (one elsewhere, without relocating, fails); a scoped tenure by the union of dated spans whose topic the scope names, and it fails
    only if the years in all are fewer; an unscoped one is held against the years in all.
    """
    named = lambda text, name: (F.length(F.trim(name)) > 1) & (F.instr(F.concat(F.lit(" "), F.regexp_replace(_flat(text), r"[^\p{L}\p{N}/]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(_flat(name), r"[^\p{L}\p{N}/]+", " "), F.lit(" "))) > 0)
    key = ["job_id", "profile_id", "condition", "kind"]
    asked = pairs.join(conditions, "job_id")
    held = asked.filter("kind = 'licence'").join(credentials.withColumnRenamed("name", "credential"), "profile_id")
    held = held.filter((named(F.col("quote"), F.col("credential")) | named(F.col("credential"), F.regexp_extract(F.lower("quote"), f"({LICENCES})", 1))) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)))
    held = held.groupBy(*key).agg(F.min("credential").alias("credential"))
    spans = asked.filter("kind = 'tenure' and scope is not null").join(tenures.withColumnRenamed("kind", "setting"), "profile_id").filter((F.col("setting") == "professional") & (named(F.col("scope"), F.col("topic"))))
    spent = tenure_years(spans.select(*key, "start", F.coalesce("end", as_of.cast("date")).alias("end")), key)
    rows = asked.join(held, key, "left").join(spent, key, "left").join(profiles, "profile_id", "left")
    kind = F.col("kind")
    licensed, country = F.col("credential").isNotNull(), named(F.col("quote"), F.col("authorised_in"))
    here = named(F.col("quote"), F.col("city")) | named(F.col("quote"), F.col("country"))
    lived = F.col("city").isNotNull() | F.col("country").isNotNull()
    short = F.col("experience_years") < F.col("minimum_years")
    verdict = lambda ok, bad: F.when(F.coalesce(ok, F.lit(False)), "pass").when(F.coalesce(bad, F.lit(False)), "fail").otherwise("unknown")
    status = (
        F.when(kind == "licence", verdict(licensed, F.lit(False)))
        .when(kind == "authorisation", verdict(country & F.col("authorised") & ~F.col("sponsorship"), country & ~F.col("authorised")))
        .when(kind == "residence", verdict(here, lived & ~F.coalesce(here, F.lit(False)) & ~F.col("relocates")))
        .when(F.col("scope").isNull(), verdict(F.col("experience_years") >= F.col("minimum_years"), short))
        .otherwise(verdict(F.col("years") >= F.col("minimum_years"), short))
    )
    source = F.when(kind == "licence", "profile.credentials").when(kind == "authorisation", "profile.authorised_in").when(kind == "residence", "profile.residence").when(F.col("scope").isNotNull() & (F.col("status") == "pass"), "profile.tenures").otherwise("profile.experience_years")
    cited = F.when(kind == "licence", F.col("credential")).when(kind == "authorisation", F.col("authorised_in")).when(kind == "residence", F.concat_ws(", ", "city", "country")).when(F.col("scope").isNotNull() & (F.col("status") == "pass"), F.round("years", 2).cast("string")).otherwise(F.col("experience_years").cast("string"))
    gate = F.create_map(*[F.lit(x) for pair in GATES.items() for x in pair])[kind]
    rows = rows.withColumn("status", status)
    known = F.col("status") != "unknown"
    return rows.select("job_id", "profile_id", "condition", "group", gate.alias("gate"), "kind", "quote", "minimum_years", "scope", "status", F.when(known, source).alias("evidence_source"), F.when(known, cited).alias("evidence_quote"))


def gates(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(job_id, profile_id, eligibility, location): the worst group of each gate, a group being as good as its best condition; nothing asked is ``pass``."""
    rank = F.when(F.col("status") == "pass", 0).when(F.col("status") == "unknown", 1).otherwise(2)
    groups = rows.groupBy("job_id", "profile_id", "gate", "group").agg(F.min(rank).alias("rank"))
    worst = groups.groupBy("job_id", "profile_id").agg(*[F.max(F.when(F.col("gate") == g, F.col("rank"))).alias(g) for g in ("eligibility", "location")])
    word = lambda c: F.element_at(F.array(F.lit("pass"), F.lit("unknown"), F.lit("fail")), F.coalesce(F.col(c), F.lit(0)) + 1).alias(c)
    return pairs.join(worst, ["job_id", "profile_id"], "left").select("job_id", "profile_id", word("eligibility"), word("location"))


def verdicts(rows: DataFrame) -> DataFrame:
    """(job_id, profile_id, eligibility, location, failed, open, short, unproven) of pairs with conditions, for ``profiles.match``.

    failed and open are the quotes of the groups that failed or are unknown, sorted; short says that a tenure failed, unproven that one is unknown.
    """
    rank = F.when(F.col("status") == "pass", 0).when(F.col("status") == "unknown", 1).otherwise(2)
    groups = rows.groupBy("job_id", "profile_id", "gate", "group").agg(F.min(rank).alias("rank"), F.array_join(F.sort_array(F.collect_set("quote")), " / ").alias("quotes"), F.bool_or(F.col("kind") == "tenure").alias("tenure"))
    r = F.col("rank")
    status = lambda gate: F.element_at(F.array(F.lit("pass"), F.lit("unknown"), F.lit("fail")), F.coalesce(F.max(F.when(F.col("gate") == gate, r)), F.lit(0)) + 1).alias(gate)
    quotes = lambda k, name: F.sort_array(F.collect_set(F.when(r == k, F.col("quotes")))).alias(name)
    return groups.groupBy("job_id", "profile_id").agg(
        status("eligibility"), status("location"), quotes(2, "failed"), quotes(1, "open"), F.bool_or(F.col("tenure") & (r == 2)).alias("short"), F.bool_or(F.col("tenure") & (r == 1)).alias("unproven")
    )


def reconcile(rows: DataFrame, assessed: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with unknown conditions passed where an assessment supports them by evidence that can be found.

    assessed: job_id, profile_id, category, priority, status, job_quote, evidence_source, evidence_quote.  sources: profile_id, source, text.
    A row supports a condition if it is of its category, supported and not merely preferred, quotes the condition's words, and cites
    words that stand literally in the named source, deny nothing, and name the condition's licence or scope.  A failed condition stays failed.
    """
    category = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[F.col("kind")]
    good = assessed.filter("status = 'supported' and coalesce(priority, '') <> 'preferred' and trim(evidence_quote) <> ''")
    good = good.join(sources.withColumnRenamed("source", "evidence_source"), ["profile_id", "evidence_source"]).filter((F.instr(_flat(F.col("text")), _flat(F.col("evidence_quote"))) > 0) & ~F.col("evidence_quote").rlike(DENIED))
    good = good.select("job_id", "profile_id", "category", F.col("job_quote").alias("a_quote"), F.col("evidence_source").alias("a_source"), F.col("evidence_quote").alias("a_cited"))
    unknown = rows.filter("status = 'unknown'").select("job_id", "profile_id", "condition", "kind", "quote", "scope", category.alias("category"))
    words = F.when(F.col("kind") == "licence", F.regexp_extract(F.lower("quote"), f"({LICENCES})", 1)).when(F.col("kind") == "tenure", F.coalesce("scope", F.lit(""))).otherwise("")
    met = unknown.join(good, ["job_id", "profile_id", "category"]).filter((F.instr(_flat(F.col("a_quote")), _flat(F.col("quote"))) > 0) & (F.instr(_flat(F.col("a_cited")), words) > 0))
    first = met.groupBy("job_id", "profile_id", "condition", "kind").agg(F.min(F.struct("a_source", "a_cited")).alias("a"))
    joined = rows.join(first, ["job_id", "profile_id", "condition", "kind"], "left")
    lifted = F.col("a").isNotNull() & (F.col("status") == "unknown")
    return joined.withColumns({
        "evidence_source": F.when(lifted, F.col("a.a_source")).otherwise(F.col("evidence_source")), "evidence_quote": F.when(lifted, F.col("a.a_cited")).otherwise(F.col("evidence_quote")), "status": F.when(lifted, "pass").otherwise(F.col("status")),
    }).select(*rows.columns)
