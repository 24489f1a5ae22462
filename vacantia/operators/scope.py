"""Is a posting within the searched area?  Three-valued predicates and their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, geo, strings

#: Country names as they stand in postings (fixed values).
COUNTRIES = {"germany": "DE", "deutschland": "DE", "austria": "AT", "österreich": "AT", "switzerland": "CH", "schweiz": "CH", "france": "FR", "frankreich": "FR", "united kingdom": "GB", "united states": "US", "usa": "US", "netherlands": "NL", "niederlande": "NL", "spain": "ES", "spanien": "ES", "poland": "PL", "polen": "PL", "italy": "IT", "italien": "IT"}
TEXT_CODES = ("DE", "AT", "CH", "FR", "GB", "UK", "US", "NL", "ES", "PL", "IT")
STATES = ("Baden-Württemberg", "Bayern", "Berlin", "Brandenburg", "Bremen", "Hamburg", "Hessen", "Mecklenburg-Vorpommern", "Niedersachsen", "Nordrhein-Westfalen", "Rheinland-Pfalz", "Saarland", "Sachsen", "Sachsen-Anhalt", "Schleswig-Holstein", "Thüringen")
STATE_ALIASES = {"bavaria": "Bayern", "hesse": "Hessen", "lower saxony": "Niedersachsen", "north rhine westphalia": "Nordrhein-Westfalen", "nrw": "Nordrhein-Westfalen", "rhineland palatinate": "Rheinland-Pfalz", "saxony": "Sachsen", "saxony anhalt": "Sachsen-Anhalt", "thuringia": "Thüringen"}
GENERIC_PHRASES = ("remote", "fully remote", "hybrid", "onsite", "on site", "office", "flexible", "multiple locations", "various locations", "work from home", "home office", "field based", "field work", "anywhere")
GENERIC_TOKENS = ("remote", "fully", "hybrid", "onsite", "on", "site", "office", "flexible", "multiple", "various", "locations", "location", "work", "from", "home", "field", "based", "role", "possible", "available")
#: A place's name inside another place's name.
NOT_THESE = {"frankfurt": ("frankfurt oder", "frankfurt an der oder"), "halle": ("halle westf", "halle westfalen"), "oldenburg": ("oldenburg in holstein", "oldenburg holstein")}


def fully_remote(arrangement: Column, is_remote: Column) -> Column:
    return (arrangement.isNull() | (arrangement == "remote")) & (F.coalesce(is_remote, F.lit(False)) | F.coalesce(arrangement == "remote", F.lit(False)))


def work_style(arrangement: Column, is_remote: Column, style: str) -> Column:
    if style == "remote":
        return fully_remote(arrangement, is_remote)
    return F.coalesce(arrangement == style, F.lit(False))


def _read(text: Column) -> Column:
    """What the rules read of a location text: itself, its words, and its words with umlauts spelled out, both between blanks."""
    between = lambda folded: F.concat(F.lit(" "), strings.words_of(folded), F.lit(" "))
    return F.struct(text.alias("text"), between(strings.fold(text)).alias("plain"), between(strings.fold_umlauts(text)).alias("long"))


def _stands(words: Column, phrase: str, exceptions: tuple[str, ...] = ()) -> Column:
    """Whether a phrase, and none of the longer names, stands in words between blanks."""
    found = F.contains(words, F.lit(f" {phrase} "))
    for longer in exceptions:
        found = found & ~F.contains(words, F.lit(f" {longer} "))
    return found


def _unspecified(read: Column) -> Column:
    return strings.once(F.trim(F.coalesce(read["plain"], F.lit(""))), lambda w: w.isin(*GENERIC_PHRASES) | strings.only_generic(w, list(GENERIC_TOKENS)))


def is_unspecified(text: Column) -> Column:
    return strings.once(_read(text), _unspecified)


def _names(read: Column, place: str) -> Column:
    spellings = set()
    for marks in ({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"}, {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}):
        name = "".join(marks.get(c, c) for c in place.lower())
        spellings.add(" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in name).split()))
    out = F.lit(False)
    for words in ("plain", "long"):
        for name in sorted(spellings - {""}):
            out = out | _stands(read[words], name, NOT_THESE.get(name, ()))
    return F.coalesce(out, F.lit(False))


def names_place(text: Column, place: str) -> Column:
    """Whether a whole-word place name stands in the text, in either spelling of umlauts."""
    return strings.once(_read(text), lambda r: _names(r, place))


def _countries(read: Column) -> Column:
    named = [F.when(_stands(read["plain"], name.replace("ö", "o")) | _stands(read["long"], name.replace("ö", "oe")), F.lit(code)) for name, code in COUNTRIES.items()]
    upper = F.regexp_extract_all(read["text"], F.lit(r"(?<![A-Za-z0-9])([A-Z]{2})(?![A-Za-z0-9])"), F.lit(1))
    lower = F.transform(F.regexp_extract_all(read["text"], F.lit(r"[,(/]\s*([a-z]{2})(?![A-Za-z0-9])"), F.lit(1)), F.upper)
    alone = F.array(F.upper(F.trim(read["text"])))
    codes = F.filter(F.concat(upper, lower, alone), lambda c: c.isin(*TEXT_CODES))
    return F.coalesce(F.array_distinct(F.array_compact(F.concat(F.array(*named), codes))), F.expr("cast(array() as array<string>)"))


def countries_in(text: Column) -> Column:
    """Codes of the countries named in a location text."""
    return strings.once(_read(text), _countries)


def _states(read: Column) -> Column:
    phrases = [(" ".join(s.lower().replace("ü", "u").replace("-", " ").split()), s) for s in STATES] + list(STATE_ALIASES.items())
    spaced = lambda name: f" {name} ".replace(" ", "  ")[1:-1]

    def found(w: Column) -> Column:
        out = []
        for phrase, state in phrases:
            rest = w
            for longer, other in phrases:
                if other != state and f" {phrase} " in f" {longer} ":
                    rest = F.replace(rest, F.lit(spaced(longer)), F.lit("  "))
            out.append(F.when(F.contains(rest, F.lit(spaced(phrase))), F.lit(state)))
        return F.array_distinct(F.array_compact(F.array(*out)))

    # Two blanks between words: names that follow each other share none.
    doubled = F.concat(F.lit(" "), F.replace(F.trim(read["plain"]), F.lit(" "), F.lit("  ")), F.lit(" "))
    return F.coalesce(strings.once(doubled, found), F.expr("cast(array() as array<string>)"))


def states_in(text: Column) -> Column:
    """States named in a location text; a name inside a longer state name does not count."""
    return strings.once(_read(text), _states)


def text_scope(locations: Column, *, place: str | None = None, country: str | None = None, state: str | None = None) -> Column:
    """True, False or null from array<struct<label, country_code, latitude, longitude>>.

    Null: the location is missing or generic, or coordinates must decide.
    """
    if not (place or country or state):
        return F.lit(None).cast("boolean")
    once = strings.once
    labelled = F.filter(locations, lambda x: F.coalesce(x["label"], F.lit("")) != "")
    read = F.transform(labelled, lambda x: F.struct(_read(x["label"]).alias("r"), x["country_code"].alias("code")))
    real = F.filter(read, lambda x: ~_unspecified(x["r"]))
    own = lambda x: x["code"] == country
    if place:
        in_country = lambda x: once(_countries(x["r"]), lambda named: F.when(F.size(named) > 0, F.array_contains(named, country)).otherwise(F.coalesce(own(x), F.lit(True))))
        placed = F.exists(locations, lambda x: x["latitude"].isNotNull() & x["longitude"].isNotNull())
        judged = lambda possible: F.when(F.exists(possible, lambda x: _names(x["r"], place)), True).when((F.size(possible) > 0) & placed, None).otherwise(False)
        verdict = lambda all_: once(F.filter(all_, in_country) if country else all_, judged)
    elif country:
        in_state = lambda x: F.lit(country == "DE") & x["code"].isNull() & (F.size(_states(x["r"])) > 0)
        verdict = lambda all_: F.exists(all_, lambda x: once(_countries(x["r"]), lambda named: F.when(F.size(named) > 0, F.array_contains(named, country)).otherwise(F.coalesce(own(x), F.lit(False)) | in_state(x))))
    else:
        abroad = lambda x: once(_countries(x["r"]), lambda named: (F.size(named) > 0) & ~F.array_contains(named, "DE"))
        verdict = lambda all_: F.exists(all_, lambda x: F.coalesce(x["code"] == "DE", F.lit(True)) & F.array_contains(_states(x["r"]), state) & ~abroad(x))
    return once(real, lambda all_: F.when(F.size(all_) == 0, None).otherwise(verdict(all_)))


def _result(ok: bool, reason: str | None, kind: str | None, unknown: Column | None = None) -> Column:
    none = F.expr("cast(array() as array<string>)")
    return F.struct(F.lit(ok).alias("eligible"), F.lit(reason).cast("string").alias("reason"), (none if unknown is None else unknown).alias("unknowns"), F.lit(kind).cast("string").alias("match_kind"))


def classify(postings: DataFrame, *, now: Column, lat: float | None = None, lon: float | None = None, radius_km: float | None = None, place: str | None = None, country: str | None = None, selection: str = "all") -> DataFrame:
    """``postings`` with ``scope`` struct(eligible, reason, unknowns, match_kind).

    Order: expired; remote and its countries; the text's verdict; coordinates within the radius; the exact city label where
    both coordinates are missing; else outside.  selection 'remote' or 'area' then rejects the other kind.
    postings: valid_through, work_arrangement, is_remote, remote_countries array<string>, remote_unresolved boolean, locations.
    """
    result = _result
    remote = fully_remote(F.col("work_arrangement"), F.col("is_remote"))
    stated = F.coalesce(F.col("remote_countries"), F.expr("cast(array() as array<string>)"))
    barred = F.lit(False) if country is None else F.coalesce(F.col("remote_unresolved"), F.lit(False)) | ((F.size(stated) > 0) & ~F.array_contains(stated, country))
    gap = F.when(F.lit(country is not None) & (F.size(stated) == 0), F.array(F.lit("Remote country eligibility not stated"))).otherwise(F.expr("cast(array() as array<string>)"))
    verdict = text_scope(F.col("locations"), place=place, country=country)
    same = lambda x: F.lit(True) if country is None else F.coalesce(x["country_code"] == country, F.lit(True))
    near = F.lit(False) if lat is None else F.exists("locations", lambda x: same(x) & F.coalesce(geo.within_radius(x["latitude"], x["longitude"], F.lit(lat), F.lit(lon), F.lit(radius_km)), F.lit(False)))
    named = F.lit(False) if place is None else F.exists("locations", lambda x: same(x) & x["latitude"].isNull() & x["longitude"].isNull() & F.coalesce(F.lower(F.trim(F.split_part(x["label"], F.lit(","), F.lit(1)))) == place.strip().lower(), F.lit(False)))
    # Only texts of postings that are neither expired nor remote are read, each once.
    by_place = lambda v: F.when(F.coalesce(v, near | named, F.lit(False)), result(True, None, "in_area")).otherwise(result(False, "outside_area", None))
    scope = (
        F.when(dates.is_expired(F.col("valid_through"), now), result(False, "expired", None))
        .when(remote & barred, result(False, "remote_country", "remote"))
        .when(remote, result(True, None, "remote", gap))
        .otherwise(strings.once(verdict, by_place))
    )
    return _selected(postings.withColumn("scope", scope), selection)


def _selected(out: DataFrame, selection: str) -> DataFrame:
    if selection == "remote":
        out = out.withColumn("scope", F.when(F.col("scope.eligible") & (F.col("scope.match_kind") != "remote"), _result(False, "not_remote", None)).otherwise(F.col("scope")))
    if selection == "area":
        out = out.withColumn("scope", F.when(F.col("scope.eligible") & (F.col("scope.match_kind") == "remote"), _result(False, "remote_not_selected", "remote")).otherwise(F.col("scope")))
    return out


def classify_by_employer(postings: DataFrame, *, now: Column, country: str = "DE", state: str | None = None, selection: str = "all") -> DataFrame:
    """``postings`` with ``scope`` for a search of a whole country, or of a state of Germany, where the employer stands in for an unsaid place.

    Expired and remote postings go as in ``classify``.  Else the places named decide (work_location); where they say nothing, a country is met by the
    employer's own country, a German state of the employer's for DE, a feed kept for the country, or any location's code (employer_in_country), and a
    state by the state of the employer or of the feed's company (employer_in_state).  A null employer meets nothing.
    postings: the columns of ``classify``, employer_country, employer_state, feed_state, default_feed boolean.
    """
    land = "DE" if state else country
    base = classify(postings, now=now, country=land)
    verdict = text_scope(F.col("locations"), state=state) if state else text_scope(F.col("locations"), country=country)
    if state:
        at = (F.col("employer_state") == state) | (F.col("feed_state") == state)
    else:
        at = (F.col("employer_country") == country) | F.col("default_feed") | F.exists("locations", lambda x: F.upper(x["country_code"]) == country)
        at = at | F.col("employer_state").isin(*STATES) if country == "DE" else at
    kept = F.coalesce(F.col("scope.reason") == "expired", F.lit(False)) | fully_remote(F.col("work_arrangement"), F.col("is_remote"))
    scope = (
        F.when(kept, F.col("scope")).when(verdict, _result(True, None, "work_location")).when(~verdict, _result(False, "outside_area", None))
        .when(F.coalesce(at, F.lit(False)), _result(True, None, "employer_in_state" if state else "employer_in_country")).otherwise(_result(False, "outside_area", None))
    )
    return _selected(base.withColumn("scope", scope), selection)


def rejected_by_reason(classified: DataFrame) -> DataFrame:
    return classified.filter("not scope.eligible").groupBy(F.col("scope.reason").alias("reason")).agg(F.count("*").alias("n"))


#: Metadata keys that can restrict where a remote posting may be worked from, in order (fixed values).
REMOTE_KEYS = ("remote_country_codes", "applicantLocationRequirements", "applicant_location_requirements", "remote_country")


def remote_scope(metadata: Column, locations: Column) -> Column:
    """struct(countries, unresolved) of a posting's metadata (JSON text).

    The first key with a value decides; a value that names no known country is an unresolved restriction.  Without one, a stated
    scope source takes the countries of the locations and of the metadata's own country fields.
    """
    from vacantia.functions.records import country_code

    none = F.expr("cast(array() as array<string>)")

    def items(key: str) -> Column:
        raw = F.get_json_object(metadata, f"$.{key}")
        return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))

    present = F.coalesce(*[F.when(F.size(items(k)) > 0, items(k)) for k in REMOTE_KEYS])
    codes = F.array_distinct(F.filter(F.transform(present, lambda x: country_code(x, COUNTRIES)), lambda x: x.isNotNull()))
    own = F.array(*[country_code(F.get_json_object(metadata, f"$.{k}"), COUNTRIES) for k in ("country_code", "country", "office_country_code", "office.country_code")])
    stated = F.array_distinct(F.array_compact(F.concat(F.transform(F.coalesce(locations, F.array().cast("array<struct<label:string,country_code:string,latitude:double,longitude:double>>")), lambda x: x["country_code"]), own)))
    return F.when(present.isNotNull(), F.struct(codes.alias("countries"), (F.size(codes) == 0).alias("unresolved"))).when(
        F.get_json_object(metadata, "$.remote_scope_source").isNotNull(), F.struct(stated.alias("countries"), F.lit(False).alias("unresolved"))
    ).otherwise(F.struct(none.alias("countries"), F.lit(False).alias("unresolved")))


def listed_location(text: Column, locations: Column) -> Column:
    """The first listed location whose label stands in the text as whole words, or the other way round; else the only one listed; else null."""
    words = strings.words_of(strings.fold(text))

    def same(x: Column) -> Column:
        label = strings.words_of(strings.fold(x["label"]))
        return F.coalesce(strings.contains_phrase(words, label) | strings.contains_phrase(label, words), F.lit(False))

    return F.coalesce(F.try_element_at(F.filter(locations, same), F.lit(1)), F.when(F.size(locations) == 1, F.try_element_at(locations, F.lit(1))))


def location_parts(text: Column) -> Column:
    """The single places of a location text: split at ; | line ends and spaced slashes."""
    return F.filter(F.transform(F.split(text, r"[;\n|]+|(?<=\s)/(?=\s)"), lambda x: F.trim(x)), lambda x: x != "")
