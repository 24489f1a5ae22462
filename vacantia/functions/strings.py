"""Text normalising and matching as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks that the feeds' languages use, and the letters without (fixed values).
_MARKED = "äöüàâáéèêëîïíôóûùúçñÄÖÜÀÂÁÉÈÊËÎÏÍÔÓÛÙÚÇÑ"
_PLAIN = "aouaaaeeeeiiioouuucnAOUAAAEEEEIIIOOUUUCN"
#: Postings' markers of gender forms at a title's end.
GENDER_SUFFIX = r"(?i)\s*[(\[/|,-]*\s*\b(?:[mwfdx](?:\s*[/|*]\s*[mwfdxi]){1,3}|all genders?|gn)\b\s*[)\]]*\s*$"
STOPWORDS = ("the", "and", "of", "to", "in", "a", "for", "with", "der", "die", "das", "und", "in", "mit", "für", "von")
#: Pages that ask for proof of being human.
CHALLENGE = r"(?i)just a moment|attention required|verify(?:ing)? (?:that )?you are (?:a )?human|captcha|access denied|ddos protection"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once: what a lambda takes from outside, or names twice, is evaluated again each time."""
    return F.try_element_at(F.transform(F.array(value), then), F.lit(1))


def fold(text: Column) -> Column:
    """Lower-case, ß as ss, marks dropped."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _MARKED, _PLAIN)


def fold_umlauts(text: Column) -> Column:
    """Lower-case, umlauts as ae, oe, ue."""
    t = F.lower(text)
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.translate(t, _MARKED, _PLAIN)


def words_of(folded: Column) -> Column:
    """Runs of ASCII letters and digits joined by single spaces."""
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def text_key(text: Column) -> Column:
    """Vacancy text key: folded words without the country's name; empty for null."""
    return F.coalesce(words_of(F.regexp_replace(fold(text), r"\b(?:deutschland|germany)\b", " ")), F.lit(""))


def contains_phrase(text_words: Column, phrase_words: Column, exceptions: tuple[str, ...] = ()) -> Column:
    """Whole-word phrase in normalised words, unless one of the longer names stands there."""
    padded = F.concat(F.lit(" "), text_words, F.lit(" "))
    found = (phrase_words != "") & F.contains(padded, F.concat(F.lit(" "), phrase_words, F.lit(" ")))
    for longer in exceptions:
        found = found & ~F.contains(padded, F.lit(f" {longer} "))
    return found


def only_generic(text_words: Column, generic: list[str]) -> Column:
    """Whether all tokens are generic (and there is one)."""
    tokens = F.filter(F.split(text_words, " "), lambda t: t != "")
    return once(tokens, lambda all_: (F.size(all_) > 0) & F.forall(all_, lambda t: t.isin(generic)))


def title_identity(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, GENDER_SUFFIX, ""))


def stable_id(*parts: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length)


def tokenize(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9äöüß+#]{2,})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*stopwords))


def employee_count(text: Column) -> Column:
    """An explicit count, or a range's lower bound; anything else is null."""
    number = r"([1-9]\d{0,2}(?:[., ]\d{3})+|[1-9]\d*)"
    pattern = rf"^{number}(?:\s*[-–]\s*{number})?$"
    t = F.trim(text)
    part = lambda k: F.regexp_replace(F.regexp_extract(t, pattern, k), "[., ]", "").try_cast("bigint")
    return F.when(t.rlike(pattern) & (part(2).isNull() | (part(2) >= part(1))), part(1))


def work_arrangement(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    remote = t.rlike("remote|work from home|telecommute") & ~t.rlike("remote (?:options?|available)")
    return F.when(F.contains(t, F.lit("hybrid")), "hybrid").when(remote, "remote").when(t.rlike("on-site|onsite|on site|office-based|vor ort"), "onsite")


def employment_type(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike(r"\b(?:intern|internship|praktikum|praktikant)"), "internship").when(t.rlike(r"werkstudent|working student"), "working_student").when(t.rlike(r"part[- ]?time|teilzeit"), "part_time").when(t.rlike(r"full[- ]?time|vollzeit"), "full_time")


def plain_text(html: Column) -> Column:
    """Tags out, the commonest entities decoded, white space single; empty becomes null."""
    t = html
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))
    return F.when(t != "", t)


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens as a part of the smaller set."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    n = F.least(F.size(x), F.size(y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def grounded(quote: Column, source: Column) -> Column:
    """Whether a quote stands in its source, case and white space aside."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.coalesce((norm(quote) != "") & F.contains(norm(source), norm(quote)), F.lit(False))


def is_challenge(text: Column) -> Column:
    return F.coalesce(text.rlike(CHALLENGE), F.lit(False))


def head_and_tail(text: Column, limit: int) -> Column:
    """The text, or its first and last halves of ``limit`` characters around a mark."""
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("\n[…]\n"), F.right(text, F.lit(half))))


def pack_words(text: Column, limit: int) -> Column:
    """Chunks of whole words with at most ``limit`` characters (a longer word alone)."""
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    none = F.expr("named_struct('done', cast(array() as array<string>), 'now', cast('' as string))")

    def step(a, w):
        grown = F.when(a["now"] == "", w).otherwise(F.concat(a["now"], F.lit(" "), w))
        fits = F.length(grown) <= limit
        return F.struct(F.when(fits | (a["now"] == ""), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))).alias("done"), F.when(fits | (a["now"] == ""), grown).otherwise(w).alias("now"))

    return F.aggregate(tokens, none, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def like_literal(text: Column, needle: str) -> Column:
    """Case-insensitive substring; % and _ are ordinary characters."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def phone_key(text: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\s*(?:\+|00)49\s*(?:\(0\))?", "0"), "[^0-9]", "")
    return F.when(F.length(digits) >= 7, digits)
