"""Dates, schedules and waits.  Everything that depends on the time takes ``now``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")
_MONTHS = {"januar": 1, "january": 1, "februar": 2, "february": 2, "märz": 3, "march": 3, "april": 4, "mai": 5, "may": 5, "juni": 6, "june": 6, "juli": 7, "july": 7, "august": 8, "september": 9, "oktober": 10, "october": 10, "november": 11, "dezember": 12, "december": 12}


def parse_iso(value: Column, *, end_of_day: bool = False) -> Column:
    """ISO text to a UTC timestamp; malformed text is null; a bare date can mean its last microsecond."""
    shaped = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([Zz]|[+-]\d{2}:?\d{2})?)?$"), value)
    at = F.try_to_timestamp(shaped)
    return F.when(F.length(value) == 10, at + F.expr("interval 1 day") - F.expr("interval 1 microsecond")).otherwise(at) if end_of_day else at


def is_expired(value: Column, now: Column) -> Column:
    return F.coalesce(parse_iso(value, end_of_day=True) < now, F.lit(False))


def epoch_or_prefix_date(value: Column) -> Column:
    """Milliseconds since 1970 to an ISO date, else the first ten characters."""
    millis = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast("double"))
    return F.when(millis.isNotNull(), F.date_format(F.timestamp_millis(millis.cast("bigint")), "yyyy-MM-dd")).when(F.trim(value) != "", F.substring(value, 1, 10))


def parse_feed_date(value: Column) -> Column:
    """RFC 2822 or ISO text to a timestamp, else null."""
    text = F.trim(value)
    # The weekday says nothing; names of UTC become its offset.
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s+", ""), r"\s(?:GMT|UTC?|Z)$", " +0000")
    shaped = F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(:\d{2})? [+-]\d{4}$"), mail)
    return F.coalesce(parse_iso(text), *[F.try_to_timestamp(shaped, F.lit(p)) for p in _RFC])


def deadline_from_text(text: Column) -> Column:
    """The first ``d Month yyyy`` (German or English month) as a date."""
    pattern = rf"(?i)(\d{{1,2}})\.?\s+({'|'.join(_MONTHS)})\s+(\d{{4}})"
    month = F.create_map(*[F.lit(x) for kv in _MONTHS.items() for x in kv])
    name = F.lower(F.regexp_extract(text, pattern, 2))
    return F.when(name != "", F.try_make_date(F.regexp_extract(text, pattern, 3).cast("int"), month[name], F.regexp_extract(text, pattern, 1).cast("int")) if hasattr(F, "try_make_date") else F.try_to_date(F.concat_ws("-", F.regexp_extract(text, pattern, 3), F.lpad(month[name].cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, pattern, 1), 2, "0")), "yyyy-MM-dd"))


def week_start(at: Column) -> Column:
    return F.date_trunc("week", at)


def freshness_bucket(at: Column, seconds: int = 900) -> Column:
    return F.floor(F.unix_timestamp(at) / seconds)


def hash_fraction(key: Column) -> Column:
    """A fraction in [0, 1] that depends on the key alone (first 15 hex digits of its SHA-256)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("double") / float(16**15 - 1)


def next_due(now: Column, interval_days: Column, key: Column, *, paused: Column | None = None) -> Column:
    """now + interval * (0.8 .. 1.0 by key): spread in the last fifth; no next time while paused."""
    days = F.greatest(F.lit(1), F.coalesce(interval_days, F.lit(7))) * (0.8 + 0.2 * hash_fraction(key))
    due = F.timestamp_micros(F.unix_micros(now) + F.round(days * 86_400_000_000).cast("bigint"))
    return F.when(~F.coalesce(paused, F.lit(False)), due) if paused is not None else due


def spread(key: Column, seconds: int) -> Column:
    """Whole seconds in [0, seconds) by key."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("bigint"), F.lit(seconds))


def backoff_seconds(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(60))), F.lit(float(cap)))


def retry_after(header: Column, now: Column, *, longest_s: int = 86_400) -> Column:
    """Seconds (at most a day) or a date, never in the past; null if unreadable."""
    text = F.trim(header)
    seconds = F.when(text.rlike(r"^\d{1,9}$"), text.cast("bigint"))
    by_seconds = F.when(seconds <= longest_s, F.timestamp_micros(F.unix_micros(now) + seconds * 1_000_000))
    return F.when(seconds.isNotNull(), by_seconds).otherwise(F.greatest(parse_feed_date(text), F.when(parse_feed_date(text).isNotNull(), now)))


def elapsed_label(start: Column, now: Column) -> Column:
    s = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(start))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
