"""Time expressions; the clock is always a parameter."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: hours and score: the score of anything at most that old
RECENCY = [(6, 20), (12, 16), (24, 12), (36, 8), (72, 4), (96, 2), (120, 1)]
WINDOW_HOURS = 120
HISTORY_DAYS = 30
SITE_ZONE = "Asia/Shanghai"

_ZONED = r"(?i)(?:Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|GMT|UTC|UT)$"
_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mmXXX", "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm XX"]


def hours_before(now: Column, hours: int) -> Column:
    return now - F.expr(f"INTERVAL {hours} HOURS")


def in_window(published: Column, now: Column, hours: int = WINDOW_HOURS) -> Column:
    """Inclusive at both ends."""
    return (published >= hours_before(now, hours)) & (published <= now)


def recency_score(published: Column, now: Column) -> Column:
    """Step score of the age; what lies in the future counts as new."""
    out = None
    for hours, score in RECENCY:
        fresh = published >= hours_before(now, hours)
        out = F.when(fresh, score) if out is None else out.when(fresh, score)
    return out.otherwise(0)


def zoned_to_utc(local: Column, zone: str) -> Column:
    """A wall-clock time of a zone as an instant."""
    return F.to_utc_timestamp(local, zone)


def run_cutoff(day: Column, zone: str = SITE_ZONE) -> Column:
    """The last microsecond of a day in the site's zone."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp") - F.expr("INTERVAL 0.000001 SECONDS"), zone)


def feed_timestamp(text: Column) -> Column:
    """An instant from RFC 822 or ISO 8601 text; null without an explicit zone."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*(?:GMT|UTC|UT)$", " +0000"), r"[Zz]$", "+00:00")
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2}:\d{2}[.\d]*)\s*([+-]\d{2}):?(\d{2})$", "$1$2:$3")
    wordy = F.regexp_replace(t, r"\s*([+-]\d{2}):?(\d{2})$", " $1$2")
    t = F.regexp_replace(t, r"[tT](\d{2}:)", "T$1")
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in _FORMATS[:3]] + [F.try_to_timestamp(wordy, F.lit(f)) for f in _FORMATS[3:]]
    return F.when(F.trim(text).rlike(_ZONED), F.coalesce(*tries))


def strict_timestamp(text: Column) -> Column:
    """Only ISO 8601 with an explicit zone."""
    iso = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)$"
    return F.when(F.trim(text).rlike(iso), feed_timestamp(F.replace(F.trim(text), F.lit(","), F.lit("."))))


def site_time(at: Column, zone: str = SITE_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm")
