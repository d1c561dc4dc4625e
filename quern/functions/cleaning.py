"""Column cleaning shared by the operators: ids, paths, tokens, instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, tabs and the Unicode spaces included.
_WHITE_EDGE, _EDGES = r"(?U)^\s|\s$", r"(?U)^\s+|\s+$"
_SLASH_EDGE, _SLASHES = r"^[/\s]|[/\s]$", r"^[/\s]+|[/\s]+$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """White space of any kind removed at both ends."""
    # Blanks go first and cheaply; few values have anything else at their ends.
    text = F.trim(as_col(c))
    return F.when(F.rlike(text, F.lit(_WHITE_EDGE)), F.regexp_replace(text, _EDGES, "")).otherwise(text)


def lower_trimmed(c: Column | str) -> Column:
    """Trimmed and in lower case; null where nothing is left."""
    t = F.lower(trimmed(c))
    return F.when(t != "", t)


def topic_path(c: Column | str) -> Column:
    """A topic path: trimmed, freed of slashes at the ends, lower case; null where blank."""
    text = as_col(c)
    t = F.lower(F.when(F.rlike(text, F.lit(_SLASH_EDGE)), F.regexp_replace(text, _SLASHES, "")).otherwise(text))
    return F.when(t != "", t)


def file_path(c: Column | str) -> Column:
    """A file path with forward slashes and without a leading './'; case counts."""
    path = F.replace(as_col(c), F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(path, F.lit("./")), F.regexp_replace(path, r"^(\./)+", "")).otherwise(path)


def instant(c: Column | str) -> Column:
    """RFC-3339 text to microseconds since the epoch (UTC); null where it can't be read."""
    return F.unix_micros(F.try_to_timestamp(trimmed(c)))


def micros_of(c: Column | str) -> Column:
    """A timestamp column without zone, meaning UTC, to microseconds since the epoch.

    The cast reads it in the session's zone; the shift puts that right, so the
    result doesn't depend on the session.
    """
    return F.unix_micros(F.from_utc_timestamp(as_col(c).cast("timestamp"), F.current_timezone()))


def _days_secs(micros: Column) -> tuple[Column, Column]:
    secs = F.floor(micros / F.lit(1_000_000))
    days = F.floor(secs / F.lit(86_400))
    return F.date_from_unix_date(days.cast("int")), secs - days * F.lit(86_400)


def utc_text(micros: Column) -> Column:
    """Microseconds since the epoch as YYYY-MM-DDTHH:MM:SSZ, whatever the session's zone."""
    day, rest = _days_secs(micros)
    part = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
    return F.concat(
        day.cast("string"),
        F.lit("T"),
        part(rest / 3600),
        F.lit(":"),
        part((rest % 3600) / 60),
        F.lit(":"),
        part(rest % 60),
        F.lit("Z"),
    )


def utc_month(micros: Column) -> Column:
    """Microseconds since the epoch as YYYY-MM in UTC."""
    return F.substring(_days_secs(micros)[0].cast("string"), 1, 7)
