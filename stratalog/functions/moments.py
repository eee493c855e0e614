"""Times as the journal spells them, and texts and buckets made of them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_LENGTH = len("2024-01-01")


def parse_cutoff(value: object) -> datetime | None:
    """A date or a date with a time; None for anything else."""
    text = value.strip() if isinstance(value, str) else ""
    if len(text) < DAY_LENGTH:
        return None
    try:
        return datetime.fromisoformat(text[:-1] + "+00:00" if text[-1] in "Zz" else text)
    except ValueError:
        return None


def normalised_cutoff(value: object) -> str | None:
    """The spelling that compares with ``created_at`` as text; None for what isn't a date, which selects nothing.

    A value with an offset becomes UTC as the journal writes it. A bare day and a time without an offset stay as they
    are: they are prefixes, so a bound in whole seconds stands before all events of its second.
    """
    parsed = parse_cutoff(value)
    if parsed is None:
        return None
    text = value.strip()
    if len(text) == DAY_LENGTH:
        return text
    if parsed.tzinfo:
        parsed = parsed.astimezone(timezone.utc)
    return parsed.isoformat(sep=text[DAY_LENGTH])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(text: Column | str) -> Column:
    """ISO text as a time, UTC where it has no offset; null where unreadable."""
    return F.trim(_col(text)).try_cast("timestamp")


#: Spellings of times that labels read, with and without an offset and fractions of a second.
SPELLINGS = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?| \d{2}:\d{2}:\d{2}(\.\d{1,6})?)$"


def strict_instant(text: Column | str) -> Column:
    """A time in one of the ``SPELLINGS``, UTC where it has no offset; null for any other text, a bare date too."""
    c = F.trim(_col(text))
    with_colon = F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(c.rlike(SPELLINGS), with_colon.try_cast("timestamp"))


def clamped_cutoff(wanted: Column | str, first_tracked: Column | str) -> Column:
    """The wanted cutoff, or the time of the first tracked event where the cutoff lies before it; as it is if unreadable."""
    early = instant(wanted) < instant(first_tracked)
    return F.when(F.coalesce(early, F.lit(False)), _col(first_tracked)).otherwise(_col(wanted))


def marker_ticks(ticks: DataFrame, seconds_shown: float, at: str = "tick") -> DataFrame:
    """The ticks to draw: all of them where at most three days are shown, else the first of each day."""
    if 0 < seconds_shown <= 3 * 86400:
        return ticks
    return ticks.groupBy(F.to_date(at).alias("_day")).agg(F.min(at).alias(at)).drop("_day")


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.unix_seconds(later) - F.unix_seconds(earlier)


def short_absolute(text: Column | str, now: Column) -> Column:
    at, raw = instant(text), _col(text)
    fallback = F.replace(F.substring(F.coalesce(raw, F.lit("")), 1, 19), F.lit("T"), F.lit(" "))
    same = F.year(at) == F.year(now)
    return F.when(at.isNull(), fallback).when(same, F.date_format(at, "dd/MM HH:mm")).otherwise(F.date_format(at, "dd/MM/yyyy HH:mm"))


def full_timestamp(text: Column | str) -> Column:
    at = instant(text)
    return F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), _col(text), F.lit(""))


def relative(text: Column | str, now: Column) -> Column:
    """'now', '12s', '5 min', '3h', 'yesterday 10:20', '4d', or a date for the future and for a week and more."""
    at = instant(text)
    s = seconds_between(now, at)
    n = lambda unit, suffix: F.concat(F.floor(s / unit).cast("string"), F.lit(suffix))
    return (
        F.when(at.isNull() | (s < 0), short_absolute(text, now))
        .when(s < 10, "now")
        .when(s < 60, n(1, "s"))
        .when(s < 3600, n(60, " min"))
        .when(s < 86400, n(3600, "h"))
        .when(s < 2 * 86400, F.concat(F.lit("yesterday "), F.date_format(at, "HH:mm")))
        .when(s < 7 * 86400, n(86400, "d"))
        .otherwise(short_absolute(text, now))
    )


def history_span(oldest: Column | str, newest: Column | str) -> Column:
    """The span in hours, days, months of 30 days, or years of 365 days; '' if either end is unreadable."""
    s = seconds_between(instant(newest), instant(oldest))
    days = F.floor(s / 86400)
    months, years, rest = F.floor(days / 30), F.floor(days / 365), F.floor((days % 365) / 30)
    t = lambda c, unit: F.concat(c.cast("string"), F.lit(f" {unit}"))
    return (
        F.when(s.isNull(), "")
        .when((days == 0) & (s < 3600), "< 1 hour")
        .when(days == 0, t(F.floor(s / 3600), "hours"))
        .when(days < 30, t(days, "days"))
        .when(months < 12, t(months, "months"))
        .when(rest > 0, F.concat(t(years, "years"), F.lit(" "), t(rest, "months")))
        .otherwise(t(years, "years"))
    )


def coverage_months(oldest: Column | str, newest: Column | str) -> Column:
    """Calendar months between two ISO texts; null where unreadable."""
    part = lambda c, a, n: F.substring(_col(c), a, n).try_cast("int")
    return (part(newest, 1, 4) - part(oldest, 1, 4)) * 12 + part(newest, 6, 2) - part(oldest, 6, 2)


def granularity(span_seconds: Column) -> Column:
    """Seconds of a slider's step: 1 up to a day, 60 up to 30 days, 3600 beyond."""
    return F.when(span_seconds <= 86400, 1).when(span_seconds <= 30 * 86400, 60).otherwise(3600)


def slider_bucket(at: Column, oldest: Column, step: Column) -> Column:
    return F.floor(seconds_between(at, oldest) / step).cast("long")


def ticks(bounds: DataFrame, unit: str, start: str = "start", end: str = "end") -> DataFrame:
    """One row per calendar tick (minute, hour, day, week, month, year) from ``start`` to ``end``: ``tick``."""
    first = F.date_trunc(unit, F.col(start))
    step = {"week": "INTERVAL 7 DAY"}.get(unit, f"INTERVAL 1 {unit.upper()}")
    return bounds.select(F.explode(F.sequence(first, F.col(end), F.expr(step))).alias("tick")).where(F.col("tick").isNotNull())


#: Bytes of the units of sizes.
KILO, MEGA, GIGA = 1 << 10, 1 << 20, 1 << 30


def size_text(size: Column | str, style: str = "health") -> Column:
    """A size in bytes as text: ``health`` (B, KB, MB, GB with one decimal), ``journal`` (the same, GB with two) or
    ``report`` (MB with two decimals, and no larger unit)."""
    c = _col(size)
    part = lambda unit, name, n: F.concat(F.format_string(f"%.{n}f", c / F.lit(float(unit))), F.lit(f" {name}"))
    out = F.when(c < KILO, F.concat(c.cast("string"), F.lit(" B"))).when(c < MEGA, part(KILO, "KB", 1))
    if style == "report":
        return out.otherwise(part(MEGA, "MB", 2))
    return out.when(c < GIGA, part(MEGA, "MB", 1)).otherwise(part(GIGA, "GB", 2 if style == "journal" else 1))
