"""Working-day calendar and time labels. The session time zone must be UTC; zones are arguments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionlens import constants as K
from sessionlens.functions.text import count_noun

DAY_FORMAT = "E, MMM d"
CLOCK_FORMAT = "HH:mm"


def _hours(day_start: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(min(max(day_start, 0), 23)))


def to_local(ts: Column, zone: str) -> Column:
    """Local wall-clock time of an instant."""
    return F.from_utc_timestamp(ts, zone)


def working_day(ts: Column, zone: str, day_start: int = K.DAY_START_HOUR) -> Column:
    """Local calendar day, shifted so that it starts at ``day_start`` o'clock."""
    return F.to_date(to_local(ts, zone) - _hours(day_start))


def day_start_instant(day: Column, zone: str, day_start: int = K.DAY_START_HOUR) -> Column:
    """First instant of a working day."""
    return F.to_utc_timestamp(day.cast("timestamp") + _hours(day_start), zone)


def relative_age(last: Column, now: Column, zone: str = "UTC") -> Column:
    """``just now``, ``5 minutes ago``, ... or the date beyond a week and in the future."""
    seconds = (F.unix_micros(now) - F.unix_micros(last)) / F.lit(1_000_000)

    def ago(unit_seconds: int, noun: str) -> Column:
        return F.concat(count_noun(F.floor(seconds / unit_seconds), noun), F.lit(" ago"))

    return (
        F.when(last.isNull(), F.lit("unknown"))
        .when((seconds < 0) | (seconds >= 7 * 86400), F.date_format(to_local(last, zone), "yyyy-MM-dd"))
        .when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, ago(60, "minute"))
        .when(seconds < 86400, ago(3600, "hour"))
        .otherwise(ago(86400, "day"))
    )


def short_day(day: Column) -> Column:
    return F.date_format(day, DAY_FORMAT)


def day_label(day: Column, today: Column) -> Column:
    """``Today so far (Mon, Oct 5)``, ``Yesterday (...)`` or the short day."""
    label = short_day(day)
    return (
        F.when(day == today, F.concat(F.lit("Today so far ("), label, F.lit(")")))
        .when(day == F.date_sub(today, 1), F.concat(F.lit("Yesterday ("), label, F.lit(")")))
        .otherwise(label)
    )


def span(first_local: Column, last_local: Column) -> Column:
    """``10:05–17:40``; one time when both fall in the same minute of the clock."""
    first, last = F.date_format(first_local, CLOCK_FORMAT), F.date_format(last_local, CLOCK_FORMAT)
    return F.when(first == last, first).otherwise(F.concat(first, F.lit("–"), last))


def age_heading(day: Column, today: Column) -> Column:
    days = F.datediff(today, day)
    return (
        F.when(days == 0, F.lit("Today so far"))
        .when(days == 1, F.lit("Yesterday"))
        .when(days < 0, F.lit("Later"))
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def week_label(first_day: Column, last_day: Column) -> Column:
    head = F.concat(F.lit("Week of "), short_day(first_day))
    return F.when(first_day == last_day, head).otherwise(F.concat(head, F.lit(" – "), short_day(last_day)))


def to_epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def from_epoch_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def parse_iso(text: Column) -> Column:
    """Instant of an ISO-8601 text, NULL when it is not one."""
    return F.try_to_timestamp(text)
