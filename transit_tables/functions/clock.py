"""Times of day, packed first/last entries, and live timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(time: Column, i: int) -> Column:
    """The i-th field as an integer, null if absent or no number."""
    return F.get(F.split(time, ":"), F.lit(i)).try_cast("int")


def _two(number: Column) -> Column:
    """At least two characters, as %02d."""
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.concat(F.lit("0"), text)).otherwise(text)


def gtfs_seconds(time: Column) -> Column:
    """Seconds after the service day's midnight; hours may pass 24."""
    return _part(time, 0) * 3600 + _part(time, 1) * 60 + F.coalesce(_part(time, 2), F.lit(0))


def gtfs_hhmm(time: Column, service_day: bool = False) -> Column:
    """HH:MM:SS as HH:MM with hours from 24 on taken into the next day, unless ``service_day``; other texts unchanged."""
    hours = _part(time, 0)
    hours = hours if service_day else F.when(hours >= 24, hours % 24).otherwise(hours)
    return F.when(hours.isNotNull() & _part(time, 1).isNotNull(), F.concat(_two(hours), F.lit(":"), _two(_part(time, 1)))).otherwise(time)


def hhmm_packed(time: Column) -> Column:
    """HH:MM as HHMM, 0000 for anything else."""
    ok = _part(time, 0).isNotNull() & _part(time, 1).isNotNull()
    return F.when(ok, F.concat(_two(_part(time, 0)), _two(_part(time, 1)))).otherwise(F.lit("0000"))


def first_last_entry(route: Column, first: Column, last: Column) -> Column:
    """The packed text "route first last = = = ="; = stands for as on weekdays."""
    return F.concat_ws(" ", route, first, last, F.lit("= = = ="))


SLOTS = ("wd_first", "wd_last", "sat_first", "sat_last", "sun_first", "sun_last")


def parse_first_last(entry: Column, words: Column | None = None) -> Column:
    """Struct of the route and six slots: the last six words are times if there are seven or more, else words in turn; of the entry's ``words`` if they are known."""
    words = F.split(entry, r"\s+") if words is None else words
    n = F.size(words)
    long = n >= 7
    route = F.when(long, F.array_join(F.slice(words, 1, F.greatest(n - 6, F.lit(1))), " ")).otherwise(F.get(words, F.lit(0)))
    slots = [F.when(long, F.get(words, n - 6 + i)).otherwise(F.get(words, F.lit(i + 1))).alias(s) for i, s in enumerate(SLOTS)]
    return F.struct(route.alias("route"), *slots)


def is_timing(time: Column) -> Column:
    """Four digits are present."""
    return F.coalesce(time.rlike(r"\d{4}"), F.lit(False))


def hhmm_to_hours(time: Column) -> Column:
    return F.substring(time, 1, 2).try_cast("int") + F.substring(time, 3, 99).try_cast("int") / F.lit(60.0)


def service_span(first: Column, last: Column) -> Column:
    """Struct of start_hours, duration (hours, past midnight if last is before first), left and width (percent of a day) and wrap (percent past midnight)."""
    a, b = hhmm_to_hours(first), hhmm_to_hours(last)
    duration = F.when(b < a, b + 24).otherwise(b) - a
    left, width = a / 24 * 100, duration / 24 * 100
    return F.struct(a.alias("start_hours"), duration.alias("duration"), left.alias("left"), width.alias("width"), F.greatest(left + width - 100, F.lit(0.0)).alias("wrap"))


def format_duration(hours: Column) -> Column:
    """Whole hours and rounded minutes, as "3h 5m"."""
    return F.concat(F.floor(hours).cast("string"), F.lit("h "), F.round((hours - F.floor(hours)) * 60).cast("int").cast("string"), F.lit("m"))


def format_hhmm(time: Column) -> Column:
    """HHMM as HH:MM, "-" without four digits."""
    return F.when(is_timing(time), F.concat(F.substring(time, 1, 2), F.lit(":"), F.substring(time, 3, 2))).otherwise(F.lit("-"))


def parse_ist(text: Column) -> Column:
    """UTC timestamp without zone of DD-MM-YYYY HH:MM:SS in Indian time; a missing time is midnight, blank or bad text null."""
    t = F.trim(text)
    full = F.when(t.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.concat(t, F.lit(" 00:00:00"))).otherwise(t)
    return F.to_timestamp_ntz(F.when(full.rlike(r"^\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}$"), full), F.lit("dd-MM-yyyy HH:mm:ss")) - F.expr("interval 330 minutes")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a UTC timestamp without zone, whatever the session's zone."""
    return (F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) / 1000).cast("long")


def duration_ms(arrival: Column, now: Column) -> Column:
    return (F.timestamp_diff("MICROSECOND", now, arrival) / 1000).cast("long")


def schedule_duration_ms(hhmm: Column, now_hhmm: Column) -> Column:
    """Difference of times of day, without wrap at midnight."""
    return ((_part(hhmm, 0) * 60 + _part(hhmm, 1)) - (_part(now_hhmm, 0) * 60 + _part(now_hhmm, 1))).cast("long") * 60000


def arrival_text(ms: Column) -> Column:
    """Arr for less than a minute, else whole minutes as "5m"; null stays null."""
    mins = F.floor(ms / 60000)
    return F.when(mins <= 0, "Arr").otherwise(F.concat(mins.cast("string"), F.lit("m")))


def arrival_label(ms: Column) -> Column:
    """N/A without a duration or at 0, Arriving in the first minute or past, else 1 min or N min."""
    mins = F.floor(ms / 60000)
    text = F.when(mins <= 0, "Arriving").when(mins == 1, "1 min").otherwise(F.concat(mins.cast("string"), F.lit(" min")))
    return F.when(ms.isNull() | (ms == 0), "N/A").otherwise(text)
