"""Stop schedules, first and last times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import SLOTS, first_last_entry, gtfs_hhmm, hhmm_packed, is_timing, parse_first_last
from .patterns import route_endpoints


def timed_visits(stop_times: DataFrame, service_day: bool = False) -> DataFrame:
    """Visits with ``hhmm`` from arrival_time, or departure_time where it is null; visits with an empty or null time are left out."""
    time = F.coalesce("arrival_time", "departure_time") if "departure_time" in stop_times.columns else F.col("arrival_time")
    return stop_times.withColumn("time", time).where("time <> ''").withColumn("hhmm", gtfs_hhmm(F.col("time"), service_day)).drop("time")


def directed_visits(directed: DataFrame, stop_times: DataFrame, service_day: bool = False) -> DataFrame:
    """(feed, stop, route, direction, hhmm) of timed visits."""
    visits = timed_visits(stop_times, service_day).join(directed.select("feed_id", "trip_id", "route_id", "direction"), ["feed_id", "trip_id"])
    return visits.select("feed_id", "stop_id", "route_id", "direction", "hhmm")


def trip_counts(directed: DataFrame, stop_times: DataFrame, service_day: bool = False) -> DataFrame:
    """(feed, stop, no, direction, trip_count) of the schedule, in the stop's task, without times and endpoints."""
    visits = directed_visits(directed, stop_times, service_day).repartition("feed_id", "stop_id")
    return visits.groupBy("feed_id", "stop_id", F.col("route_id").alias("no"), "direction").agg(F.count_distinct("hhmm").alias("trip_count"))


def first_last_of_visits(directed: DataFrame, stop_times: DataFrame, service_day: bool = False) -> DataFrame:
    """``first_last`` of the schedule, from visits in the stop's task, without lists of times and endpoints."""
    some = directed_visits(directed, stop_times, service_day).where("route_id <> ''").repartition("feed_id", "stop_id")
    return packed_ends(some.groupBy("feed_id", "stop_id", F.col("route_id").alias("no")).agg(F.min("hhmm").alias("first"), F.max("hhmm").alias("last")))


def stop_schedule(directed: DataFrame, stop_times: DataFrame, service_day: bool = False) -> DataFrame:
    """(feed, stop, no, direction, origin, destination, trips, trip_count).

    trips are the distinct times in order and trip_count their number. Endpoints of
    directions without a known representative trip are empty texts.
    """
    visits = directed_visits(directed, stop_times, service_day)
    grouped = visits.groupBy("feed_id", "stop_id", "route_id", "direction").agg(F.array_sort(F.collect_set("hhmm")).alias("trips"))
    ends = route_endpoints(directed, stop_times)
    out = grouped.join(ends, ["feed_id", "route_id", "direction"], "left")
    return out.select("feed_id", "stop_id", F.col("route_id").alias("no"), "direction", F.coalesce("origin", F.lit("")).alias("origin"), F.coalesce("destination", F.lit("")).alias("destination"), "trips", F.size("trips").alias("trip_count"))


def first_last(schedule: DataFrame) -> DataFrame:
    """(feed, stop, no, first, last, entry) over all directions; services without number or trips are left out."""
    some = schedule.where("no <> '' and size(trips) > 0")
    ends = some.groupBy("feed_id", "stop_id", "no").agg(F.min(F.array_min("trips")).alias("first"), F.max(F.array_max("trips")).alias("last"))
    return packed_ends(ends)


def packed_ends(ends: DataFrame) -> DataFrame:
    """Packs ``first`` and ``last`` and adds their ``entry``."""
    packed = ends.withColumn("first", hhmm_packed(F.col("first"))).withColumn("last", hhmm_packed(F.col("last")))
    return packed.withColumn("entry", first_last_entry(F.col("no"), F.col("first"), F.col("last")))


def combine_first_last(entries: DataFrame) -> DataFrame:
    """Rows (feed, stop, entry) as one row for each route with six slots: earliest first and latest last of each kind of day.

    Only pairs whose first is a timing take part; a route without any keeps "=".
    """
    words = entries.select("feed_id", "stop_id", "entry", F.split("entry", r"\s+").alias("words"))
    parsed = words.select("feed_id", "stop_id", parse_first_last(F.col("entry"), F.col("words")).alias("p")).select("feed_id", "stop_id", "p.*")
    cols = []
    for first, last in zip(SLOTS[::2], SLOTS[1::2], strict=True):
        ok = is_timing(F.col(first))
        cols += [F.coalesce(F.min(F.when(ok, F.col(first))), F.lit("=")).alias(first), F.coalesce(F.max(F.when(ok, F.col(last))), F.lit("=")).alias(last)]
    return parsed.groupBy("feed_id", "stop_id", "route").agg(*cols)


def weekend_flags(combined: DataFrame) -> DataFrame:
    """(feed, stop, has_saturday, has_sunday)."""
    has = lambda *slots: F.bool_or(F.greatest(*(is_timing(F.col(s)) for s in slots)))
    return combined.groupBy("feed_id", "stop_id").agg(has(*SLOTS[2:4]).alias("has_saturday"), has(*SLOTS[4:]).alias("has_sunday"))
