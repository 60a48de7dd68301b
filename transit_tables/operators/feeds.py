"""Directions of trips, valid routes, served stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUTE = ["feed_id", "route_id"]


def named_direction(name: Column) -> Column:
    """"0" for names with UP, else "1" for names with DOWN, else "0"; null names are "0"."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    return F.when(upper.contains("UP"), "0").when(upper.contains("DOWN"), "1").otherwise("0")


def _by_name(trips: DataFrame) -> Column:
    """Whether a trip's feed has no direction_id: the whole table lacks it, or its ``absent`` lists it."""
    if "direction_id" not in trips.columns:
        return F.lit(True)
    return F.array_contains("absent", "direction_id") if "absent" in trips.columns else F.lit(False)


def _given_direction(trips: DataFrame) -> Column:
    return F.coalesce(F.col("direction_id").try_cast("int"), F.lit(0)).cast("string") if "direction_id" in trips.columns else F.lit("0")


def with_direction(trips: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Trips with a text ``direction``: direction_id, 0 if null; in feeds without that column, from the route's name.

    Names count only if ``routes`` is given; it must be for tables without direction_id.
    """
    if "direction_id" in trips.columns and (routes is None or "absent" not in trips.columns):
        return trips.withColumn("direction", _given_direction(trips))
    names = routes.select(*ROUTE, "route_long_name").dropDuplicates(ROUTE)
    direction = F.when(_by_name(trips), named_direction(F.col("route_long_name"))).otherwise(_given_direction(trips))
    return trips.join(names, ROUTE, "left").withColumn("direction", direction).drop("route_long_name")


def pattern_directions(trips: DataFrame, routes: DataFrame | None = None, only_known: bool = True) -> DataFrame:
    """Trips with the direction they count for in patterns.

    In feeds without direction_id a trip counts for "0" if its route's name has UP or
    lacks DOWN, and for "1" if it has DOWN, so for both with UP and DOWN. Directions
    other than "0" and "1" are left out if ``only_known``.
    """
    if "direction_id" in trips.columns and (routes is None or "absent" not in trips.columns):
        out = with_direction(trips)
    else:
        names = routes.select(*ROUTE, "route_long_name").dropDuplicates(ROUTE)
        upper = F.upper(F.coalesce("route_long_name", F.lit("")))
        down = upper.contains("DOWN")
        both = F.filter(F.array(F.when(upper.contains("UP") | ~down, "0"), F.when(down, "1")), lambda x: x.isNotNull())
        directions = F.when(_by_name(trips), both).otherwise(F.array(_given_direction(trips)))
        out = trips.join(names, ROUTE, "left").withColumn("direction", F.explode(directions)).drop("route_long_name")
    return out.where(F.col("direction").isin("0", "1")) if only_known else out


def trip_counts(directed: DataFrame) -> DataFrame:
    """(feed, route, direction, trips) in long form."""
    return directed.groupBy(*ROUTE, "direction").agg(F.count("*").alias("trips"))


def trip_counts_pivoted(directed: DataFrame) -> DataFrame:
    """One row for each route with counts of directions 0 and 1, 0 if none."""
    return directed.groupBy(*ROUTE).agg(F.count_if(F.col("direction") == "0").alias("trips_0"), F.count_if(F.col("direction") == "1").alias("trips_1"))


def valid_routes(directed: DataFrame, min_trips: int = 2, directions: tuple[str, ...] | None = None) -> DataFrame:
    """(feed, route) of routes with ``min_trips`` trips or more in some direction.

    A feed without such a route keeps every route that has a trip. ``directions``
    limits which count; by default all do.
    """
    counted = directed if directions is None else directed.where(F.col("direction").isin(*directions))
    most = trip_counts(counted).groupBy(*ROUTE).agg(F.max("trips").alias("most"))
    feed_most = most.groupBy("feed_id").agg(F.max("most").alias("feed_most"))
    kept = most.join(feed_most, "feed_id").where((F.col("most") >= min_trips) | ((F.col("feed_most") < min_trips) & (F.col("most") >= 1)))
    return kept.select(*ROUTE)


def valid_trips(trips: DataFrame, routes: DataFrame) -> DataFrame:
    return trips.join(routes, ROUTE, "left_semi")


def served_stops(stops: DataFrame, stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """(feed, stop, lon, lat, name) of stops that the given trips visit; null coordinates stay."""
    visits = stop_times.join(trips, ["feed_id", "trip_id"], "left_semi").select("feed_id", "stop_id").distinct()
    return stops.join(visits, ["feed_id", "stop_id"], "left_semi").select("feed_id", "stop_id", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"), F.col("stop_name").alias("name"))


def unknown_references(trips: DataFrame, stop_times: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """For each feed: trips of unknown routes, visits to unknown stops, stops without coordinates."""
    lost = trips.join(routes, ROUTE, "left_anti").groupBy("feed_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("trip_without_route"))
    gone = stop_times.join(stops, ["feed_id", "stop_id"], "left_anti").groupBy("feed_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("visit_to_unknown_stop"))
    bare = stops.where("stop_lat is null or stop_lon is null").groupBy("feed_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("stop_without_coordinates"))
    return lost.unionByName(gone).unionByName(bare).select("feed_id", "what", "n")


def numbered_visits(stop_times: DataFrame) -> DataFrame:
    """Visits with their 1-based position in the trip and the stops before and after; ties of stop_sequence by ``ord``."""
    order = Window.partitionBy("feed_id", "trip_id").orderBy("stop_sequence", "ord")
    return stop_times.withColumn("pos", F.row_number().over(order)).withColumn("prev_stop", F.lag("stop_id").over(order)).withColumn("next_stop", F.lead("stop_id").over(order))
