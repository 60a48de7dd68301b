"""Arrivals and vehicle positions in canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import schedule_duration_ms

LIVE_MS = 90 * 60 * 1000
STATIC_MS = 30 * 60 * 1000
SLOTS = ("next", "next2", "next3")
#: Columns of the canonical predictions that live_services takes.
PREDICTIONS = ("feed_id", "stop_id", "no", "destination", "duration_ms", "vehicle_id", "devicestatusflag", "ord")
#: Further fields of an arrival, and what holds where an adapter gives none.
DETAILS = {"type": "'SD'", "feature": "'WAB'", "visit_number": "1", "origin_code": "cast(null as string)", "destination_code": "destination", "bus_no": "cast(null as string)"}
#: An arrival as the slots hold it.
ARRIVAL = ("duration_ms", "type", "load", "feature", "visit_number", "origin_code", "destination_code", "vehicle_id", "bus_no", "location")


def assert_schema(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The same table, if an adapter gave all canonical columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"adapter result lacks {missing}")
    return df


def load_code(flag: Column) -> Column:
    return F.when(flag == 1, "SEA").otherwise("SDA")


def location_present(vehicle: Column, lat: Column, lng: Column) -> Column:
    """Vehicle id, latitude and longitude are given; 0 and empty count as absent."""
    return F.coalesce((vehicle != "") & (lat != 0) & (lng != 0), F.lit(False))


def mappable(lat: Column, lng: Column) -> Column:
    """Numbers, not both 0."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lng) & ~((lat == 0) & (lng == 0)), F.lit(False))


def strict_coordinate(lat: Column, lng: Column) -> Column:
    """A point on the earth other than (0, 0)."""
    return mappable(lat, lng) & F.coalesce((F.abs(lat) <= 90) & (F.abs(lng) <= 180), F.lit(False))


def first_location(location: Column, pair: Column, lat: Column, lng: Column) -> Column:
    """Struct (lat, lng) from a struct, a [lng, lat] array or two fields, the first that is given."""
    return F.coalesce(F.when(location["lat"].isNotNull() & location["lng"].isNotNull(), F.struct(location["lat"].alias("lat"), location["lng"].alias("lng"))), F.when(F.size(pair) >= 2, F.struct(F.get(pair, F.lit(1)).alias("lat"), F.get(pair, F.lit(0)).alias("lng"))), F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng"))))


def live_services(predictions: DataFrame, vehicles: DataFrame | None = None, horizon_ms: int = LIVE_MS) -> DataFrame:
    """(feed, stop, no, destination, frequency, next, next2, next3, ord) of arrivals from now to the horizon.

    frequency counts the arrivals kept; the slots hold the three soonest, ties in
    payload order; ord is the first arrival's place in the payload. Services without a
    number are left out. Locations come from ``vehicles`` (feed, vehicle, lat, lng).
    """
    kept = assert_schema(predictions, PREDICTIONS).where(F.col("duration_ms").between(0, horizon_ms) & (F.col("no") != ""))
    kept = kept.withColumns({c: F.expr(default) for c, default in DETAILS.items() if c not in kept.columns})
    if vehicles is not None:
        kept = kept.join(vehicles.select("feed_id", "vehicle_id", "lat", "lng"), ["feed_id", "vehicle_id"], "left")
    else:
        kept = kept.withColumns({"lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double")})
    location = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng"))
    kept = kept.withColumns({"load": load_code(F.col("devicestatusflag")), "location": location})
    key = ["feed_id", "stop_id", "no", "destination"]
    soonest = Window.partitionBy(*key).orderBy("duration_ms", "ord")
    ranked = kept.withColumn("trip", F.struct(*ARRIVAL)).withColumn("k", F.row_number().over(soonest))
    slots = [F.any_value(F.when(F.col("k") == i + 1, F.col("trip")), True).alias(s) for i, s in enumerate(SLOTS)]
    return ranked.groupBy(*key).agg(F.count("*").alias("frequency"), *slots, F.min("ord").alias("ord"))


def soonest_per_service(services: DataFrame) -> DataFrame:
    """(feed, stop, no, soonest_ms); 0 is a value like others."""
    return services.groupBy("feed_id", "stop_id", "no").agg(F.min("next.duration_ms").alias("soonest_ms"))


def data_present(services: DataFrame) -> DataFrame:
    """(feed, stop, fresh): some service has a next arrival from now on."""
    return services.groupBy("feed_id", "stop_id").agg(F.bool_or(F.coalesce(F.col("next.duration_ms") >= 0, F.lit(False))).alias("fresh"))


def service_issues(services: DataFrame) -> DataFrame:
    """(feed, stop, no, issue): listed twice at the stop, or with a later visit of a loop in some slot."""
    visits = F.greatest(*(F.coalesce(F.col(f"{s}.visit_number"), F.lit(0)) for s in SLOTS))
    return services.groupBy("feed_id", "stop_id", "no").agg(((F.count("*") > 1) | F.bool_or(visits > 1)).alias("issue"))


def _slots() -> Column:
    return F.filter(F.array(*(F.col(s) for s in SLOTS)), lambda x: x.isNotNull())


def _in_payload_order(slots: str) -> Column:
    """The arrivals of a group's services, service by service in payload order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "destination", slots)))
    return F.flatten(F.transform(listed, lambda x: x[slots]))


def group_by_service(services: DataFrame) -> DataFrame:
    """(feed, stop, no, destination, frequency, arrivals): of the service's first listing, and all its slots in payload order."""
    first = F.min_by(F.struct("destination", "frequency"), F.struct("ord", "destination"))
    grouped = services.withColumn("slots", _slots()).groupBy("feed_id", "stop_id", "no").agg(first.alias("f"), _in_payload_order("slots").alias("arrivals"))
    return grouped.select("feed_id", "stop_id", "no", "f.destination", "f.frequency", "arrivals")


def service_board(services: DataFrame, pinned: DataFrame) -> DataFrame:
    """(feed, stop, no, destination, frequency, buses, pinned, place): pinned services first, then by frequency, then in payload order.

    A service without a destination takes its next arrival's.
    """
    named = services.withColumn("destination", F.coalesce(F.nullif("destination", F.lit("")), "next.destination_code")).withColumn("slots", _slots())
    grouped = named.groupBy("feed_id", "stop_id", "no", "destination").agg(F.sum("frequency").alias("frequency"), _in_payload_order("slots").alias("buses"), F.min("ord").alias("ord"))
    marks = pinned.select("feed_id", "no").distinct().withColumn("pinned", F.lit(True))
    marked = grouped.join(marks, ["feed_id", "no"], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    order = Window.partitionBy("feed_id", "stop_id").orderBy(F.desc("pinned"), F.desc("frequency"), "ord", "no", "destination")
    return marked.withColumn("place", F.row_number().over(order)).drop("ord")


def active_pinned(pinned: DataFrame, services: DataFrame) -> DataFrame:
    return pinned.join(services, ["feed_id", "no"], "left_semi")


def static_services(schedule: DataFrame, now_hhmm: Column, horizon_ms: int = STATIC_MS) -> DataFrame:
    """Services of the schedule that come within the horizon, now excluded, without wrap at midnight."""
    each = schedule.select("feed_id", "stop_id", "no", "destination", F.explode("trips").alias("hhmm")).withColumn("duration_ms", schedule_duration_ms(F.col("hhmm"), now_hhmm)).where(f"duration_ms > 0 and duration_ms <= {horizon_ms}")
    each = each.withColumns({"vehicle_id": F.lit(None).cast("string"), "devicestatusflag": F.lit(0), "ord": F.col("duration_ms")})
    return live_services(each, horizon_ms=horizon_ms)


def arrivals_with_fallback(live: DataFrame, static: DataFrame) -> DataFrame:
    """Live services, and static ones of stops without any."""
    rest = static.join(live.select("feed_id", "stop_id").distinct(), ["feed_id", "stop_id"], "left_anti")
    return live.withColumn("live", F.lit(True)).unionByName(rest.withColumn("live", F.lit(False)))


def route_ids(numbers: DataFrame, known: DataFrame) -> DataFrame:
    """(feed, no, route_id) by number regardless of case; the first known route of a number wins."""
    first = known.groupBy("feed_id", F.lower("no").alias("low")).agg(F.min_by("route_id", "ord").alias("route_id"))
    return numbers.withColumn("low", F.lower("no")).join(first, ["feed_id", "low"], "left").drop("low")


def dedupe_vehicles(vehicles: DataFrame) -> DataFrame:
    """The first record of each vehicle number: up before down, then payload order."""
    order = Window.partitionBy("feed_id", "vehicle_number").orderBy(F.when(F.col("direction") == "up", 0).otherwise(1), "ord")
    return vehicles.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def vehicle_map(vehicles: DataFrame) -> DataFrame:
    """One record of each vehicle id that has a location: the last of up, else the first of down."""
    up = F.col("direction") == "up"
    order = Window.partitionBy("feed_id", "vehicle_id").orderBy(F.when(up, 0).otherwise(1), F.when(up, -F.col("ord")).otherwise(F.col("ord")))
    placed = vehicles.where(location_present(F.col("vehicle_id"), F.col("lat"), F.col("lng")))
    return placed.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def latest_positions(vehicles: DataFrame) -> DataFrame:
    """(feed, vehicle, ts, lat, lng) of the newest mappable record, the later in payload order if equal."""
    ok = vehicles.where(mappable(F.col("lat"), F.col("lng")))
    return ok.groupBy("feed_id", "vehicle_id").agg(F.max_by(F.struct("ts", "lat", "lng"), F.struct("ts", "ord")).alias("p")).select("feed_id", "vehicle_id", "p.*")


def vehicles_by_stop(vehicles: DataFrame) -> DataFrame:
    """(feed, stop, vehicles): at the first location id that is given of last, current and next."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    at = vehicles.withColumn("stop_id", F.coalesce(given("last_location"), given("current_location"), given("next_location"))).where("stop_id is not null")
    return at.groupBy("feed_id", "stop_id").agg(F.array_sort(F.collect_set("vehicle_id")).alias("vehicles"))


def with_location(vehicles: DataFrame, positions: DataFrame) -> DataFrame:
    """Vehicles with the position known for their id, null if none."""
    return vehicles.join(positions.select("feed_id", "vehicle_id", F.struct("lat", "lng").alias("location")), ["feed_id", "vehicle_id"], "left")
