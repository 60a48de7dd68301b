"""Landed live payloads as rows; the same readers serve batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import duration_ms, epoch_ms, parse_ist

ARRIVALS = "Issuccess boolean, station string, data array<struct<routeno:string,tostationname:string,fromstationname:string,arrivaltime:string,vehicleid:string,busno:string,devicestatusflag:int>>"
#: Text fields of a vehicle beside its ids, place and last refresh, and their canonical names.
TIMES = {
    "sch_arrivaltime": "scheduled_arrival", "sch_departuretime": "scheduled_departure", "sch_tripstarttime": "scheduled_start", "sch_tripendtime": "scheduled_end",
    "actual_arrivaltime": "actual_arrival", "actual_departuretime": "actual_departure", "eta": "eta",
}
PLACES = {"laststop": "last_stop", "currentstop": "current_stop", "nextstop": "next_stop", "lastlocationid": "last_location", "currentlocationid": "current_location", "nextlocationid": "next_location"}
WHOLE = {"servicetypeid": "service_type_id", "stopCoveredStatus": "stop_covered", "tripposition": "trip_position", "lastreceiveddatetimeflag": "last_received"}
VEHICLE = ["vehicleid", "vehiclenumber", "servicetype", "centerlat", "centerlong", "heading", "lastrefreshon", *TIMES, *PLACES, *WHOLE]
STATION = f"array<struct<routeid:string,stationid:string,stationname:string,routeno:string,vehicleDetails:array<struct<{','.join(f'{c}:string' for c in VEHICLE)}>>>>"
VEHICLES = f"up struct<data:{STATION}>, down struct<data:{STATION}>"


def read_payloads(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).option("multiLine", True).json(path)


def arrivals_rows(payloads: DataFrame, now, feed_id: str = "live", snapshot=None) -> DataFrame:
    """Canonical predictions of successful payloads; ``now`` is a UTC timestamp column without zone.

    ``snapshot``, a column of the payloads, becomes ``snapshot_id`` for the matching of
    buses from one refresh to the next. Rows without a number are left out.
    """
    marks = [] if snapshot is None else [snapshot.cast("long").alias("snapshot_id")]
    rows = payloads.where("Issuccess").select("station", *marks, F.posexplode("data").alias("ord", "d"))
    d = lambda c: F.col(f"d.{c}")
    canonical = {
        "feed_id": F.lit(feed_id), "stop_id": F.col("station"), "no": d("routeno"), "destination": d("tostationname"), "duration_ms": duration_ms(parse_ist(d("arrivaltime")), now),
        "vehicle_id": d("vehicleid"), "devicestatusflag": d("devicestatusflag"), "ord": F.col("ord").cast("long"), "type": F.lit("SD"), "feature": F.lit("WAB"), "visit_number": F.lit(1),
        "origin_code": d("fromstationname"), "destination_code": d("tostationname"), "bus_no": d("busno"),
    }
    return rows.select(*(c.alias(n) for n, c in canonical.items()), *(["snapshot_id"] if marks else [])).where("no <> ''")


def vehicle_rows(payloads: DataFrame, feed_id: str = "live") -> DataFrame:
    """Canonical vehicles of both directions with their payload order; an absent direction gives none."""
    sides = F.array(*(F.struct(F.lit(s).alias("direction"), F.col(f"{s}.data").alias("data")) for s in ("up", "down")))
    one = payloads.select(F.explode(sides).alias("s")).select("s.direction", F.posexplode("s.data").alias("station_ord", "st"))
    each = one.select("direction", "station_ord", "st.routeno", "st.stationname", F.posexplode("st.vehicleDetails").alias("vehicle_ord", "v"))
    return each.select(
        F.lit(feed_id).alias("feed_id"), F.col("v.vehicleid").alias("vehicle_id"), F.col("v.vehiclenumber").alias("vehicle_number"), "direction", "routeno", "stationname",
        (F.col("station_ord").cast("long") * 100000 + F.col("vehicle_ord")).alias("ord"), parse_ist(F.col("v.lastrefreshon")).alias("ts"), F.col("v.centerlat").try_cast("double").alias("lat"), F.col("v.centerlong").try_cast("double").alias("lng"),
        F.col("v.heading").try_cast("double").alias("heading"), F.col("v.servicetype").alias("service_type"), F.col("v.lastrefreshon").alias("last_refresh"), epoch_ms(parse_ist(F.col("v.lastrefreshon"))).alias("last_refresh_ms"),
        *(F.nullif(F.col(f"v.{c}"), F.lit("")).alias(n) for c, n in TIMES.items()), *(F.col(f"v.{c}").alias(n) for c, n in PLACES.items()), *(F.col(f"v.{c}").try_cast("long").alias(n) for c, n in WHOLE.items()),
    )
