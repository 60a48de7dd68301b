"""Canonical arrivals and vehicles, boards, and the streams made of them."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from transit_tables.operators import live
from transit_tables.sources import live as sources
from transit_tables.streaming import live as streams

NOW = "timestamp_ntz'2024-01-01 00:00:00'"
PREDICTION = "feed_id string, stop_id string, no string, destination string, duration_ms long, vehicle_id string, devicestatusflag int, ord long"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def payload(station, *trips, ok=True):
    """trips: (number, destination, minutes past 05:30 Indian time, bus)."""
    data = [{"routeno": n, "tostationname": d, "fromstationname": "Depot", "arrivaltime": f"01-01-2024 05:{30 + m:02d}:00", "vehicleid": f"v{b}", "busno": f"KA{b}", "devicestatusflag": b % 2} for n, d, m, b in trips]
    return json.dumps({"Issuccess": ok, "station": station, "data": data})


def drained(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_arrivals_in_canonical_form(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(payload("20", ("7", "X", 5, 1), ("", "X", 6, 2), ("7", "Y", 1, 3), ("7", "X", 3, 4), (None, "X", 2, 5)))
    (tmp_path / "a" / "2.json").write_text(payload("21", ("9", "Z", 1, 9), ok=False))
    services = live.live_services(sources.arrivals_rows(sources.read_payloads(spark, f"{tmp_path}/a", sources.ARRIVALS), F.expr(NOW)))
    got = {(r.stop_id, r.no, r.destination): r for r in services.collect()}
    assert set(got) == {("20", "7", "X"), ("20", "7", "Y")}
    x = got["20", "7", "X"]
    assert (x.frequency, x.next3, x.ord) == (2, None, 0)
    assert x.next.asDict() == {"duration_ms": 180_000, "type": "SD", "load": "SDA", "feature": "WAB", "visit_number": 1, "origin_code": "Depot", "destination_code": "X", "vehicle_id": "v4", "bus_no": "KA4", "location": None}
    grouped = live.group_by_service(services).first()
    assert (grouped.destination, grouped.frequency) == ("X", 2)  # of the first listing, not the sum
    assert [a.duration_ms for a in grouped.arrivals] == [180_000, 300_000, 60_000]  # service by service
    board = live.service_board(services, spark.createDataFrame([("live", "8")], "feed_id string, no string")).orderBy("place").collect()
    assert [(r.destination, r.frequency, r.pinned, [b.bus_no for b in r.buses]) for r in board] == [("X", 2, False, ["KA4", "KA1"]), ("Y", 1, False, ["KA3"])]
    assert rows(live.service_issues(services), "no", "issue") == [("7", True)]


def test_later_visits_and_missing_destinations(spark):
    p = spark.createDataFrame([("l", "s", "1", "d", 5, "v", 1, 0, 1), ("l", "s", "1", "d", 9, "w", 1, 1, 2), ("l", "s", "2", "", 7, "x", 0, 2, 1)], PREDICTION + ", visit_number int")
    services = live.live_services(p.withColumn("destination_code", F.lit("far")))
    assert rows(live.service_issues(services), "no", "issue") == [("1", True), ("2", False)]
    pinned = spark.createDataFrame([("l", "2")], "feed_id string, no string")
    assert [(r.no, r.destination) for r in live.service_board(services, pinned).orderBy("place").collect()] == [("2", "far"), ("1", "d")]
    assert rows(live.active_pinned(pinned, services), "no") == [("2",)] and rows(live.data_present(services), "fresh") == [(True,)]
    assert live.service_board(services.limit(0), pinned).count() == live.group_by_service(services.limit(0)).count() == 0


def test_vehicles_in_canonical_form(spark, tmp_path):
    one = {"vehicleid": "5", "vehiclenumber": "K5", "servicetype": "AC", "servicetypeid": 3, "centerlat": "12.9", "centerlong": "77.5", "heading": 90, "lastrefreshon": "01-01-2024 05:31:00", "eta": "", "sch_arrivaltime": "06:00", "actual_departuretime": "06:02", "laststop": "A", "nextlocationid": "N", "stopCoveredStatus": 1, "tripposition": 2, "lastreceiveddatetimeflag": 0}
    (tmp_path / "v.json").write_text(json.dumps({"up": {"data": [{"routeno": "1", "stationname": "S", "vehicleDetails": [one]}]}}))
    r = sources.vehicle_rows(sources.read_payloads(spark, str(tmp_path), sources.VEHICLES)).first()
    assert (r.vehicle_id, r.service_type, r.service_type_id, r.heading, r.lat, r.direction, r.stationname) == ("5", "AC", 3, 90.0, 12.9, "up", "S")
    assert (r.eta, r.scheduled_arrival, r.scheduled_end, r.actual_departure) == (None, "06:00", None, "06:02")
    assert (r.last_stop, r.next_location, r.current_stop, r.stop_covered, r.trip_position, r.last_received) == ("A", "N", None, 1, 2, 0)
    assert (r.last_refresh, r.last_refresh_ms) == ("01-01-2024 05:31:00", 1704067260000)


def test_buses_are_matched_from_landed_payloads(spark, tmp_path):
    """The whole way: payload files, canonical rows, ids that stay from one refresh to the next."""
    (tmp_path / "in").mkdir()
    for i, trips in enumerate(([("7", "X", 10, 1), ("7", "X", 20, 2)], [("7", "X", 9, 1), ("7", "X", 28, 3)], [("7", "X", 27, 3)]), 1):
        (tmp_path / "in" / f"{i}.json").write_text(payload("20", *trips))
        time.sleep(0.02)
    landed = spark.readStream.schema(sources.ARRIVALS).option("multiLine", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    numbered = landed.withColumn("n", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1))
    predictions = sources.arrivals_rows(numbered, F.expr(NOW), snapshot=F.col("n"))
    drained(streams.match_predictions(predictions, timeout="NoTimeout").writeStream.format("memory").queryName("matched").option("checkpointLocation", f"{tmp_path}/cp").start())
    got = rows(spark.table("matched"), "snapshot_id", "bus_id", "duration_ms", "ghost")
    assert got == [(1, 0, 600_000, False), (1, 1, 1_200_000, False), (2, 0, 540_000, False), (2, 1, 1_200_000, True), (2, 2, 1_680_000, False), (3, 0, 540_000, True), (3, 2, 1_620_000, False)]


def test_services_stream_falls_back_to_the_schedule(spark, tmp_path):
    data = [("l", "a", "1", "d", 60_000, "v", 1, 0), ("l", "b", "1", "d", -5, "v", 1, 1)]
    spark.createDataFrame(data, PREDICTION).coalesce(1).write.parquet(f"{tmp_path}/p")
    schedule = spark.createDataFrame([("l", s, "2", "x", ["08:10", "09:50"]) for s in "ab"], "feed_id string, stop_id string, no string, destination string, trips array<string>")
    static, seen = live.static_services(schedule, F.lit("08:00")), []
    source = spark.readStream.schema(PREDICTION).parquet(f"{tmp_path}/p")
    drained(streams.stream_live_services(source, lambda df, _: seen.extend(df.collect()), f"{tmp_path}/cp", static))
    assert sorted((r.stop_id, r.no, r.live, r.next.duration_ms) for r in seen) == [("a", "1", True, 60_000), ("b", "2", False, 600_000)]


SEEN = "feed_id string, routeno string, vehicle_number string, snapshot_id long, direction string, ts timestamp, ord long"


def test_snapshots_are_deduplicated_and_tracked(spark, tmp_path):
    at = datetime(2024, 1, 1)
    data = [("l", "7", "k", 1, "down", at, 0), ("l", "7", "k", 1, "up", at, 5), ("l", "7", "k", 1, "up", at, 3), ("l", "8", "m", 1, "down", at, 1), ("l", "7", "k", 2, "down", at, 0)]
    spark.createDataFrame(data, SEEN).coalesce(1).write.parquet(f"{tmp_path}/v")
    source = spark.readStream.schema(SEEN).parquet(f"{tmp_path}/v")
    first, tracked, every = [], [], []
    following = {"now": [("l", "7")]}
    only = streams.tracked_only(None, lambda: spark.createDataFrame(following["now"], "feed_id string, routeno string"))

    def each(batch, epoch):
        first.extend(streams.first_of_snapshots(batch, epoch).collect())
        tracked.extend(only(batch, epoch).collect())
        following["now"] = [("l", "none")]
        every.extend(only(batch, epoch).collect())

    drained(source.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/cp").start())
    assert sorted((r.snapshot_id, r.vehicle_number, r.direction, r.ord) for r in first) == [(1, "k", "up", 3), (1, "m", "down", 1), (2, "k", "down", 0)]
    assert {r.routeno for r in tracked} == {"7"} and len(tracked) == 4 and not every
    drained(streams.dedupe_snapshots(source).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp2").start())
    assert rows(spark.table("once"), "snapshot_id", "vehicle_number") == [(1, "k"), (1, "m"), (2, "k")]


def test_staleness(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (None,)], "ts timestamp")
    assert rows(streams.with_staleness(df, F.lit("2024-01-01 00:01:30").cast("timestamp")), "stale_s") == [(90,), (None,)]


def test_positions_go_when_their_service_is_unpinned(spark, tmp_path):
    pin, seen = "feed_id string, no string, pinned boolean, ord long", "feed_id string, no string, vehicle_id string, lat double, lng double, ord long"
    pins = [[("l", "7", True, 1)], [("l", "8", True, 11)], [("l", "7", False, 21)]]
    vehicles = [[("l", "7", "a", 1.0, 2.0, 2), ("l", "7", "b", 1.0, 2.0, 3), ("l", "8", "c", 1.0, 2.0, 4)], [("l", "7", "a", 1.5, 2.0, 12), ("l", "8", "c", 3.0, 2.0, 13)], [("l", "7", "a", 9.0, 9.0, 22), ("l", "8", "c", 4.0, 2.0, 23)]]
    for i, (p, v) in enumerate(zip(pins, vehicles, strict=True)):
        spark.createDataFrame(p, pin).coalesce(1).write.parquet(f"{tmp_path}/pins/{i}")
        spark.createDataFrame(v, seen).coalesce(1).write.parquet(f"{tmp_path}/seen/{i}")
    stream = lambda kind, path: spark.readStream.schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{path}")
    drained(streams.cached_positions(stream(seen, "seen"), stream(pin, "pins"), timeout="NoTimeout").writeStream.format("memory").queryName("cached").option("checkpointLocation", f"{tmp_path}/cp").start())
    assert rows(spark.table("cached"), "no", "vehicle_id", "lat", "gone") == sorted(
        [("7", "a", 1.0, False), ("7", "b", 1.0, False), ("7", "a", 1.5, False), ("7", "a", None, True), ("7", "b", None, True), ("8", "c", 3.0, False), ("8", "c", 4.0, False)], key=str
    )


def test_silent_services_are_forgotten_and_state_outlives_a_restart(spark, tmp_path):
    """Each step is a query of its own that goes on from the checkpoint."""
    pin, seen = "feed_id string, no string, pinned boolean, ord long", "feed_id string, no string, vehicle_id string, lat double, lng double, ord long"
    stream = lambda kind, path: spark.readStream.schema(kind).parquet(f"{tmp_path}/{path}")

    def step(pins, vehicles, silence_ms):
        got = []
        for path, kind, data in (("pins", pin, pins), ("seen", seen, vehicles)):
            spark.createDataFrame(data, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{path}")
        query = streams.cached_positions(stream(seen, "seen"), stream(pin, "pins"), silence_ms=silence_ms)
        query.writeStream.foreachBatch(lambda batch, _: got.extend(tuple(r)[1:] for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start().awaitTermination()
        return sorted(got, key=str)

    long = 600_000
    assert step([("l", "7", True, 1), ("l", "8", True, 1)], [("l", "7", "a", 1.0, 2.0, 2)], long) == [("7", "a", 1.0, 2.0, False)]
    assert step([], [("l", "7", "b", 1.0, 2.0, 3), ("l", "8", "c", 1.0, 2.0, 3)], 500) == [("7", "b", 1.0, 2.0, False), ("8", "c", 1.0, 2.0, False)]
    time.sleep(1)  # both are silent for longer than they may be
    gone = step([("l", "9", True, 4)], [("l", "9", "d", 1.0, 2.0, 5)], long)
    assert gone == [("7", "a", None, None, True), ("7", "b", None, None, True), ("8", "c", None, None, True), ("9", "d", 1.0, 2.0, False)]
    assert step([], [("l", "7", "a", 3.0, 4.0, 6), ("l", "9", "d", 3.0, 4.0, 6)], long) == [("9", "d", 3.0, 4.0, False)]


def test_lost_snapshots_give_the_schedule(spark, tmp_path):
    at = lambda minute, second=0: datetime(2024, 1, 1, 8, minute, second)
    due, came = "feed_id string, stop_id string, due timestamp", "feed_id string, stop_id string, ts timestamp"
    schedule = spark.createDataFrame([("l", s, "2", "x", ["08:10"]) for s in "ab"], "feed_id string, stop_id string, no string, destination string, trips array<string>")
    static, lost, shown = live.static_services(schedule, F.lit("08:00")), [], []

    def each(batch, _):
        lost.extend((r.stop_id, r.due) for r in batch.collect())
        shown.extend((r.stop_id, r.no, r.next.duration_ms) for r in streams.lost_to_schedule(batch, static).collect())

    steps = [([(s, at(0)) for s in "ab"], [("a", at(0, 10)), ("b", at(1))]), ([("a", at(20))], [("a", at(20, 29))]), ([("a", at(40))], [("a", at(40, 1))]), ([("a", at(59))], [("a", at(59))])]
    for expected, arrived in steps:
        for path, kind, data in (("due", due, expected), ("came", came, arrived)):
            spark.createDataFrame([("l", *x) for x in data], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{path}")
        source = lambda path, kind: spark.readStream.schema(kind).parquet(f"{tmp_path}/{path}")
        query = streams.lost_snapshots(source("due", due), source("came", came), watermark="1 minute")
        query.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start().awaitTermination()
    assert lost == [("b", at(0))] and shown == [("b", "2", 600_000)]  # b's snapshot came after its grace


def test_a_batch_is_tried_again_and_given_once(spark, tmp_path):
    batch, seen, fails = spark.createDataFrame([(1,)], "n int"), [], iter([True, False, True, True, True])

    def sink(rows, epoch):
        if next(fails, False):
            raise ValueError("no sink")
        seen.append((epoch, rows.count()))

    each = streams.retried(sink, f"{tmp_path}/marks")
    each(batch, 0)
    each(batch, 0)  # replayed after a restart
    with pytest.raises(ValueError):
        each(batch, 1)  # three failures
    each(batch, 1)
    assert seen == [(0, 1), (1, 1)]


def test_schema_is_checked(spark):
    with pytest.raises(ValueError):
        live.live_services(spark.createDataFrame([("l",)], "feed_id string"))
