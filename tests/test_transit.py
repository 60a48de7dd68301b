"""Hand-made feeds with expected results, golden lines, sinks and streams."""

import json
import random
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from transit_tables.functions import clock, geo, order
from transit_tables.operators import diagram, feeds, graphs, importance, live, network, pairing, patterns, report, schedule, search, shapes
from transit_tables.sources import artefacts
from transit_tables.sources import feeds as feed_sources
from transit_tables.sources import live as live_sources
from transit_tables.streaming import live as streams

ROUTES = [("a", "1", "Line UP"), ("a", "2_x", "Line DOWN"), ("a", "3", None), ("a", "4", "JUPITER UP DOWN")]
TRIPS = [("a", "t1", "1", 0, 1), ("a", "t2", "1", 0, 2), ("a", "t3", "1", 1, 3), ("a", "t4", "2_x", None, 4), ("a", "t5", "3", 1, 5), ("a", "t6", "1", 0, 6)]
TIMES = [
    ("a", "t1", "A", 1, 1, "08:00:00", None), ("a", "t1", "B", 2, 2, "08:05:00", None), ("a", "t1", "C", 3, 3, "24:30:00", None),
    ("a", "t2", "A", 1, 4, None, "09:00:00"), ("a", "t2", "B", 2, 5, "", "09:05:00"), ("a", "t2", "C", 3, 6, "later", None),
    ("a", "t3", "C", 1, 7, "10:00:00", None), ("a", "t3", "B", 1, 8, "10:05:00", None), ("a", "t3", "A", 2, 9, "25:05:10", None),
    ("a", "t4", "A", 1, 10, "07:00:00", None), ("a", "t4", "D", 2, 11, "07:10:00", None), ("a", "t4", "A", 3, 12, "07:20:00", None),
]
STOPS = [("a", "A", 77.5, 12.9, "Alpha", 1), ("a", "B", 77.51, 12.9, "Main int", 2), ("a", "C", 77.53, 12.91, "Opp Gamma Int", 3), ("a", "D", None, None, "Delta", 4), ("a", "E", 77.9, 13.3, "Far", 5)]


@pytest.fixture(scope="module")
def feed(spark):
    return {
        "routes": spark.createDataFrame(ROUTES, "feed_id string, route_id string, route_long_name string"),
        "trips": spark.createDataFrame(TRIPS, "feed_id string, trip_id string, route_id string, direction_id int, ord long"),
        "times": spark.createDataFrame(TIMES, "feed_id string, trip_id string, stop_id string, stop_sequence int, ord long, arrival_time string, departure_time string"),
        "stops": spark.createDataFrame(STOPS, "feed_id string, stop_id string, lon double, lat double, name string, ord long"),
    }


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'long' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_directions(feed):
    assert rows(feeds.with_direction(feed["trips"]), "trip_id", "direction")[3] == ("t4", "0")
    bare = feed["trips"].drop("direction_id")
    assert rows(feeds.with_direction(bare, feed["routes"]), "trip_id", "direction") == [("t1", "0"), ("t2", "0"), ("t3", "0"), ("t4", "1"), ("t5", "0"), ("t6", "0")]
    both = feed["routes"].sparkSession.createDataFrame([("a", "z", "4", 1)], "feed_id string, trip_id string, route_id string, ord long")
    assert rows(feeds.pattern_directions(both, feed["routes"]), "direction") == [("0",), ("1",)]


def test_valid_routes(feed):
    directed = feeds.with_direction(feed["trips"])
    assert rows(feeds.valid_routes(directed), "route_id") == [("1",)]
    assert rows(feeds.valid_routes(directed, 99), "route_id") == [("1",), ("2_x",), ("3",)]
    assert feeds.valid_routes(directed.limit(0)).count() == 0


def test_patterns(feed):
    got = rows(patterns.service_patterns(feeds.with_direction(feed["trips"]), feed["times"]), "route_id", "destination", "dest_rank", "variant_idx", "stops", "pattern_trips")
    assert got == [("1", "A", 2, 0, ["C", "B", "A"], 1), ("1", "C", 1, 0, ["A", "B", "C"], 2), ("2_x", "A", 1, 0, ["A", "D", "A"], 1)]
    ends = rows(patterns.route_endpoints(feeds.with_direction(feed["trips"]), feed["times"]), "route_id", "direction", "origin", "destination")
    assert ends == [("1", "0", "A", "C"), ("1", "1", "C", "A"), ("2_x", "0", "A", "A")]


def test_schedule_and_first_last(feed):
    directed = feeds.with_direction(feed["trips"])
    got = {(r.stop_id, r.no, r.direction): (r.trips, r.origin, r.destination) for r in schedule.stop_schedule(directed, feed["times"]).collect()}
    assert got["A", "1", "0"] == (["08:00", "09:00"], "A", "C")
    assert got["C", "1", "0"][0] == ["00:30", "later"] and got["B", "1", "0"][0] == ["08:05"]
    assert got["A", "1", "1"][0] == ["01:05"]
    entries = schedule.first_last(schedule.stop_schedule(directed, feed["times"]))
    assert ("A", "1 0105 0900 = = = =") in rows(entries, "stop_id", "entry") and ("C", "1 0030 0000 = = = =") in rows(entries, "stop_id", "entry")
    both = entries.select("feed_id", "stop_id", "entry").union(entries.sparkSession.createDataFrame([("a", "A", "1 0050 0800 0700 2200 = ="), ("a", "A", "9 = = = = = =")], "feed_id string, stop_id string, entry string"))
    combined = schedule.combine_first_last(both)
    assert ("A", "1", "0050", "0900", "0700", "2200", "=") in rows(combined, "stop_id", "route", "wd_first", "wd_last", "sat_first", "sat_last", "sun_first")
    assert ("A", True, False) in rows(schedule.weekend_flags(combined), "stop_id", "has_saturday", "has_sunday")


def test_clock(spark):
    assert one(spark, clock.arrival_text(F.col("a")), a=-1) == "Arr" and one(spark, clock.arrival_text(F.col("a")), a=125_000) == "2m"
    assert [one(spark, clock.arrival_label(F.col("a")), a=v) for v in (0, 30_000, 60_000, 300_000)] == ["N/A", "Arriving", "1 min", "5 min"]
    assert one(spark, clock.format_duration(F.col("a")), a=15.5) == "15h 30m"
    assert one(spark, clock.format_hhmm(F.col("a")), a="0915") == "09:15" and one(spark, clock.format_hhmm(F.col("a")), a="=") == "-"
    span = one(spark, clock.service_span(F.col("a"), F.col("b")), a="2200", b="0100")
    assert (span.duration, span.wrap) == (3.0, pytest.approx(100 * 1 / 24))
    assert one(spark, clock.parse_ist(F.col("a")), a="01-02-2024 05:30:00") == datetime(2024, 2, 1)
    assert one(spark, clock.parse_ist(F.col("a")), a="01-02-2024") == datetime(2024, 1, 31, 18, 30)
    assert one(spark, clock.parse_ist(F.col("a")), a=" ") is None and one(spark, clock.parse_ist(F.col("a")), a="x") is None
    assert one(spark, clock.epoch_ms(clock.parse_ist(F.col("a"))), a="01-01-1970 05:30:01") == 1000
    assert one(spark, clock.gtfs_hhmm(F.col("a"), True), a="25:05:10") == "25:05" and one(spark, clock.gtfs_seconds(F.col("a")), a="25:05:10") == 90310
    assert one(spark, clock.parse_first_last(F.col("a")), a="Line 5 0500 2300 = = = =").route == "Line 5"
    assert one(spark, geo.walking_minutes(F.col("a")), a=85.0) == 2 and one(spark, geo.opposite_stop_id(F.col("a")), a="51") == "59"
    assert one(spark, geo.ruler_distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("a")), a=1.0) == pytest.approx(110.575, abs=0.01)
    assert one(spark, order.split_route_key(order.route_key(F.col("a"), F.lit("d"), F.lit(3))), a="s").variant_idx == 3
    assert one(spark, order.jaccard(F.split("a", ","), F.split("b", ",")), a="x,y", b="y,z") == pytest.approx(1 / 3)


def test_importance(feed):
    got = {r.stop_id: r for r in importance.normalize_0_100(importance.stop_importance(feed["times"])).collect()}
    assert got["A"].destinations == 4 and got["B"].neighbors == 2 and {0.0, 100.0} <= {r.score for r in got.values()}
    assert all(r.exclusive <= r.destinations for r in got.values())


@pytest.mark.parametrize("arrays", [0, 6, 4096])
def test_importance_by_sets(spark, arrays):
    """A hub on every other trip, and loops; arrays and bitmaps give what plain sets give."""
    rng = random.Random(9)
    trips = [[rng.randrange(40) for _ in range(rng.randrange(1, 7))] for _ in range(60)]
    trips = [t[:2] + [99] + t[2:] if k % 2 else t for k, t in enumerate(trips)]
    times = [("f", f"t{k}", f"s{x}", i, i) for k, t in enumerate(trips) for i, x in enumerate(t)]
    got = importance.stop_importance(spark.createDataFrame(times, "feed_id string, trip_id string, stop_id string, stop_sequence int, ord int"), arrays)
    reach, near = {}, {}
    for t in trips:
        for i, x in enumerate(t):
            reach.setdefault(x, set()).update(t[i + 1 :])
            near.setdefault(x, set()).update(y for y in t[max(0, i - 1) : i + 2] if y != x)
    want = {}
    for x, own in reach.items():
        if own:
            mean = sum(len(reach[y]) for y in near[x]) / len(near[x]) if near[x] else 0.0
            alone = len(own - set().union(*(reach[y] for y in near[x])))
            want[f"s{x}"] = (len(own), len(near[x]), mean, alone, 0.8 * (len(own) / mean if mean else len(own)) + 0.2 * alone if near[x] else len(own))
    assert {r.stop_id: tuple(r)[2:] for r in got.collect()} == {s: pytest.approx(v) for s, v in want.items()}


def test_network(spark, feed):
    known = patterns.service_patterns(feeds.with_direction(feed["trips"]), feed["times"])
    asked = spark.createDataFrame([("a", "A", "C"), ("a", "C", "D"), ("a", "D", "A")], "feed_id string, start_stop string, end_stop string")
    assert rows(network.journeys_direct(known, asked), "start_stop", "end_stop", "route_id") == [("A", "C", "1"), ("D", "A", "2_x")]
    assert ("C", "D", "1", "2_x", ["A"]) in rows(network.journeys_one_transfer(known, asked), "start_stop", "end_stop", "from_route", "to_route", "transfers")
    near = {r.stop_id: r.nearest for r in network.nearest_stop(feed["stops"]).collect()}
    assert near == {"A": "B", "B": "A", "C": "B", "E": "C"}
    assert rows(feed["stops"].where(network.is_interchange(F.col("name"))), "stop_id") == [("B",)]
    assert set(r.option for r in network.journey_options(known, feed["stops"], asked).collect()) >= {"start_end", "near_start_end"}
    assert rows(network.usable_services(known), "route_id") == [("1",), ("2_x",)]


def test_transfers_with_a_hub_by_brute_force(spark):
    """Half of all variants visit the hub, some twice; requests from and to it, repeated and unknown ones."""
    rng = random.Random(12)
    known = [("f", f"r{i // 3}", f"d{i % 2}", i % 3, rng.choices(range(25), k=rng.randrange(1, 8))) for i in range(40)]
    known = [(*v, stops[:2] + [99] + stops[2:] + [99] * (i % 4 == 0) if i % 2 else stops) for i, (*v, stops) in enumerate(known)]
    asked = [(rng.choice([*range(25), 99]), rng.choice([*range(25), 99])) for _ in range(60)]
    asked = [(a, b) for a, b in asked if a != b] + [(0, 1), (0, 1), (1, 1000)]
    want = set()
    for s, e in asked:
        for *v, a in known:
            if s in a and e not in a[a.index(s) :]:
                after = set(a[a.index(s) + 1 :]) - {s, e}
                for *w, b in known:
                    if e in b and (met := [x for x in dict.fromkeys(b[: b.index(e) + 1]) if x in after and x not in (s, e)]):
                        want.add((str(s), str(e), v[1], v[2], v[3], w[1], w[2], w[3], ",".join(map(str, met))))
    patterns_ = spark.createDataFrame([(*v, 1, [str(x) for x in stops]) for *v, stops in known], "feed_id string, route_id string, destination string, variant_idx int, dest_rank int, stops array<string>")
    pairs = spark.createDataFrame([("f", str(s), str(e)) for s, e in asked], "feed_id string, start_stop string, end_stop string")
    got = [(r.start_stop, r.end_stop, r.from_route, r.from_destination, r.from_idx, r.to_route, r.to_destination, r.to_idx, ",".join(r.transfers)) for r in network.journeys_one_transfer(patterns_, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    direct = {(str(s), str(e), *v[1:]) for s, e in asked for *v, a in known if s in a and e in a[a.index(s) :]}
    assert {(r.start_stop, r.end_stop, r.route_id, r.destination, r.variant_idx) for r in network.journeys_direct(patterns_, pairs).collect()} == direct


def test_nearest_by_brute_force(spark):
    rng = random.Random(3)
    at = [(f"s{i}", rng.choice([0, 5, 50]) + rng.random(), rng.random()) for i in range(120)]
    df = spark.createDataFrame([("f", s, x, y, "n", i) for i, (s, x, y) in enumerate(at)], "feed_id string, stop_id string, lon double, lat double, name string, ord long")
    got = {r.stop_id: r.degrees for r in network.nearest_stop(df).collect()}
    for s, x, y in at:
        assert got[s] == pytest.approx(min(((x - u) ** 2 + (y - v) ** 2) ** 0.5 for t, u, v in at if t != s))


def test_shapes(spark):
    line = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    points = spark.createDataFrame([("f", "s", i, a, b) for i, (a, b) in enumerate(line)], "feed_id string, shape_id string, pt_seq int, lat double, lon double")
    encoded = shapes.encode_shapes(points)
    assert encoded.first().polyline == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert [(r.lat, r.lon) for r in shapes.decode_shapes(encoded).orderBy("pt_seq").collect()] == line
    bad = spark.createDataFrame([("f", "x", "_p~iF~ps|U"), ("f", "y", "_p~i"), ("f", "z", "é !")], "feed_id string, shape_id string, polyline string")
    assert rows(shapes.decodable(bad).where("error is null"), "shape_id") == [("x",)]
    wavy = spark.createDataFrame([("f", "w", i, 0.0001 * (i % 2), 0.01 * i) for i in range(20)] + [("f", "w", 20, 0.5, 0.2)], points.schema)
    assert shapes.simplify_shapes(wavy).count() == 3
    on = spark.createDataFrame([("f", "v1", 39.6, -120.575), ("f", "v2", 10.0, 10.0)], "feed_id string, vehicle_id string, lat double, lng double")
    snapped = {r.vehicle_id: r for r in shapes.snap_to_shapes(on.where("vehicle_id = 'v1'").union(on), points, 50.0).collect()}
    assert snapped["v1"].metres is not None and snapped["v2"].metres is None
    ring = shapes.stop_markers(spark.createDataFrame([("f", "s", 77.5, 12.9)], "feed_id string, stop_id string, lon double, lat double")).first().ring
    assert len(ring) == 4 and ring[0] == ring[3]


def test_graphs(spark):
    members = spark.createDataFrame([("f", r, s) for r, ss in {"1": "abc", "2": "bcd", "3": "xy", "4": "d", "5": "z"}.items() for s in ss], "feed_id string, route_id string, stop_id string")
    alike = graphs.route_similarity(members)
    assert ("1", "2", 0.5) in rows(alike, "a", "b", "jaccard")
    clusters = graphs.cluster_routes(members)
    assert rows(clusters, "route_id", "cluster", "size") == [("1", "1", 3), ("2", "1", 3), ("3", "3", 1), ("4", "1", 3), ("5", "5", 1)]
    assert [r.route_id for r in graphs.order_cluster(clusters, alike).where("cluster = '1'").orderBy("place").collect()] == ["2", "1", "4"]
    with pytest.raises(ValueError):
        graphs.order_cluster(clusters, alike, most=2)
    prio = spark.createDataFrame([("f", "1", 3.0), ("f", "2", 1.0), ("f", "4", 2.0)], "feed_id string, route_id string, priority double")
    levels = graphs.assign_levels(members, prio)
    assert rows(levels, "route_id", "level") == [("1", 2), ("2", 1), ("3", 1), ("4", 2), ("5", 1)]
    names = spark.createDataFrame([("f", s, s.upper()) for s in "abcdxyz"], "feed_id string, stop_id string, name string")
    assert rows(graphs.route_groups(members, names), "route_id", "grp") == [("1", "1"), ("2", "1"), ("3", "3"), ("4", "1"), ("5", "5")]


def test_diagram(spark):
    data = [("f", s, r, i < 1, s == "s3", i) for r in ["g"] for i, s in enumerate([f"s{k}" for k in range(9)])]
    stops = spark.createDataFrame([(f, s, float(100 - 10 * i) if i < 2 else float(10 - i), t, c, i) for f, s, _, t, c, i in data], "feed_id string, stop_id string, ranking double, terminal boolean, current boolean, ord long")
    assert rows(diagram.select_major_stops(stops, 3, ["feed_id"]).where("selected"), "stop_id") == [("s0",), ("s1",), ("s2",), ("s3",), ("s4",)]
    runs = spark.createDataFrame([("f", i) for i in (1, 2, 3, 7, 9, 10)], "feed_id string, idx long")
    assert rows(diagram.run_segments(runs, ["feed_id"]), "seg_start", "seg_end") == [(1, 3), (7, 7), (9, 10)]
    at = spark.createDataFrame([("f", "a", "1", ["a", "b", "c"]), ("f", "a", "2", ["a", "b"]), ("f", "a", "3", ["a", "x"]), ("f", "a", "4", ["b", "a"])], "feed_id string, stop_id string, route_id string, stops array<string>")
    names = spark.createDataFrame([("f", s, s) for s in "abcx"], "feed_id string, stop_id string, name string")
    assert [r.route_id for r in diagram.order_by_shared_prefix(diagram.drop_terminating(at), names).orderBy("place").collect()] == ["1", "2", "3"]
    assert ("b", 1.0, 2) in rows(diagram.stop_order(diagram.forward(at)), "other", "avg_position", "routes")


def test_pairing():
    assert pairing.align(["11", "21", "3"], ["19", "5", "29"]) == [("11", "19"), (None, "5"), ("21", "29"), ("3", None)]
    got = pairing.pair_rows(["A", "11", "B", "19", "A"], None)
    assert got[0] == ("A", "A") and got[-1] == (pairing.TURN, pairing.TURN)
    assert pairing.pair_rows(["A", "B"], None) == [("A", None), ("B", None)]


def test_live(spark):
    p = spark.createDataFrame([("l", "s", "7", "d", ms, "v1", 1, i) for i, ms in enumerate((300, 100, -5, 200, 400, 9_999_999))], "feed_id string, stop_id string, no string, destination string, duration_ms long, vehicle_id string, devicestatusflag int, ord long")
    got = live.live_services(p).first()
    assert (got.frequency, got.next.duration_ms, got.next2.duration_ms, got.next3.duration_ms, got.next.load) == (4, 100, 200, 300, "SEA")
    with pytest.raises(ValueError):
        live.live_services(p.drop("no"))
    v = spark.createDataFrame([("l", "1", "n1", "down", 1, 1.0, 1.0), ("l", "1", "n1", "up", 2, 2.0, 2.0), ("l", "1", "n1", "up", 3, 3.0, 3.0), ("l", "2", "n2", "up", 1, 0.0, 1.0)], "feed_id string, vehicle_id string, vehicle_number string, direction string, ord long, lat double, lng double")
    assert rows(live.vehicle_map(v), "vehicle_id", "ord") == [("1", 3)] and rows(live.dedupe_vehicles(v), "vehicle_number", "ord") == [("n1", 2), ("n2", 1)]
    known = spark.createDataFrame([("l", "500D", "r1", 1), ("l", "500d", "r2", 2)], "feed_id string, no string, route_id string, ord long")
    assert live.route_ids(known.select("feed_id", "no").limit(1), known).first().route_id == "r1"


def test_search(spark):
    q = spark.createDataFrame([("q1", "500"), ("q2", "majestc"), ("q3", " ")], "query_id string, text string")
    services = spark.createDataFrame([("r1", "500D"), ("r2", "335E")], "id string, text string")
    stops = spark.createDataFrame([("s1", "Majestic Bus Stand"), ("s2", "Airport")], "id string, text string")
    assert rows(search.fuzzy_search(q, services, stops), "query_id", "kind", "id") == [("q1", "service", "r1"), ("q2", "stop", "s1")]


def test_report(spark, feed):
    tables = {"routes": feed["routes"], "trips": feed["trips"], "stop_times": feed["times"], "stops": feed["stops"], "shapes": feed["stops"].limit(0)}
    names = spark.createDataFrame([("a",), ("b",)], "feed_id string")
    status = report.feed_status(tables, names)
    assert rows(status, "feed_id", "status", "missing") == [("a", "partial", "shapes"), ("b", "error", "routes,trips,stop_times,stops,shapes")]
    assert report.run_report(status).first().exit_code == 1
    assert ("visit_to_unknown_stop", 1) in rows(feeds.unknown_references(feed["trips"], feed["times"], feed["routes"], feed["stops"].where("stop_id <> 'D'").withColumnsRenamed({"lon": "stop_lon", "lat": "stop_lat"})), "what", "n")


def test_feed_files(spark, tmp_path):
    texts = {"routes": 'route_id,route_long_name\n007,"Alpha, Beta"\n', "trips": "route_id,trip_id,shape_id\n007,t1,\n", "stop_times": "trip_id,stop_id,stop_sequence,arrival_time\nt1,01,1,24:30:00\nt1,02,x,\n", "stops": "﻿stop_id,stop_name,stop_lat,stop_lon\r\n01,S,1.5,2.5\r\n02,T,,\r\n"}
    for feed_id in ("x", "y"):
        (tmp_path / "in" / feed_id).mkdir(parents=True)
        for name, text in texts.items():
            (tmp_path / "in" / feed_id / f"{name}.txt").write_text(text)
    got = feed_sources.load_feed(spark, f"{tmp_path}/in")
    assert rows(got["routes"], "feed_id", "route_id", "route_long_name") == [("x", "007", "Alpha, Beta"), ("y", "007", "Alpha, Beta")]
    assert rows(got["trips"].where("feed_id = 'x'"), "trip_id", "direction_id") == [("t1", None)]
    assert rows(got["stop_times"].where("feed_id = 'x'"), "stop_id", "stop_sequence") == [("01", 1), ("02", None)]
    assert rows(got["stops"].where("feed_id = 'x'"), "stop_id", "stop_lat") == [("01", 1.5), ("02", None)]
    assert got["shapes"].count() == 0
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "z.zip", "w") as z:
        for name, text in texts.items():
            z.writestr(f"{name}.txt", text)
    (tmp_path / "zips" / "bad.zip").write_bytes(b"no zip")
    assert rows(feed_sources.unzip_feeds(spark, f"{tmp_path}/zips", f"{tmp_path}/out"), "feed_id", "name")[0] == ("bad", None)
    registry = feed_sources.feeds(spark)
    assert rows(feed_sources.with_feed(spark.createDataFrame([("q",), (None,)], "feed_id string"), registry), "feed_id") == [("default",), ("default",)]


def test_feed_files_are_csv(spark, tmp_path):
    """Many columns, repeated names, quoted commas and line ends, and feeds with and without direction_id side by side."""
    wide = ",".join(["stop_id", *(f"x{i}" for i in range(47)), "stop_name"])
    files = {
        ("a", "stops"): wide + "\n" + ",".join(["s1", *["z"] * 47, '"Name, with\nline ""end"""']) + "\n\ns2" + "," * 47 + ",Two\n",
        ("b", "stops"): 'stop_name , stop_id,stop_id,"stop_lat"\nN,first,second,1.5\nM,third\n',
        ("a", "trips"): "route_id,trip_id\nr1,t1\nr2,t2\nr3,t3\n",
        ("b", "trips"): "trip_id,direction_id,route_id\nt1,,r1\nt2,1,r2\n",
        ("a", "routes"): "route_id,route_long_name\nr1,Line DOWN\nr2,\nr3,Up and down\n",
        ("b", "routes"): "route_id,route_long_name\nr1,Line DOWN\nr2,Line UP\n",
    }
    for (f, table), text in files.items():
        (tmp_path / "folders" / f"feed {f}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "folders" / f"feed {f}" / f"{table}.txt").write_text(text, newline="")
    (tmp_path / "zips").mkdir()
    for f in "ab":
        with zipfile.ZipFile(tmp_path / "zips" / f"feed {f}.zip", "w") as z:
            for (g, table), text in files.items():
                if f == g:
                    z.writestr(f"{table}.txt", text)
    for kind in ("folders", "zips"):
        got = feed_sources.load_feed(spark, f"{tmp_path}/{kind}")
        stops = {(r.feed_id, r.stop_id): (r.stop_name, r.stop_lat, r.absent) for r in got["stops"].collect()}
        assert stops == {
            ("feed a", "s1"): ('Name, with\nline "end"', None, ["stop_lat", "stop_lon"]), ("feed a", "s2"): ("Two", None, ["stop_lat", "stop_lon"]),
            ("feed b", "first"): ("N", 1.5, ["stop_lon"]), ("feed b", "third"): ("M", None, ["stop_lon"]),
        }
        want = [("feed a", "t1", "1"), ("feed a", "t2", "0"), ("feed a", "t3", "0"), ("feed b", "t1", "0"), ("feed b", "t2", "1")]
        assert rows(feeds.with_direction(got["trips"], got["routes"]), "feed_id", "trip_id", "direction") == want
        patterned = rows(feeds.pattern_directions(got["trips"], got["routes"]), "feed_id", "trip_id", "direction")
        assert patterned == sorted([*want, ("feed a", "t3", "1")])
        assert got["shapes"].count() == 0 and got["shapes"].columns[0] == "feed_id"


def test_artefacts(spark, tmp_path, feed):
    known = patterns.service_patterns(feeds.with_direction(feed["trips"]), feed["times"])
    for name, docs in {"services": artefacts.services_document(known, feed["routes"]), "stops": artefacts.stops_document(feed["stops"])}.items():
        artefacts.write_documents(docs, f"{tmp_path}/{name}")
    text = json.loads(artefacts.services_document(known, feed["routes"]).first().value)
    assert text["1"] == {"name": "Line UP", "C": [["A", "B", "C"]], "A": [["C", "B", "A"]]} and [*text["1"]] == ["name", "C", "A"]
    assert json.loads(artefacts.stops_document(feed["stops"]).first().value)["D"] == [None, None, "Delta", ""]
    assert rows(artefacts.read_services(spark, f"{tmp_path}/services"), "route_id", "destination", "stops")[1] == ("1", "C", ["A", "B", "C"])
    times = schedule.stop_schedule(feeds.with_direction(feed["trips"]), feed["times"])
    artefacts.write_schedules(times, f"{tmp_path}/schedules")
    (tmp_path / "docs" / "a").mkdir(parents=True)
    (tmp_path / "docs" / "a" / "A.json").write_text('{"services":[{"no":"1","origin":"A","destination":"C","trips":["08:00"],"trip_count":1}]}')
    (tmp_path / "docs" / "a" / "B.json").write_text("{broken")
    assert rows(artefacts.read_schedule_docs(spark, f"{tmp_path}/docs"), "stop_id", "no", "trip_count") == [("A", "1", 1)]
    feature = spark.createDataFrame([("f", "i", {"n": "x"}, [1.0, 2.0])], "feed_id string, id string, properties map<string,string>, coordinates array<double>")
    assert json.loads(artefacts.to_feature_collection(feature).first().value)["features"][0]["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]}


def test_payloads(spark, tmp_path):
    Path(tmp_path / "arr").mkdir()
    Path(tmp_path / "arr" / "a.json").write_text(json.dumps({"Issuccess": True, "station": "20", "data": [{"routeno": "500D", "tostationname": "X", "arrivaltime": "01-01-2024 05:40:00", "vehicleid": "9", "devicestatusflag": 1}]}))
    Path(tmp_path / "arr" / "b.json").write_text(json.dumps({"Issuccess": False, "data": []}))
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    got = live_sources.arrivals_rows(live_sources.read_payloads(spark, f"{tmp_path}/arr", live_sources.ARRIVALS), now)
    assert rows(got, "stop_id", "no", "duration_ms") == [("20", "500D", 600_000)]
    Path(tmp_path / "veh").mkdir()
    Path(tmp_path / "veh" / "a.json").write_text(json.dumps({"up": {"data": [{"routeno": "1", "vehicleDetails": [{"vehicleid": "5", "vehiclenumber": "K5", "centerlat": "12.9", "centerlong": "x"}]}]}}))
    got = live_sources.vehicle_rows(live_sources.read_payloads(spark, f"{tmp_path}/veh", live_sources.VEHICLES))
    assert rows(got, "vehicle_id", "direction", "lat", "lng") == [("5", "up", 12.9, None)]


def test_match_predictions_stream(spark, tmp_path):
    kinds = "feed_id string, stop_id string, no string, snapshot_id long, ord long, duration_ms long, feature string, type string, visit_number int, origin_code string, destination_code string"
    bus = lambda snap, o, ms, f="w": ("l", "s", "7", snap, o, ms, f, "SD", 1, "a", "b")
    for i, data in enumerate(([bus(1, 0, 600_000), bus(1, 1, 1_200_000)], [bus(2, 0, 540_000), bus(2, 1, 1_900_000)])):
        spark.createDataFrame(data, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(kinds).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streams.match_predictions(source, timeout="NoTimeout").writeStream.format("memory").queryName("lanes").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        got = rows(spark.table("lanes"), "snapshot_id", "bus_id", "duration_ms", "ghost")
    finally:
        query.stop()
    assert got == [(1, 0, 600_000, False), (1, 1, 1_200_000, False), (2, 0, 540_000, False), (2, 1, 1_200_000, True), (2, 2, 1_900_000, False)]


def test_latest_positions_stream(spark, tmp_path):
    kinds = "feed_id string, vehicle_id string, ts timestamp, ord long, lat double, lng double"
    data = [("l", "v", datetime(2024, 1, 1, 0, m), m, 1.0 + m, 2.0) for m in (1, 3, 2)] + [("l", "v", datetime(2024, 1, 1, 0, 9), 9, 0.0, 0.0)]
    spark.createDataFrame(data, kinds).write.parquet(f"{tmp_path}/v")
    seen = []
    query = streams.latest_positions(spark.readStream.schema(kinds).parquet(f"{tmp_path}/v")).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [r.lat for r in seen][-1] == 4.0
