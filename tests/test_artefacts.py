"""Documents written and read back, level artefacts, and pairs of stops against a plain alignment."""

import functools
import json
import random

import pytest
from pyspark.sql import functions as F

from transit_tables.operators import network, pairing, schedule, shapes
from transit_tables.sources import artefacts, pieces
from transit_tables.sources import feeds as sources


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def value(docs):
    return json.loads(docs.first().value)


def test_documents_come_back_as_rows(spark, tmp_path):
    lines = spark.createDataFrame([("f", "1", "1-1", "b?"), ("f", "1", "1-0", "a\\_"), ("f", 'q"2', "s", "")], "feed_id string, route_id string, shape_id string, polyline string")
    entries = spark.createDataFrame([("f", "s1", "2", "2 0500 2300 = = = ="), ("f", "s1", "10", "10 = = = = = ="), ("f", "é", "1", "1 0600 0700 = = = =")], "feed_id string, stop_id string, no string, entry string")
    stops = spark.createDataFrame([("f", "s1", 77.5, 12.5, 'A "B"'), ("f", "s2", None, None, "C")], "feed_id string, stop_id string, lon double, lat double, name string")
    for name, docs in {"routes": artefacts.routes_document(lines), "firstlast": artefacts.firstlast_document(entries), "stops": artefacts.stops_document(stops)}.items():
        artefacts.write_documents(docs, f"{tmp_path}/{name}")
    assert rows(artefacts.read_routes(spark, f"{tmp_path}/routes"), "route_id", "shape_idx", "polyline") == [("1", 0, "a\\_"), ("1", 1, "b?"), ('q"2', 0, "")]
    assert rows(artefacts.read_firstlast(spark, f"{tmp_path}/firstlast"), "stop_id", "entry") == rows(entries, "stop_id", "entry")
    assert rows(artefacts.read_stops(spark, f"{tmp_path}/stops"), "stop_id", "lon", "lat", "name") == rows(stops, "stop_id", "lon", "lat", "name")
    assert artefacts.routes_document(lines.limit(0)).count() == 0


def test_documents_in_pieces_have_the_same_bytes(spark, tmp_path):
    rng = random.Random(2)
    feeds = ["f", "g h", "a/b:c", None]
    stops = spark.createDataFrame([(f, f"s{i}\n", rng.random(), None if i % 7 else 1.5, f'N "{i}" é') for f in feeds for i in range(rng.randrange(1, 300))] + [("f", "s1\n", 0.5, 1.0, None)], "feed_id string, stop_id string, lon double, lat double, name string").repartition(7)
    found = {
        "stops": (artefacts.stops_pieces(stops), artefacts.OBJECT),
        "levels": (artefacts.stop_levels_pieces(stops.withColumn("level", F.length("stop_id"))), artefacts.OBJECT),
        "features": (artefacts.feature_pieces(stops.select("feed_id", F.col("stop_id").alias("id"), F.create_map(F.lit("n"), "name").alias("properties"), F.array("lon", "lat").alias("coordinates"))), artefacts.FEATURES),
        "none": (artefacts.stops_pieces(stops.limit(0)), artefacts.OBJECT),
    }
    for name, (parts, ends) in found.items():
        artefacts.write_documents(artefacts.whole(parts, ends), f"{tmp_path}/whole/{name}")
        for _ in range(2):  # the second replaces the first
            sizes = pieces.write_pieces(parts, f"{tmp_path}/pieces/{name}", ends)
        want = {p.parent.name: p.read_bytes() for p in (tmp_path / "whole" / name).rglob("*.txt")}
        assert {p.parent.name: p.read_bytes() for p in (tmp_path / "pieces" / name).rglob("part-*")} == want
        assert sorted(n for _, n in sizes) == sorted(map(len, want.values())) and len(want) == (0 if name == "none" else len(feeds))
        assert {p.name for p in (tmp_path / "pieces" / name).iterdir()} == set(want)
    back = artefacts.read_stops(spark, f"{tmp_path}/pieces/stops")
    assert rows(back.where("feed_id = 'f'").distinct(), "stop_id", "lon") == rows(stops.where("feed_id = 'f'").distinct(), "stop_id", "lon")


def test_services_and_markers_in_pieces(spark, tmp_path):
    known = spark.createDataFrame([("f", f"r{i}", f"d{k}", k, v, [f"s{i}", f"s{k}", f"s{v}"]) for i in range(40) for k in (1, 2) for v in (0, 1)], "feed_id string, route_id string, destination string, dest_rank int, variant_idx int, stops array<string>")
    names = spark.createDataFrame([("f", f"r{i}", f'Line "{i}"') for i in range(0, 40, 2)], "feed_id string, route_id string, route_long_name string")
    pieces.write_pieces(artefacts.services_pieces(known, names), f"{tmp_path}/services", artefacts.OBJECT)
    (file,) = (tmp_path / "services").rglob("part-*")
    assert file.read_text() == artefacts.services_document(known, names).first().value + "\n"
    cols = ("route_id", "destination", "dest_rank", "variant_idx", "stops")
    assert rows(artefacts.read_services(spark, f"{tmp_path}/services"), *cols) == rows(known, *cols)


def test_ranking(spark, tmp_path):
    scores = spark.createDataFrame([("f", "a", 1.006), ("f", "b", 100.0), ("f", "c", 1.0)], "feed_id string, stop_id string, score double")
    assert [(r.stop_id, r.score) for r in artefacts.ranking_rows(scores).collect()] == [("b", 100.0), ("a", 1.01), ("c", 1.0)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "ranking.json").write_text('{"a": 1.5, "b": 2}')
    assert rows(artefacts.read_ranking(spark, f"{tmp_path}/f"), "feed_id", "stop_id", "score") == [("f", "a", 1.5), ("f", "b", 2.0)]


def test_geojson(spark, tmp_path):
    line = spark.createDataFrame([("f", "i", {"name": "x", "n": "1"}, [[1.0, 2.0], [3.0, 4.0]])], "feed_id string, id string, properties map<string,string>, coordinates array<array<double>>")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "rail.json").write_text(artefacts.to_feature_collection(line, "LineString").first().value)
    (got,) = artefacts.read_geojson(spark, f"{tmp_path}/f").collect()
    assert (got.type, got.properties, json.loads(got.coordinates)) == ("LineString", {"name": "x", "n": "1"}, [[1.0, 2.0], [3.0, 4.0]])


def test_schedules_and_services(spark, tmp_path):
    times = spark.createDataFrame([("f", "s", n, "0", "A", "B", ["08:00"], 1) for n in ("10", "9", "K")], "feed_id string, stop_id string, no string, direction string, origin string, destination string, trips array<string>, trip_count int")
    artefacts.write_schedules(times, f"{tmp_path}/schedules")
    (file,) = (tmp_path / "schedules").rglob("part-*.json")
    assert [s["no"] for s in json.loads(file.read_text())["services"]] == ["9", "10", "K"] and file.parent.name == "stop_id=s"
    slot = "struct<duration_ms: bigint>"
    services = spark.createDataFrame([("f", "s", "2", "d", 1, (5,), None, None), ("f", "s", "1", "d", 2, (3,), (4,), None)], f"feed_id string, stop_id string, no string, destination string, frequency long, next {slot}, next2 {slot}, next3 {slot}")
    assert value(artefacts.services_record(services)) == {"services": [{"no": "1", "destination": "d", "frequency": 2, "next": {"duration_ms": 3}, "next2": {"duration_ms": 4}}, {"no": "2", "destination": "d", "frequency": 1, "next": {"duration_ms": 5}}]}


def test_level_artefacts(spark):
    points = spark.createDataFrame([("f", "1-0", i, 12.0 + i, 77.0) for i in (2, 1)] + [("f", "2-0", 1, 1.0, 2.0)], "feed_id string, shape_id string, pt_seq int, lat double, lon double")
    route_of = spark.createDataFrame([("f", "1-0", "1"), ("f", "2-0", "2")], "feed_id string, shape_id string, route_id string")
    levels = spark.createDataFrame([("f", "1", 2), ("f", "2", 1)], "feed_id string, route_id string, level int")
    assert value(artefacts.route_levels_document(shapes.level_paths(points, route_of, levels))) == [{"level": 2, "number": "1", "path": [[77.0, 13.0, 100.0], [77.0, 14.0, 100.0]]}, {"level": 1, "number": "2", "path": [[2.0, 1.0, 0.0]]}]
    of_stop = spark.createDataFrame([("f", "a", 3), ("f", "b", 1)], "feed_id string, stop_id string, level int")
    assert value(artefacts.stop_levels_document(of_stop)) == {"a": 3, "b": 1}
    stops = spark.createDataFrame([("f", "a", 77.0, 12.0, "A")], "feed_id string, stop_id string, lon double, lat double, name string")
    (marker,) = value(artefacts.stop_markers_document(shapes.stop_markers(stops), of_stop, stops))
    assert (marker["number"], marker["name"], marker["level"], len(marker["contour"][0])) == ("a", "A", 3, 4) and marker["contour"][0][0] == marker["contour"][0][3]


def test_geometry_of_variants(spark):
    lines = spark.createDataFrame([("f", "1", 0, "a"), ("f", "1", 1, "b")], "feed_id string, route_id string, shape_idx int, polyline string")
    keys = spark.createDataFrame([("f", "1|d|1"), ("f", "1|e|1"), ("f", "1|d|7"), ("f", "9|d|0"), ("f", "broken")], "feed_id string, key string")
    assert rows(shapes.geometry_of_variants(lines, keys), "route_id", "shape_idx", "polyline") == [("1", 1, "b")]


def test_registry(spark):
    known = sources.feeds(spark, (("default", "D", -180.0, -90.0, 180.0, 90.0, False, False), ("x", "X", 70.0, 10.0, 80.0, 20.0, True, True)))
    asked = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "feed_id string, n int")
    assert rows(sources.with_feed(asked, known), "n", "feed_id") == [(1, "x"), (2, "default"), (3, "default")]


def same_side(a, b):
    swap = {"1": "9", "9": "1"}
    return a == b or (a[-1] in swap and a[:-1] + swap[a[-1]] == b)


def most_pairs(a, b):
    """How many stops of two lists can be paired in order, by trying every way."""

    @functools.cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return max(best(i + 1, j), best(i, j + 1), 1 + best(i + 1, j + 1) if same_side(a[i], b[j]) else 0)

    return best(0, 0)


@pytest.mark.parametrize("seed", range(30))
def test_alignment_pairs_as_many_stops_as_can_be(seed):
    rng = random.Random(seed)
    ids = [f"{n}{side}" for n in range(1, 5) for side in "19"] + ["2", "3"]
    a, b = ([rng.choice(ids) for _ in range(rng.randrange(9))] for _ in range(2))
    got = pairing.align(a, b)
    assert [x for x, _ in got if x is not None] == a and [y for _, y in got if y is not None] == b
    assert sum(x is not None and y is not None and same_side(x, y) for x, y in got) == most_pairs(a, b)


@pytest.mark.parametrize(
    "first,second",
    [
        (["11"], None), (["11", "21"], None), (["11", "21", "11"], None), (["11", "21", "31", "29", "11"], None), (["5", "11", "7", "19", "5"], None),
        (["11", "21", "31"], ["39", "29", "19"]), (["11", "21", "31"], ["39", "19"]), (["11", "31"], ["31", "21", "11"]), (["4", "5"], ["6", "7"]), (["11", "21"], ["11", "21"]),
    ],
)
def test_pairs_of_two_way_services(spark, first, second):
    kept = pairing.pair_rows(first, second)
    body = [p for p in kept if p != (pairing.TURN, pairing.TURN)]
    if second is not None:
        assert sum(x is not None and y is not None and same_side(x, y) for x, y in body) == most_pairs(first, second[::-1])
    elif len(first) < 2 or first[0] != first[-1]:
        assert body == [(s, None) for s in first]
    else:
        assert kept[-1] == (pairing.TURN, pairing.TURN) and body[0] == (first[0], first[0])
    lists = [first] + ([second] if second else [])
    patterns = spark.createDataFrame([("f", "r", 1, i, x) for i, x in enumerate(lists)], "feed_id string, route_id string, dest_rank int, variant_idx int, stops array<string>")
    got = pairing.pair_opposite_stops(patterns).orderBy("row").collect()
    assert [(r.outbound, r.inbound) for r in got] == kept
    assert all(r.same == (r.outbound is not None and r.outbound == r.inbound) for r in got)


def test_small_flags(spark):
    lines = spark.createDataFrame([("f", "a", "_p~iF~ps|U"), ("f", "b", "x y")], "feed_id string, shape_id string, polyline string")
    assert rows(shapes.decodable(lines).where("error is null"), "shape_id") == [("a",)]
    known = spark.createDataFrame([("f", "r", ["a"]), ("f", "q", ["a", "b"])], "feed_id string, route_id string, stops array<string>")
    assert rows(network.usable_services(known), "route_id") == [("q",)]
    combined = spark.createDataFrame([("f", "s", "r", "0500", "2300", "=", "=", "0700", "=")], "feed_id string, stop_id string, route string, wd_first string, wd_last string, sat_first string, sat_last string, sun_first string, sun_last string")
    assert rows(schedule.weekend_flags(combined), "has_saturday", "has_sunday") == [(False, True)]
    assert combined.select(F.lit(1)).count() == 1
