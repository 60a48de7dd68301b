"""Functions called from SQL give what their Column forms give, without Python in the plan; feeds by place."""

import random

import pytest
from pyspark.sql import functions as F

from transit_tables.functions import clock, geo, order
from transit_tables.functions import sql as functions
from transit_tables.operators import places
from transit_tables.sources import feeds as sources

TIMES = ["25:05:10", "08:00", "8:7:6", "x", "", None, "24:00:00", "23:59:59", "12"]
PACKED = ["0915", "2359", "=", "", None, "12", "0100", "2200"]
ENTRIES = ["Line 5 0500 2300 = = = =", "5 0500 2300", "A B C D E F G H", "x", "", None]
STAMPS = ["01-02-2024 05:30:00", "01-02-2024", " 01-02-2024 ", " ", "x", None, "1-2-2024"]
NUMBERS = [-60_000, 0, 1, 59_999, 60_000, 125_000, None]
IDS = ["51", "59", "5", "1", "", None, "K9"]
SERVICES = ["500D", "12", "335E", "K3", "", None, "007", "99999999999999999999"]


@pytest.fixture(scope="module")
def named(spark):
    return functions.register(spark)


CASES = [
    ("gtfs_seconds(a)", TIMES, clock.gtfs_seconds), ("gtfs_hhmm(a)", TIMES, clock.gtfs_hhmm), ("gtfs_hhmm(a, true)", TIMES, lambda a: clock.gtfs_hhmm(a, True)), ("hhmm_packed(a)", TIMES, clock.hhmm_packed),
    ("first_last_entry(a, '0500', a)", PACKED, lambda a: clock.first_last_entry(a, F.lit("0500"), a)), ("parse_first_last(a)", ENTRIES, clock.parse_first_last), ("is_timing(a)", PACKED, clock.is_timing),
    ("hhmm_to_hours(a)", PACKED, clock.hhmm_to_hours), ("service_span('2200', a)", PACKED, lambda a: clock.service_span(F.lit("2200"), a)), ("format_hhmm(a)", PACKED, clock.format_hhmm),
    ("parse_ist(a)", STAMPS, clock.parse_ist), ("epoch_ms(parse_ist(a))", STAMPS, lambda a: clock.epoch_ms(clock.parse_ist(a))),
    ("arrival_ms(parse_ist(a), timestamp_ntz'2024-01-01 00:00:00')", STAMPS, lambda a: clock.duration_ms(clock.parse_ist(a), F.expr("timestamp_ntz'2024-01-01 00:00:00'"))),
    ("schedule_ms(a, '07:30')", TIMES, lambda a: clock.schedule_duration_ms(a, F.lit("07:30"))), ("arrival_text(a)", NUMBERS, clock.arrival_text), ("arrival_label(a)", NUMBERS, clock.arrival_label),
    ("format_duration(a / 7000d)", NUMBERS, lambda a: clock.format_duration(a / 7000.0)), ("walking_minutes(a)", NUMBERS, geo.walking_minutes), ("opposite_stop_id(a)", IDS, geo.opposite_stop_id),
    ("planar_distance(a, 1, 2, 3)", NUMBERS, lambda a: geo.planar_distance(a, F.lit(1.0), F.lit(2.0), F.lit(3.0))), ("ruler_distance_km(a / 400d, 1, 179, 3)", NUMBERS, lambda a: geo.ruler_distance_km(a / 400.0, F.lit(1.0), F.lit(179.0), F.lit(3.0))),
    ("ruler_bearing(a / 400d, 1, 179, 3)", NUMBERS, lambda a: geo.ruler_bearing(a / 400.0, F.lit(1.0), F.lit(179.0), F.lit(3.0))), ("jaccard(split(a, ''), array('5', 'D'))", SERVICES, lambda a: order.jaccard(F.split(a, ""), F.array(F.lit("5"), F.lit("D")))),
    ("route_key(a, 'd', 3)", IDS, lambda a: order.route_key(a, F.lit("d"), F.lit(3))), ("split_route_key(a)", ["s|d|3", "s|d|x", "s", "", None], order.split_route_key),
    ("service_sort_key(a)", SERVICES, lambda a: F.struct(*order.service_sort_key(a))), ("schedule_sort_key(a)", SERVICES, lambda a: F.struct(*order.schedule_sort_key(a))),
]


@pytest.mark.parametrize("call,values,column", CASES, ids=[c[0] for c in CASES])
def test_function_in_sql(spark, named, call, values, column):
    kind = "long" if values is NUMBERS else "string"
    spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, a {kind}").createOrReplaceTempView("given")
    got = spark.sql(f"SELECT i, {call} AS v FROM given ORDER BY i")
    want = spark.table("given").select("i", column(F.col("a")).alias("v")).orderBy("i").collect()
    plain = lambda v: tuple(v) if isinstance(v, tuple) else v
    assert [plain(r.v) for r in got.collect()] == [plain(r.v) for r in want]
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_column_function_has_its_sql_form(named):
    forms = {f for m in (clock, geo, order) for f, x in vars(m).items() if callable(x) and getattr(x, "__module__", "") == m.__name__ and not f.startswith("_")} - {"scales"}
    assert forms - set(named) == {"duration_ms", "schedule_duration_ms"} and {"arrival_ms", "schedule_ms"} <= set(named)


def test_table_functions(spark, named):
    data = [("f", "s", "2", "x", ["06:10", "23:50"]), ("f", "s", "2", "y", ["05:00"]), ("f", "s", "10", "x", ["08:05", "08:40"]), ("f", "t", "2", "x", ["01:00"])]
    schedule = spark.createDataFrame(data, "feed_id string, stop_id string, no string, destination string, trips array<string>")
    functions.register_schedule(spark, schedule)
    got = spark.sql("SELECT * FROM first_last_at('f', 's') ORDER BY no")
    assert [tuple(r) for r in got.collect()] == [("10", "0805", "0840", "10 0805 0840 = = = ="), ("2", "0500", "2350", "2 0500 2350 = = = =")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM departures_at('f', 's', '08:00', 30)").collect()] == [("10", "x", "08:05", 300_000)]
    assert spark.sql("SELECT * FROM first_last_at('f', 'none')").count() == 0


def test_feeds_by_place_by_brute_force(spark):
    rng = random.Random(6)
    boxes = [("default", "D", -180.0, -90.0, 180.0, 90.0, False, False)]
    for i in range(60):
        w, s, size = rng.uniform(-170, 160), rng.uniform(-80, 70), rng.choice([0.01, 0.5, 3, 12])
        boxes.append((f"b{i}", "B", w, s, w + size * rng.random(), s + size * rng.random(), i % 2 == 0, i % 3 == 0))
    boxes += [("dateline", "P", 175.0, -20.0, -175.0, -10.0, True, True), ("null", "N", None, 1.0, 2.0, 3.0, True, True), ("twin", "T", *boxes[5][2:6], True, True)]
    at = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)]
    at += [(rng.choice([b[2], b[4], (b[2] + b[4]) / 2]), rng.choice([b[3], b[5], (b[3] + b[5]) / 2])) for b in boxes[1:61] for _ in range(6)]
    at += [(179.0, -15.0), (-179.0, -15.0), (0.0, -15.0), (None, 1.0), (1.0, None)] + [(1.0, 1.0)] * 5
    points = spark.createDataFrame([(i, x, y, "k") for i, (x, y) in enumerate(at)], "n int, lon double, lat double, feed_code string")
    got = {r.n: (r.feed_id, r.live_arrivals) for r in places.locate_feeds(points, sources.feeds(spark, boxes)).collect()}

    def holds(b, x, y):
        _, _, w, s, e, n, *_ = b
        return None not in (w, x, y) and s <= y <= n and (w <= x <= e if w <= e else x >= w or x <= e)

    area = lambda b: ((b[4] - b[2]) % 360 if b[2] > b[4] else b[4] - b[2]) * (b[5] - b[3])
    for i, (x, y) in enumerate(at):
        best = min((b for b in boxes if holds(b, x, y)), key=lambda b: (area(b), b[0]), default=boxes[0])
        assert got[i] == (best[0], best[6]), (i, x, y)
    assert len(got) == len(at)
