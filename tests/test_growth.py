"""Steps whose rows, exchanges and sorts are fewer than they were, with the same results."""

import random

import pytest
from pyspark.sql import functions as F
from transit_tables.functions import clock
from transit_tables.operators import diagram, feeds, graphs, importance, network, pairing, patterns, schedule, search, shapes
from transit_tables.plans import details, queries

from test_whole import tables


def plan(df):
    """The plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def feed(spark):
    """Directed trips, visits, and patterns of five routes over twelve stops."""
    rng = random.Random(4)
    trips = [("f", f"t{k}", f"r{rng.randrange(5)}", str(rng.randrange(2)), k) for k in range(60)]
    times = [("f", t, f"s{rng.randrange(12)}", i, i, f"{rng.randrange(30):02d}:{rng.randrange(60):02d}:00") for _, t, *_ in trips for i in range(rng.randrange(1, 6))]
    directed = spark.createDataFrame(trips, "feed_id string, trip_id string, route_id string, direction string, ord int")
    visits = spark.createDataFrame(times, "feed_id string, trip_id string, stop_id string, stop_sequence int, ord int, arrival_time string")
    known = patterns.service_patterns(directed, visits)
    return directed, visits, spark.createDataFrame(known.collect(), known.schema)


def test_sets_are_not_cut_by_numbers_that_lie_apart(spark):
    lists = spark.createDataFrame([("f", [0, 40_000, 80_000]), ("f", [0, 120_000])], "feed_id string, stops array<long>")
    got = {r.stop_id: (r.part, sorted(r.dests)) for r in importance.destination_sets(lists).collect()}
    assert got == {0: (importance.WHOLE, [40_000, 80_000, 120_000]), 40_000: (importance.WHOLE, [80_000])} and importance.destination_sets(lists).count() == 2


def test_sets_beyond_a_part_are_cut(spark, monkeypatch):
    monkeypatch.setattr(importance, "PART", 4)
    lists = spark.createDataFrame([("f", list(range(9))), ("f", [6, 1])], "feed_id string, stops array<long>")
    got = {(r.stop_id, r.part): sorted(r.dests) for r in importance.destination_sets(lists).collect()}
    assert got[0, 0] == [1, 2, 3] and got[0, 1] == [4, 5, 6, 7] and got[0, 2] == [8] and got[6, importance.WHOLE] == [1, 7, 8]


def test_patterns_go_to_their_route_once(feed):
    directed, visits, known = feed
    made = patterns.service_patterns(directed, visits)
    assert exchanges(made) == 3 and exchanges(graphs.route_stops(made)) == 3
    lists = {r.trip_id: tuple(r.stops) for r in patterns.trip_stops(visits).collect()}
    seen = [(r.route_id, r.direction, r.ord, lists[r.trip_id]) for r in directed.collect() if r.trip_id in lists]
    ends = {}
    for route, direction, ord_, stops in seen:
        ends.setdefault((route, stops[-1]), []).append((direction, ord_))
    for r in known.collect():
        own = ends[r.route_id, r.destination]
        ranked = sorted((-len(v), min(v), d) for (route, d), v in ends.items() if route == r.route_id)
        assert r.destination_trips == len(own) and ranked[r.dest_rank - 1][2] == r.destination


def test_index_needs_no_exchange(feed):
    index = network.stop_index(feed[2])
    assert exchanges(index) == 0
    want = {(r.route_id, r.destination, r.variant_idx, s): (r.stops.index(s) + 1, len(r.stops) - r.stops.index(s) - 1) for r in feed[2].collect() for s in r.stops}
    assert {(r.route_id, r.destination, r.variant_idx, r.stop_id): (r.pos, r.remaining) for r in index.collect()} == want


def test_runs_with_equal_and_missing_indexes(spark):
    rows = spark.createDataFrame([("f", i) for i in (None, 5, 1, 2, 2, None, 3, 5, 8, 9, 9)], "feed_id string, idx long")
    got = diagram.run_segments(rows, ["feed_id"])
    assert sorted(((r.seg_start, r.seg_end) for r in got.collect()), key=str) == sorted([(None, None), (1, 3), (5, 5), (8, 9)], key=str)
    assert exchanges(got) == 1


def test_pairs_are_counted_where_they_are_made(spark):
    lists = spark.createDataFrame([("f", ["a", "b", "a", "c"]), ("f", ["b", "c"])], "feed_id string, stops array<string>")
    counts = importance.destination_counts(importance.pairs_of_lists(lists))
    assert {(r.stop_id, r.destinations) for r in counts.collect()} == {("a", 3), ("b", 2)} and exchanges(counts) == 1


def test_hops_are_made_distinct_in_one_direction(spark):
    lists = spark.createDataFrame([("f", ["b", "a", "b", "b", "c"]), ("f", ["c"])], "feed_id string, stops array<string>")
    near = importance.neighbors_of_lists(lists)
    assert {(r.stop_id, r.other) for r in near.collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")} and near.count() == 4
    assert "least(" in plan(near)


def test_lines_are_cut_into_points_without_windows_over_characters(spark):
    points = [("f", "a", i, 38.5 - i, -120.2 + 7 * i) for i in range(1, 5)]
    line = shapes.encode_shapes(spark.createDataFrame(points, "feed_id string, shape_id string, pt_seq int, lat double, lon double")).first().polyline
    lines = spark.createDataFrame([("f", "a", line), ("f", "b", line[:-1]), ("f", "c", ""), ("f", "d", None), ("f", "e", "?\n")], "feed_id string, shape_id string, polyline string")
    back = shapes.decode_shapes(lines)
    got = {(r.shape_id, r.pt_seq): (round(r.lat, 5), round(r.lon, 5)) for r in back.collect()}
    want = {(s, i): (lat, round(lon, 5)) for _, _, i, lat, lon in points for s in "ab" if s == "a" or i < 4}
    assert {k: v for k, v in got.items() if k[0] != "e"} == want and got["e", 1][0] == 0
    assert plan(back).count("Window [") == 1


def test_services_are_paired_in_batches(feed):
    paired = pairing.pair_opposite_stops(feed[2])
    assert "MapInArrow" in plan(paired)
    rows = {}
    for r in sorted(feed[2].collect(), key=lambda r: (r.dest_rank, r.variant_idx)):
        rows.setdefault(r.route_id, []).append(list(r.stops))
    want = {(k, i, a, b) for k, x in rows.items() for i, (a, b) in enumerate(pairing.pair_rows(x[0], x[1] if len(x) > 1 and len(x[1]) > 1 else None), 1)}
    assert {(r.route_id, r.row, r.outbound, r.inbound) for r in paired.collect()} == want


def test_first_and_last_without_the_schedule(feed):
    directed, visits, _ = feed
    plain, made = schedule.first_last(schedule.stop_schedule(directed, visits)), schedule.first_last_of_visits(directed, visits)
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in plain.collect()} and exchanges(made) < exchanges(plain)
    counts = schedule.stop_schedule(directed, visits).select("feed_id", "stop_id", "no", "direction", "trip_count")
    assert {tuple(r) for r in schedule.trip_counts(directed, visits).collect()} == {tuple(r) for r in counts.collect()}


def test_entries_are_made_once(spark, tmp_path):
    d = tables(spark, tmp_path, [5], [(1, 5)], [(1, 0, 1), (1, 0, 2)])
    assert "Union" not in plan(queries.combine_first_last(spark, d)) and "Union" not in plan(details.weekend_services(spark, d))


def test_top_routes_without_their_stops(feed):
    directed, visits, known = feed
    scores = importance.destination_counts(importance.reachable_pairs(visits)).withColumn("score", F.col("destinations").cast("double")).drop("destinations")
    times = schedule.stop_schedule(directed, visits)
    full = diagram.trips_at_stop(diagram.routes_for_stop(known), times, known)
    places = diagram.route_places(known)
    assert exchanges(places) <= 1
    wanted = {(r.stop_id, r.route_id): (r.destination, r.stops.index(r.stop_id) + 1 if r.stop_id in r.stops else 0) for r in full.collect()}
    assert {(r.stop_id, r.route_id): (r.destination, r["at"]) for r in places.collect()} == wanted
    few = diagram.top_routes(diagram.timed_trips(places.where("not last"), schedule.trip_counts(directed, visits)), scores, 3)
    cols = ["stop_id", "route_id", "destination", "trips", "place"]
    assert {tuple(r) for r in few.select(cols).collect()} == {tuple(r) for r in diagram.top_routes(diagram.drop_terminating(full), scores, 3).select(cols).collect()}


def test_groups_link_few_labels(spark, monkeypatch):
    members = spark.createDataFrame([("f", f"r{k}", f"s{x}") for k in range(30) for x in (k // 10, 9)], "feed_id string, route_id string, stop_id string")
    names = spark.createDataFrame([("f", f"s{x}", f"n{x}") for x in range(10)], "feed_id string, stop_id string, name string")
    linked, plain = [], graphs.components
    monkeypatch.setattr(graphs, "components", lambda edges, nodes: linked.append(nodes.distinct().count()) or plain(edges, nodes))
    got = {r.route_id: r.grp for r in graphs.route_groups(members, names).collect()}
    assert got == {f"r{k}": f"r{k // 10 * 10}" for k in range(30)} and linked == [3]


def test_times_are_written_without_a_formatter(spark):
    texts = ["7:5:00", "25:61:00", "-3:07", "123:4", "x:1", "", None, "8"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    made = rows.select(clock.gtfs_hhmm(F.col("t")), clock.gtfs_hhmm(F.col("t"), True), clock.hhmm_packed(F.col("t")))
    assert [tuple(r) for r in made.collect()] == [("07:05", "07:05", "0705"), ("01:61", "25:61", "2561"), ("-3:07", "-3:07", "-307"), ("03:04", "123:04", "12304"), ("x:1", "x:1", "0000"), ("", "", "0000"), (None, None, "0000"), ("8", "8", "0000")]
    assert "format_string" not in plan(made)


def test_levels_taken_are_bits_and_a_plain_area_is_one_band(spark):
    rng = random.Random(6)
    taken, plain = graphs.TakenLevels(4), {}
    for _ in range(300):
        stops = rng.sample("abcdefgh", rng.randint(1, 3))
        want = next(n for n in range(1, 999) if all(n not in plain.get(s, ()) for s in stops))
        for s in stops:
            plain.setdefault(s, set()).add(want)
        assert taken.take(stops) == want
    members = spark.range(3000).selectExpr("'f' feed_id", "concat('r', id) route_id", "concat('s', id % 100) stop_id").union(spark.range(3000).selectExpr("'f'", "concat('r', id)", "concat('s', (id + id div 100) % 100)")).distinct()
    none = members.limit(0).selectExpr("feed_id", "route_id", "0d as priority")
    bands = graphs.level_bands(members.join(graphs.areas(members), graphs.ROUTE), none)
    assert bands.select("band").distinct().count() == 1


def test_areas_of_visits_linked_a_few_at_a_time(spark):
    """Rings of 7 routes, null stops, lists and rows: a task that links 5 visits at a time leaves the rest to the labels."""
    lists = [("f", f"r{i}", [f"s{i // 7}-{i % 7}", f"s{i // 7}-{(i + 1) % 7}", None]) for i in range(70)] + [("g", "r1", ["s0-0"]), ("g", "r2", [None])]
    routes = spark.createDataFrame(lists, "feed_id string, route_id string, stops array<string>")
    want = {("f", f"r{i}"): min(f"r{i // 7 * 7 + k}" for k in range(7)) for i in range(70)} | {("g", "r1"): "r1"}
    for members in (routes, routes.select("feed_id", "route_id", F.explode("stops").alias("stop_id"))):
        for most in (5, graphs.LINKED):
            assert {(r.feed_id, r.route_id): r.area for r in graphs.areas(members, most=most).collect()} == want


def test_lists_of_routes_are_their_trips_stops(feed):
    directed, visits, known = feed
    lists = graphs.route_lists(directed, visits)
    want = {(r.route_id, r.stop_id) for r in graphs.route_stops(known).collect()}
    got = [(r.route_id, s) for r in lists.collect() for s in r.stops]
    assert set(got) == want and len(got) == len(want) and exchanges(lists) <= 3


def test_blocks_of_routes_meet_once_with_their_lists(spark, monkeypatch):
    """Areas of 20 routes in blocks of 16: a route is sent to few groups, a group counts few pairs at a time, and no list is kept for each stop."""
    monkeypatch.setattr(graphs, "COUNTED", 50)
    rng = random.Random(3)
    lists = {f"r{i}": sorted({f"s{i // 20}-{rng.randrange(12)}" for _ in range(6)}) for i in range(200)}
    routes = spark.createDataFrame([("f", r, [*x, None]) for r, x in lists.items()], "feed_id string, route_id string, stops array<string>")
    found = graphs.route_similarity(routes, 0.3, 16)
    want = {(a, b): k / (len(x) + len(y) + 2 - k) for a, x in lists.items() for b, y in lists.items() if a < b and (k := len({*x} & {*y})) / (len(x) + len(y) + 2 - k) >= 0.3}
    rows = found.collect()
    assert {(r.a, r.b): r.jaccard for r in rows} == want and len(rows) == len(want) > 50
    assert {r.route_id for r in graphs.cluster_routes(routes, 0.3).collect() if r.size == 1} == set(lists) - {r for x in want for r in x}
    assert "stop_id" not in found._jdf.queryExecution().optimizedPlan().toString() and graphs.BLOCK >= 16_384


def test_variants_of_a_start_meet_those_of_an_end_as_bits(spark, monkeypatch):
    """Stops cut into places of 3 variants and blocks of 2; counts and changes equal plain loops, also from a stop to itself."""
    monkeypatch.setattr(network, "TOGETHER", 3)
    monkeypatch.setattr(network, "STOPS", 2)
    rng = random.Random(9)
    lists = {("f", f"r{i // 2}", "d", i % 2): [f"s{x}" for x in rng.choices(range(8), k=rng.randint(1, 6))] for i in range(40)}
    known = spark.createDataFrame([(*k, 1, x) for k, x in lists.items()], "feed_id string, route_id string, destination string, variant_idx int, dest_rank int, stops array<string>")
    asked = {(f"s{rng.randrange(9)}", f"s{rng.randrange(9)}") for _ in range(30)} | {("s1", "s1")}
    direct, changes = {}, set()
    for s, e in asked:
        ways = {k for k, x in lists.items() if s in x and e in x[x.index(s) :]}
        direct[s, e] = len(ways)
        for k, x in lists.items():
            for m, y in lists.items():
                if s in x and k not in ways and e in y and (met := [z for z in dict.fromkeys(y[: y.index(e)]) if z in x[x.index(s) + 1 :] and z not in (s, e)]):
                    changes.add((s, e, *k[1:], *m[1:], tuple(met)))
    pairs = spark.createDataFrame([("f", *x) for x in asked], "feed_id string, start_stop string, end_stop string")
    rows = network.journeys_one_transfer(known, pairs)
    got = [(*r[1:9], tuple(r.transfers)) for r in rows.collect()]
    assert set(got) == changes and len(got) == len(changes) > 50
    counts = {(r.start_stop, r.end_stop): (r.direct, r.transfers) for r in network.journey_counts(known, pairs).collect()}
    assert counts == {k: (n, sum(c[:2] == k for c in changes)) for k, n in direct.items() if "s8" not in k}
    assert "FlatMapGroupsInArrow" in rows._jdf.queryExecution().toString()


def test_hits_of_equal_queries_are_put_in_order_once(spark, monkeypatch):
    """40 queries of one text and one of two texts: the hits are kept for two sets of texts, not for each query."""
    kept, plain = {}, search.save
    monkeypatch.setattr(search, "save", lambda rows, name: kept.update({name: rows.count()}) or plain(rows, name))
    asked = spark.createDataFrame([(f"q{i}", "335e" if i % 2 else " 335E") for i in range(40)] + [("two", "335E"), ("two", "majestic"), ("blank", " "), ("none", None)], "query_id string, text string")
    services = spark.createDataFrame([(f"r{i}", "Route 335E" if i % 3 else "Route 335D") for i in range(30)] + [("m", "Majestic")], "id string, text string")
    stops = spark.createDataFrame([("s", "335E")], "id string, text string")
    got = search.fuzzy_search(asked, services, stops).collect()
    ids = sorted((0.0 if i % 3 else 0.25, f"r{i}") for i in range(30))
    want = {q: {(r, score, k) for k, (score, r) in enumerate(x, 1)} for q, x in [(f"q{i}", ids) for i in range(40)] + [("two", sorted([*ids, (0.0, "m")]))]}
    assert {q: {(r.id, r.score, r.place) for r in got if r.query_id == q} for q in want} == want and len(got) == 40 * 30 + 31
    assert kept["hits"] == kept["ranked"] == 61
