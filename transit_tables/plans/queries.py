"""Queries over the test tables, each with its SQL; both are given by name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clock, geo
from ..functions.order import schedule_sort_key, service_sort_key
from ..operators import diagram, feeds, graphs, importance, live, network, pairing, patterns, report, schedule, search, shapes
from ..tables import save
from .fixtures import DIRECTED, PATTERNS, VISITS, load, oracle

NOW_HHMM = "08:00"
#: The feeds of the test tables.
FEEDS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _trips(s, d):
    routes, trips, times = load(s, d, "routes", "trips", "stop_times")
    return routes, feeds.with_direction(trips), times


def _read_once(s, d):
    """Directed trips and visits, saved, for queries that use them more than once."""
    _, directed, times = _trips(s, d)
    return save(directed, "trips"), save(times, "visits")


def _patterns(s, d, base=None):
    directed, times = base or _trips(s, d)[1:]
    known = patterns.service_patterns(directed.where(F.col("direction").isin("0", "1")), times)
    return save(known, "patterns") if base else known


def _stops(s, d):
    (stops,) = load(s, d, "stops")
    return stops.select("feed_id", "stop_id", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"), F.col("stop_name").alias("name"), "ord")


def _schedule(s, d, base=None):
    return schedule.stop_schedule(*(base or _trips(s, d)[1:]))


def _scores(s, d, base=None):
    pairs = importance.reachable_pairs(base[1] if base else load(s, d, "stop_times")[0])
    scores = importance.destination_counts(pairs).select("feed_id", "stop_id", F.col("destinations").cast("double").alias("score"))
    return save(scores, "scores") if base else scores


def _unnamed(s, d):
    """Trips without direction_id, and their routes."""
    routes, trips = load(s, d, "routes", "trips")
    return trips.drop("direction_id"), routes


# Queries that need more than one line.
def first_last_times(s, d):
    return schedule.first_last_of_visits(*_trips(s, d)[1:])


def combine_first_last(s, d):
    entries = first_last_times(s, d)
    other = F.concat_ws(" ", "no", F.lit("0930"), "last", F.lit("0700 2100 = ="))
    return schedule.combine_first_last(entries.select("feed_id", "stop_id", F.explode(F.array("entry", other)).alias("entry")))


def service_span(s, d):
    rows = first_last_times(s, d).withColumn("span", clock.service_span(F.col("first"), F.col("last")))
    return rows.select("feed_id", "stop_id", "no", F.round("span.duration", 6).alias("duration"), F.round("span.left", 6).alias("left_pct"), F.round("span.wrap", 6).alias("wrap_pct"), clock.format_hhmm(F.col("first")).alias("first_text"))


def stop_importance(s, d):
    scored = save(importance.stop_importance(save(load(s, d, "sparse_times")[0], "visits")), "importance")
    return importance.normalize_0_100(scored).select("feed_id", "stop_id", "destinations", "neighbors", "exclusive", F.round("importance", 6).alias("importance"), F.round("score", 6).alias("score"))


def _requests(s, d):
    return save(load(s, d, "requests")[0], "requests")


def journeys_one_transfer(s, d):
    known = save(_patterns(s, d), "patterns")
    return network.journeys_one_transfer(known, network.connected_requests(known, _requests(s, d))).withColumn("transfers", F.array_join("transfers", ","))


def journey_options(s, d):
    return network.journey_options(save(_patterns(s, d), "patterns"), save(_stops(s, d), "stops"), _requests(s, d))


def _stop_destinations(s, d):
    base = _read_once(s, d)
    return network.stop_destinations(network.stop_index(_patterns(s, d, base)), schedule.trip_counts(*base))


def _live(s, d):
    predictions, vehicles = load(s, d, "predictions", "vehicles")
    return live.live_services(predictions, live.vehicle_map(vehicles))


def _durations(rows, slots):
    """The slots as a text of their durations."""
    return rows.withColumn(slots, F.array_join(F.transform(slots, lambda x: x["duration_ms"].cast("string")), ","))


def live_services(s, d):
    return _live(s, d).select("feed_id", "stop_id", "no", "destination", "frequency", *(F.col(f"{x}.duration_ms").alias(f"{x}_ms") for x in live.SLOTS), *(F.col(f"next.{x}").alias(f"next_{x}") for x in live.ARRIVAL if x not in ("duration_ms", "location")), F.col("next.location.lat").alias("next_lat"))


def arrivals_with_fallback(s, d):
    static = live.static_services(_schedule(s, d), F.lit(NOW_HHMM))
    some = _live(s, d).withColumn("stop_id", F.concat(F.lit("S"), "stop_id")).withColumn("feed_id", F.lit("BUILDING"))
    return live.arrivals_with_fallback(some, static).select("feed_id", "stop_id", "no", "destination", "frequency", F.col("next.duration_ms").alias("next_ms"), "live")


def _places(s, d, ending=False):
    """The top routes at each stop without their stops, the stops' scores and the patterns; without routes that end at the stop unless ``ending``."""
    base = _read_once(s, d)
    known, scores = _patterns(s, d, base), _scores(s, d, base)
    at = diagram.route_places(known).where(F.lit(ending) | ~F.col("last")).drop("last", "at").repartition("feed_id", "stop_id")
    return diagram.top_routes(diagram.timed_trips(at, schedule.trip_counts(*base)), scores), scores, known


def _top_routes(s, d, ending=False):
    """The top routes at each stop with their stops, which only these few get, and the stops' scores."""
    top, scores, known = _places(s, d, ending)
    return diagram.with_stops(top, known), scores


def top_routes(s, d):
    return _places(s, d)[0].select("feed_id", "stop_id", "route_id", "destination", "trips", "place")


def stop_diagram(s, d):
    top, scores = _top_routes(s, d)
    rows = diagram.diagram_of(top.drop("score"), scores)
    return rows.select("feed_id", "stop_id", "other", F.round("avg_position", 6).alias("avg_position"), "routes")


def run_segments(s, d):
    rows = network.pattern_visits(_patterns(s, d)).select("feed_id", "stop_id", F.substring("route_id", 2, 9).cast("long").alias("idx"))
    return diagram.run_segments(rows, ["feed_id", "stop_id"])


def major_stops(s, d):
    scored = _scores(s, d).select("feed_id", "stop_id", F.col("score").alias("ranking"), F.col("stop_id").endswith("7").alias("terminal"), (F.col("stop_id") == "S5").alias("current"), F.substring("stop_id", 2, 9).cast("long").alias("ord"))
    return diagram.select_major_stops(scored, 20, ["feed_id"]).select("feed_id", "stop_id", "selected")


def _shape_points(s, d, base=None):
    directed, times = base or _trips(s, d)[1:]
    return shapes.standin_shapes(directed, times, _stops(s, d))


def shape_round_trip(s, d):
    back = shapes.decode_shapes(shapes.encode_shapes(_shape_points(s, d)))
    return back.select("feed_id", "shape_id", "pt_seq", F.round(F.col("lat") * 100000).cast("long").alias("lat_e5"), F.round(F.col("lon") * 100000).cast("long").alias("lon_e5"))


def shape_lengths(s, d):
    return shapes.shape_lengths(_shape_points(s, d)).select("feed_id", "shape_id", F.round("km", 6).alias("km"))


def _lists(s, d, base=None):
    """The distinct stops of each route's trips, as lists."""
    directed, times = base or _trips(s, d)[1:]
    return save(graphs.route_lists(directed.where(F.col("direction").isin("0", "1")), times), "lists")


def _members(s, d):
    return _lists(s, d).select("feed_id", "route_id", F.explode("stops").alias("stop_id"))


def _levels(s, d):
    """The routes' stops and levels."""
    _, directed, times = _trips(s, d)
    base = save(directed.select("feed_id", "trip_id", "route_id", "direction", "ord"), "trips"), save(times.drop("arrival_time"), "visits")
    lengths = shapes.shape_lengths(_shape_points(s, d, base)).withColumn("route_id", F.regexp_replace("shape_id", "-[^-]*$", "")).groupBy("feed_id", "route_id").agg(F.min("km").alias("priority"))
    lists = _lists(s, d, base)
    return lists, graphs.assign_levels(lists, lengths)


def assign_levels(s, d):
    return _levels(s, d)[1]


def stop_levels(s, d):
    return graphs.stop_levels(*_levels(s, d), _stops(s, d))


def cluster_routes(s, d):
    return graphs.cluster_routes(_lists(s, d))


def snap_to_shapes(s, d):
    """Vehicles go to the feeds by their numbers."""
    of = F.element_at(F.array(*map(F.lit, FEEDS)), (F.col("vehicle_id").cast("int") % len(FEEDS) + 1).cast("int"))
    vehicles = live.vehicle_map(load(s, d, "vehicles")[0]).select(of.alias("feed_id"), "vehicle_id", "lat", "lng")
    return shapes.snap_to_shapes(vehicles, _shape_points(s, d), 500.0).select("feed_id", "vehicle_id", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), F.round("metres", 3).alias("metres"))


def requests_known(s, d):
    asked = load(s, d, "routes")[0].select("feed_id", F.concat_ws("~", "route_id", F.concat(F.lit("X"), "route_id")).alias("wanted"))
    return network.known_services(asked, _patterns(s, d))


def _order(s, d, key):
    rows = load(s, d, "routes")[0].select("feed_id", F.expr("case when route_id like '%3' then route_id else substring(route_id, 2) end").alias("no"))
    return rows.select("feed_id", "no", F.row_number().over(Window.partitionBy("feed_id").orderBy(*key(F.col("no")))).alias("place"))


def fuzzy_search(s, d):
    names = load(s, d, "routes")[0].select(F.col("route_id").alias("id"), F.col("route_long_name").alias("text"))
    asked = names.where("cast(substring(id, 2) as bigint) % 50 = 0").select(F.col("id").alias("query_id"), F.expr("replace(substring(text, 10, 9), '00', '0')").alias("text"))
    return search.fuzzy_search(asked, names, _stops(s, d).select("feed_id", F.concat_ws("|", "feed_id", "stop_id").alias("id"), F.col("name").alias("text")))


def feed_report(s, d):
    routes, trips, times, stops = load(s, d, "routes", "trips", "stop_times", "stops")
    status = report.feed_status({"routes": routes, "trips": trips, "stop_times": times, "stops": stops, "shapes": stops.where("feed_id = 'BUILDING'")}, routes)
    return report.run_report(status)


QUERIES = {
    "first_last_times": first_last_times,
    "trip_counts": lambda s, d: feeds.trip_counts_pivoted(_trips(s, d)[1]),
    "valid_routes": lambda s, d: feeds.valid_routes(_trips(s, d)[1]),
    "valid_routes_fallback": lambda s, d: feeds.valid_routes(_trips(s, d)[1], 99),
    "named_directions": lambda s, d: feeds.trip_counts(feeds.with_direction(*_unnamed(s, d))),
    "pattern_directions": lambda s, d: feeds.trip_counts(feeds.pattern_directions(*_unnamed(s, d))),
    "served_stops": lambda s, d: feeds.served_stops(load(s, d, "stops")[0], load(s, d, "stop_times")[0], feeds.valid_trips(load(s, d, "trips")[0], feeds.valid_routes(_trips(s, d)[1]))),
    "service_patterns": lambda s, d: _patterns(s, d).withColumn("stops", F.array_join("stops", ",")),
    "route_endpoints": lambda s, d: patterns.route_endpoints(*_trips(s, d)[1:]),
    "stop_schedule": lambda s, d: _schedule(s, d).withColumn("trips", F.array_join("trips", ",")),
    "service_summary": lambda s, d: patterns.service_summary(_patterns(s, d)).withColumn("stops_each", F.array_join(F.transform("stops_each", lambda x: x.cast("string")), ",")),
    "combine_first_last": combine_first_last,
    "service_span": service_span,
    "reachable_counts": lambda s, d: importance.destination_counts(importance.reachable_pairs(load(s, d, "sparse_times")[0])),
    "stop_neighbors": lambda s, d: importance.stop_neighbors(load(s, d, "sparse_times")[0]),
    "stop_importance": stop_importance,
    "stop_index": lambda s, d: network.stop_index(_patterns(s, d), _stops(s, d)),
    "stop_destinations": lambda s, d: _stop_destinations(s, d).withColumn("services", F.array_join("services", ",")),
    "services_per_stop": lambda s, d: network.services_per_stop(network.stop_index(_patterns(s, d))).withColumn("services", F.array_join("services", ",")),
    "journeys_direct": lambda s, d: network.journeys_direct(save(_patterns(s, d), "patterns"), _requests(s, d)),
    "journeys_one_transfer": journeys_one_transfer,
    "nearest_stop": lambda s, d: network.nearest_stop(_stops(s, d)).withColumn("degrees", F.round("degrees", 9)),
    "journey_options": journey_options,
    "opposite_side": lambda s, d: network.with_opposite_side(_stops(s, d)),
    "interchange_stops": lambda s, d: _stops(s, d).where(network.is_interchange(F.col("name"))).select("feed_id", "stop_id", "name"),
    "shared_stops": lambda s, d: network.shared_stops(_patterns(s, d), load(s, d, "routes")[0].select("feed_id", "route_id")),
    "route_bounds": lambda s, d: network.route_bounds(_patterns(s, d), _stops(s, d)),
    "known_services": requests_known,
    "live_services": live_services,
    "soonest": lambda s, d: live.soonest_per_service(_live(s, d)),
    "service_issues": lambda s, d: live.service_issues(_live(s, d)),
    "arrivals_with_fallback": arrivals_with_fallback,
    "dedupe_vehicles": lambda s, d: live.dedupe_vehicles(load(s, d, "vehicles")[0]).select("feed_id", "vehicle_number", "vehicle_id", "direction", "ord"),
    "vehicle_map": lambda s, d: live.vehicle_map(load(s, d, "vehicles")[0]).select("feed_id", "vehicle_id", "direction", "ord"),
    "latest_positions": lambda s, d: live.latest_positions(load(s, d, "vehicles")[0]),
    "vehicles_by_stop": lambda s, d: live.vehicles_by_stop(load(s, d, "vehicles")[0]).withColumn("vehicles", F.array_join("vehicles", ",")),
    "top_routes": top_routes,
    "stop_diagram": stop_diagram,
    "run_segments": run_segments,
    "major_stops": major_stops,
    "route_similarity": lambda s, d: graphs.route_similarity(_lists(s, d), 0.2).withColumn("jaccard", F.round("jaccard", 9)),
    "cluster_routes": cluster_routes,
    "shape_round_trip": shape_round_trip,
    "shape_lengths": shape_lengths,
    "assign_levels": assign_levels,
    "route_groups": lambda s, d: graphs.route_groups(_members(s, d), _stops(s, d)),
    "snap_to_shapes": snap_to_shapes,
    "service_order": lambda s, d: _order(s, d, service_sort_key),
    "schedule_order": lambda s, d: _order(s, d, schedule_sort_key),
    "top_stops": lambda s, d: importance.top_stops(_scores(s, d)),
    "pair_opposite_stops": lambda s, d: pairing.pair_opposite_stops(_patterns(s, d)),
    "stop_levels": stop_levels,
    "shared_prefix_order": lambda s, d: diagram.order_by_shared_prefix(save(_top_routes(s, d, ending=True)[0], "top"), _stops(s, d)),
    "fuzzy_search": fuzzy_search,
    "feed_report": feed_report,
    "unknown_references": lambda s, d: feeds.unknown_references(load(s, d, "trips")[0], load(s, d, "stop_times")[0].where("stop_id <> 'S3'"), load(s, d, "routes")[0], _stops(s, d).where("stop_id <> 'S7'").select("feed_id", "stop_id", F.col("lat").alias("stop_lat"), F.expr("if(stop_id = 'S9', null, lon)").alias("stop_lon"))),
    "service_board": lambda s, d: _durations(live.service_board(_live(s, d), s.createDataFrame([("live", "click")], "feed_id string, no string")), "buses"),
    "grouped_arrivals": lambda s, d: _durations(live.group_by_service(_live(s, d)), "arrivals"),
    "longest_variants": lambda s, d: network.longest_variants(_patterns(s, d)).select("feed_id", "route_id", "destination", "variant_idx", "place"),
}

HHMM = "CASE WHEN CAST(substr(arrival_time, 1, 2) AS INTEGER) >= 24 THEN lpad(CAST(CAST(substr(arrival_time, 1, 2) AS INTEGER) % 24 AS VARCHAR), 2, '0') ELSE substr(arrival_time, 1, 2) END || ':' || substr(arrival_time, 4, 2)"
TIMED = DIRECTED + f""",
timed AS (SELECT t.feed_id, t.stop_id, d.route_id AS no, d.direction, {HHMM} AS hhmm FROM v_stop_times t JOIN directed d ON t.feed_id = d.feed_id AND t.trip_id = d.trip_id)"""
FIRST_LAST = TIMED + """,
fl AS (SELECT feed_id, stop_id, no, replace(min(hhmm), ':', '') AS first, replace(max(hhmm), ':', '') AS last FROM timed GROUP BY ALL)"""
ENDS = """,
rep AS (SELECT feed_id, route_id, direction, arg_min(trip_id, ord) AS trip_id FROM directed GROUP BY ALL),
ends AS (SELECT r.feed_id, r.route_id, r.direction, arg_min(t.stop_id, t.stop_sequence) AS origin, arg_max(t.stop_id, t.stop_sequence) AS destination
  FROM rep r JOIN v_stop_times t ON t.feed_id = r.feed_id AND t.trip_id = r.trip_id GROUP BY ALL)"""
SCHEDULE = TIMED + ENDS + """,
sched AS (SELECT x.feed_id, x.stop_id, x.no, x.direction, coalesce(e.origin, '') AS origin, coalesce(e.destination, '') AS destination, x.trips, len(x.trips) AS trip_count
  FROM (SELECT feed_id, stop_id, no, direction, list(DISTINCT hhmm ORDER BY hhmm) AS trips FROM timed GROUP BY ALL) x
  LEFT JOIN ends e ON e.feed_id = x.feed_id AND e.route_id = x.no AND e.direction = x.direction)"""
REACH = """,
rp AS (SELECT DISTINCT a.feed_id, a.stop_id, b.stop_id AS other FROM {t} a JOIN {t} b ON a.feed_id = b.feed_id AND a.trip_id = b.trip_id AND b.stop_sequence > a.stop_sequence),
dc AS (SELECT feed_id, stop_id, count(*) AS destinations FROM rp GROUP BY ALL)"""
HOPS = """,
hop AS (SELECT feed_id, stop_id, lead(stop_id) OVER (PARTITION BY feed_id, trip_id ORDER BY stop_sequence) AS nxt FROM v_sparse_times),
nb AS (SELECT feed_id, stop_id, nxt AS other FROM hop WHERE nxt <> stop_id UNION SELECT feed_id, nxt, stop_id FROM hop WHERE nxt <> stop_id)"""
INDEX = VISITS + """,
idx AS (SELECT feed_id, stop_id, route_id, destination, variant_idx, min(pos) AS pos, max(n) - min(pos) AS remaining FROM visits GROUP BY ALL)"""
DIRECT = VISITS + """,
firsts AS (SELECT feed_id, route_id, destination, variant_idx, stop_id, min(pos) AS p FROM visits GROUP BY ALL),
direct AS (SELECT DISTINCT q.feed_id, q.start_stop, q.end_stop, f.route_id, f.destination, f.variant_idx FROM {q} q
  JOIN firsts f ON f.feed_id = q.feed_id AND f.stop_id = q.start_stop
  JOIN visits e ON e.feed_id = q.feed_id AND e.stop_id = q.end_stop AND e.route_id = f.route_id AND e.destination = f.destination AND e.variant_idx = f.variant_idx AND e.pos >= f.p)"""
TRANSFER = DIRECT + """,
fwd AS (SELECT DISTINCT q.feed_id, q.start_stop, q.end_stop, v.stop_id, f.route_id, f.destination, f.variant_idx FROM {q} q
  JOIN firsts f ON f.feed_id = q.feed_id AND f.stop_id = q.start_stop
  JOIN visits v ON v.feed_id = f.feed_id AND v.route_id = f.route_id AND v.destination = f.destination AND v.variant_idx = f.variant_idx AND v.pos > f.p
  WHERE v.stop_id NOT IN (q.start_stop, q.end_stop) AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.feed_id = q.feed_id AND d.start_stop = q.start_stop AND d.end_stop = q.end_stop AND d.route_id = f.route_id AND d.destination = f.destination AND d.variant_idx = f.variant_idx)),
bwd AS (SELECT q.feed_id, q.start_stop, q.end_stop, v.stop_id, f.route_id, f.destination, f.variant_idx, min(v.pos) AS pos FROM {q} q
  JOIN firsts f ON f.feed_id = q.feed_id AND f.stop_id = q.end_stop
  JOIN visits v ON v.feed_id = f.feed_id AND v.route_id = f.route_id AND v.destination = f.destination AND v.variant_idx = f.variant_idx AND v.pos <= f.p
  WHERE v.stop_id NOT IN (q.start_stop, q.end_stop) GROUP BY ALL),
change AS (SELECT a.feed_id, a.start_stop, a.end_stop, a.route_id AS from_route, a.destination AS from_destination, a.variant_idx AS from_idx, b.route_id AS to_route, b.destination AS to_destination, b.variant_idx AS to_idx, string_agg(a.stop_id, ',' ORDER BY b.pos, a.stop_id) AS transfers
  FROM fwd a JOIN bwd b ON a.feed_id = b.feed_id AND a.start_stop = b.start_stop AND a.end_stop = b.end_stop AND a.stop_id = b.stop_id GROUP BY ALL)"""
NEAREST = """,
near AS (SELECT a.feed_id, a.stop_id, arg_min(b.stop_id, lpad(CAST(CAST(round(sqrt(pow(a.stop_lon - b.stop_lon, 2) + pow(a.stop_lat - b.stop_lat, 2)) * 1e9) AS BIGINT) AS VARCHAR), 20, '0') || CASE WHEN b.stop_name LIKE '% Int' THEN '1' ELSE '0' END || lpad(CAST(b.ord AS VARCHAR), 10, '0')) AS nearest,
  min(sqrt(pow(a.stop_lon - b.stop_lon, 2) + pow(a.stop_lat - b.stop_lat, 2))) AS degrees
  FROM v_stops a JOIN v_stops b ON a.feed_id = b.feed_id AND a.stop_id <> b.stop_id GROUP BY ALL)"""
KX, KY = geo.scales()
VEHICLE = """,
placed AS (SELECT *, row_number() OVER (PARTITION BY feed_id, vehicle_id ORDER BY CASE direction WHEN 'up' THEN 0 ELSE 1 END, CASE direction WHEN 'up' THEN -ord ELSE ord END) AS k FROM v_vehicles WHERE vehicle_id <> '' AND lat <> 0 AND lng <> 0),
vmap AS (SELECT * FROM placed WHERE k = 1)"""
LIVE = VEHICLE + """,
kept AS (SELECT p.*, v.lat, row_number() OVER (PARTITION BY p.feed_id, p.stop_id, p.no, p.destination ORDER BY duration_ms, p.ord) AS kk FROM v_predictions p LEFT JOIN vmap v ON v.feed_id = p.feed_id AND v.vehicle_id = p.vehicle_id WHERE duration_ms BETWEEN 0 AND 5400000),
live AS (SELECT feed_id, stop_id, no, destination, count(*) AS frequency, max(duration_ms) FILTER (kk = 1) AS next_ms, max(duration_ms) FILTER (kk = 2) AS next2_ms, max(duration_ms) FILTER (kk = 3) AS next3_ms,
  max(CASE WHEN devicestatusflag = 1 THEN 'SEA' ELSE 'SDA' END) FILTER (kk = 1) AS next_load, max(lat) FILTER (kk = 1) AS next_lat,
  max(type) FILTER (kk = 1) AS next_type, 'WAB' AS next_feature, max(visit_number) FILTER (kk = 1) AS next_visit_number, max(origin_code) FILTER (kk = 1) AS next_origin_code, destination AS next_destination_code,
  max(vehicle_id) FILTER (kk = 1) AS next_vehicle_id, max(bus_no) FILTER (kk = 1) AS next_bus_no, bool_or(kk <= 3 AND visit_number > 1) AS later_visit, min(ord) AS ord FROM kept GROUP BY ALL)"""
STANDIN = DIRECTED + """,
rep AS (SELECT feed_id, route_id, direction, arg_min(trip_id, ord) AS trip_id FROM directed GROUP BY ALL),
pts AS (SELECT r.feed_id, r.route_id || '-' || r.direction AS shape_id, row_number() OVER (PARTITION BY r.feed_id, r.route_id, r.direction ORDER BY stop_sequence) AS pt_seq, stop_lat AS lat, stop_lon AS lon
  FROM rep r JOIN v_stop_times t ON t.feed_id = r.feed_id AND t.trip_id = r.trip_id JOIN v_stops s ON s.feed_id = t.feed_id AND s.stop_id = t.stop_id)"""
ROUTES_AT = SCHEDULE + PATTERNS.removeprefix(DIRECTED) + REACH.format(t="v_stop_times") + """,
at0 AS (SELECT DISTINCT feed_id, route_id, destination, dest_rank, unnest(stops) AS stop_id FROM patterns),
at1 AS (SELECT feed_id, stop_id, route_id, arg_min(destination, dest_rank) AS destination FROM at0 GROUP BY ALL),
at2 AS (SELECT a.*, p.stops, list_position(p.stops, a.stop_id) AS at_ FROM at1 a JOIN patterns p ON p.feed_id = a.feed_id AND p.route_id = a.route_id AND p.destination = a.destination AND p.variant_idx = 0),
tt AS (SELECT feed_id, stop_id, no, CAST(sum(trip_count) AS BIGINT) AS trips FROM sched GROUP BY ALL),
nv AS (SELECT feed_id, route_id, count(*) AS variants FROM patterns GROUP BY ALL),
ranked2 AS (SELECT a.*, coalesce(tt.trips, nv.variants) AS trips, row_number() OVER (PARTITION BY a.feed_id, a.stop_id ORDER BY coalesce(tt.trips, nv.variants) DESC, coalesce(dc.destinations, 0) DESC, a.route_id) AS place
  FROM at2 a LEFT JOIN tt ON tt.feed_id = a.feed_id AND tt.stop_id = a.stop_id AND tt.no = a.route_id LEFT JOIN nv ON nv.feed_id = a.feed_id AND nv.route_id = a.route_id LEFT JOIN dc ON dc.feed_id = a.feed_id AND dc.stop_id = a.destination
  WHERE coalesce(at_, 0) <> len(stops)),
top8 AS (SELECT * FROM ranked2 WHERE place <= 8)"""
SIMILAR = PATTERNS + """,
mem AS (SELECT DISTINCT feed_id, route_id, unnest(stops) AS stop_id FROM patterns),
cnt AS (SELECT feed_id, route_id, count(*) AS n FROM mem GROUP BY ALL),
sim AS (SELECT p.feed_id, a, b, both_ / CAST(ca.n + cb.n - both_ AS DOUBLE) AS jaccard FROM (SELECT x.feed_id, x.route_id AS a, y.route_id AS b, count(*) AS both_ FROM mem x JOIN mem y ON x.feed_id = y.feed_id AND x.stop_id = y.stop_id AND x.route_id < y.route_id GROUP BY ALL) p
  JOIN cnt ca ON ca.feed_id = p.feed_id AND ca.route_id = a JOIN cnt cb ON cb.feed_id = p.feed_id AND cb.route_id = b)"""
R, T, ST, SP, S = "routes", "trips", "stop_times", "sparse_times", "stops"

#: Approximate search: every window of a target against every query.
SEARCH = """,
asked AS (SELECT DISTINCT route_id AS query_id, lower(trim(replace(substr(route_long_name, 10, 9), '00', '0'))) AS q FROM v_routes WHERE CAST(substr(route_id, 2) AS BIGINT) % 50 = 0),
services AS (SELECT query_id, id, min(levenshtein(q, substr(t, CAST(i AS BIGINT), len(q))) / len(q)) AS score
  FROM asked, (SELECT route_id AS id, lower(trim(route_long_name)) AS t FROM v_routes), LATERAL (SELECT unnest(range(1, greatest(len(t) - len(q) + 1, 1) + 1)) AS i) WHERE q <> '' GROUP BY ALL HAVING score <= 0.3),
others AS (SELECT query_id, id, min(levenshtein(q, substr(t, CAST(i AS BIGINT), len(q))) / len(q)) AS score
  FROM (SELECT * FROM asked WHERE query_id NOT IN (SELECT query_id FROM services GROUP BY query_id HAVING count(*) >= 20)), (SELECT feed_id || '|' || stop_id AS id, lower(trim(stop_name)) AS t FROM v_stops), LATERAL (SELECT unnest(range(1, greatest(len(t) - len(q) + 1, 1) + 1)) AS i) WHERE q <> '' GROUP BY ALL HAVING score <= 0.3),
hits AS (SELECT 'service' AS kind, * FROM services UNION ALL SELECT 'stop', * FROM others)
SELECT query_id, kind, id, score, row_number() OVER (PARTITION BY query_id, kind ORDER BY score, id) AS place FROM hits"""

ORACLE = {
    "fuzzy_search": oracle(SEARCH, "routes", "stops"),
    "first_last_times": oracle(FIRST_LAST + " SELECT *, no || ' ' || first || ' ' || last || ' = = = =' AS entry FROM fl", T, ST),
    "trip_counts": oracle(DIRECTED + " SELECT feed_id, route_id, count(*) FILTER (direction = '0') AS trips_0, count(*) FILTER (direction = '1') AS trips_1 FROM directed GROUP BY ALL", T),
    "valid_routes": oracle(DIRECTED + " SELECT DISTINCT feed_id, route_id FROM (SELECT feed_id, route_id, direction, count(*) AS n FROM directed GROUP BY ALL) WHERE n >= 2", T),
    "valid_routes_fallback": oracle(DIRECTED + " SELECT DISTINCT feed_id, route_id FROM directed", T),
    "named_directions": oracle(" SELECT t.feed_id, t.route_id, CASE WHEN upper(route_long_name) LIKE '%UP%' THEN '0' WHEN upper(route_long_name) LIKE '%DOWN%' THEN '1' ELSE '0' END AS direction, count(*) AS trips FROM v_trips t JOIN v_routes r ON t.feed_id = r.feed_id AND t.route_id = r.route_id GROUP BY ALL", T, R),
    "pattern_directions": oracle(" SELECT t.feed_id, t.route_id, CASE WHEN upper(route_long_name) LIKE '%DOWN%' THEN '1' ELSE '0' END AS direction, count(*) AS trips FROM v_trips t JOIN v_routes r ON t.feed_id = r.feed_id AND t.route_id = r.route_id GROUP BY ALL", T, R),
    "served_stops": oracle(DIRECTED + """, ok AS (SELECT DISTINCT feed_id, route_id FROM (SELECT feed_id, route_id, direction, count(*) AS n FROM directed GROUP BY ALL) WHERE n >= 2)
 SELECT feed_id, stop_id, stop_lon AS lon, stop_lat AS lat, stop_name AS name FROM v_stops s WHERE EXISTS (SELECT 1 FROM v_stop_times t JOIN v_trips x ON x.feed_id = t.feed_id AND x.trip_id = t.trip_id JOIN ok ON ok.feed_id = x.feed_id AND ok.route_id = x.route_id WHERE t.feed_id = s.feed_id AND t.stop_id = s.stop_id)""", T, ST, S),
    "service_patterns": oracle(PATTERNS + " SELECT feed_id, route_id, destination, dest_rank, variant_idx, array_to_string(stops, ',') AS stops, pattern_trips, destination_trips FROM patterns", T, ST),
    "route_endpoints": oracle(DIRECTED + ENDS + " SELECT * FROM ends", T, ST),
    "stop_schedule": oracle(SCHEDULE + " SELECT feed_id, stop_id, no, direction, origin, destination, array_to_string(trips, ',') AS trips, trip_count FROM sched", T, ST),
    "service_summary": oracle(PATTERNS + " SELECT feed_id, route_id, count(*) AS variants, string_agg(CAST(len(stops) AS VARCHAR), ',' ORDER BY dest_rank, variant_idx) AS stops_each FROM patterns GROUP BY ALL", T, ST),
    "combine_first_last": oracle(FIRST_LAST + " SELECT feed_id, stop_id, no AS route, least(first, '0930') AS wd_first, last AS wd_last, '0700' AS sat_first, '2100' AS sat_last, '=' AS sun_first, '=' AS sun_last FROM fl", T, ST),
    "service_span": oracle(FIRST_LAST + """, h AS (SELECT *, CAST(substr(first, 1, 2) AS INTEGER) + CAST(substr(first, 3) AS INTEGER) / CAST(60 AS DOUBLE) AS a, CAST(substr(last, 1, 2) AS INTEGER) + CAST(substr(last, 3) AS INTEGER) / CAST(60 AS DOUBLE) AS b FROM fl)
 SELECT feed_id, stop_id, no, round(CASE WHEN b < a THEN b + 24 ELSE b END - a, 6) AS duration, round(a / 24 * 100, 6) AS left_pct, round(greatest(a / 24 * 100 + (CASE WHEN b < a THEN b + 24 ELSE b END - a) / 24 * 100 - 100, 0), 6) AS wrap_pct, substr(first, 1, 2) || ':' || substr(first, 3) AS first_text FROM h""", T, ST),
    "reachable_counts": oracle(REACH.format(t="v_sparse_times") + " SELECT * FROM dc", SP),
    "stop_neighbors": oracle(HOPS + " SELECT * FROM nb", SP),
    "stop_importance": oracle(REACH.format(t="v_sparse_times") + HOPS + """,
av AS (SELECT nb.feed_id, nb.stop_id, count(*) AS neighbors, avg(coalesce(dc.destinations, 0)) AS m FROM nb LEFT JOIN dc ON dc.feed_id = nb.feed_id AND dc.stop_id = nb.other GROUP BY ALL),
ex AS (SELECT feed_id, stop_id, count(*) AS exclusive FROM rp WHERE NOT EXISTS (SELECT 1 FROM nb JOIN rp r2 ON r2.feed_id = nb.feed_id AND r2.stop_id = nb.other WHERE nb.feed_id = rp.feed_id AND nb.stop_id = rp.stop_id AND r2.other = rp.other) GROUP BY ALL),
im AS (SELECT dc.feed_id, dc.stop_id, destinations, coalesce(neighbors, 0) AS neighbors, coalesce(exclusive, 0) AS exclusive, CASE WHEN coalesce(neighbors, 0) = 0 THEN CAST(destinations AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) * CASE WHEN m > 0 THEN destinations / m ELSE destinations END + CAST(0.2 AS DOUBLE) * coalesce(exclusive, 0) END AS i
  FROM dc LEFT JOIN av ON av.feed_id = dc.feed_id AND av.stop_id = dc.stop_id LEFT JOIN ex ON ex.feed_id = dc.feed_id AND ex.stop_id = dc.stop_id)
 SELECT feed_id, stop_id, destinations, neighbors, exclusive, round(i, 6) AS importance, round(CASE WHEN max(i) OVER w > min(i) OVER w THEN 100 * (i - min(i) OVER w) / (max(i) OVER w - min(i) OVER w) ELSE 50 END, 6) AS score FROM im WINDOW w AS (PARTITION BY feed_id)""", SP),
    "stop_index": oracle(INDEX + " SELECT * FROM idx", T, ST),
    "stop_destinations": oracle(SCHEDULE + INDEX.removeprefix(DIRECTED) + """,
g AS (SELECT feed_id, stop_id, route_id, destination, count(*) AS nvar, max(remaining) AS r FROM idx GROUP BY ALL),
l AS (SELECT feed_id, stop_id, no, arg_max(trip_count, direction) AS trips FROM sched GROUP BY ALL)
 SELECT g.feed_id, g.stop_id, g.destination, string_agg(route_id, ',' ORDER BY route_id) AS services, max(r) AS max_remaining, CAST(sum(coalesce(trips, nvar)) AS BIGINT) AS total_trips FROM g LEFT JOIN l ON l.feed_id = g.feed_id AND l.stop_id = g.stop_id AND l.no = g.route_id GROUP BY ALL""", T, ST),
    "services_per_stop": oracle(INDEX + " SELECT feed_id, stop_id, string_agg(DISTINCT route_id, ',' ORDER BY route_id) AS services FROM idx GROUP BY ALL", T, ST),
    "journeys_direct": oracle(DIRECT.format(q="v_requests") + " SELECT * FROM direct", T, ST, "requests"),
    "journeys_one_transfer": oracle(TRANSFER.format(q="v_requests") + " SELECT * FROM change", T, ST, "requests"),
    "nearest_stop": oracle(NEAREST + " SELECT feed_id, stop_id, nearest, round(degrees, 9) AS degrees FROM near", S),
    "journey_options": oracle(NEAREST + """,
ways AS (SELECT q.feed_id, q.start_stop AS s, q.end_stop AS e, unnest([{'o': 'start_end', 'f': q.start_stop, 't': q.end_stop}, {'o': 'start_near_end', 'f': q.start_stop, 't': b.nearest}, {'o': 'near_start_end', 'f': a.nearest, 't': q.end_stop}, {'o': 'near_start_near_end', 'f': a.nearest, 't': b.nearest}]) AS w
  FROM v_requests q LEFT JOIN near a ON a.feed_id = q.feed_id AND a.stop_id = q.start_stop LEFT JOIN near b ON b.feed_id = q.feed_id AND b.stop_id = q.end_stop),
way AS (SELECT feed_id, s, e, w.o AS o, w.f AS f, w.t AS t FROM ways WHERE w.f IS NOT NULL AND w.t IS NOT NULL),
asked AS (SELECT DISTINCT feed_id, f AS start_stop, t AS end_stop FROM way)""" + TRANSFER.format(q="asked") + f""",
nd AS (SELECT feed_id, start_stop, end_stop, count(*) AS n FROM direct GROUP BY ALL), nc AS (SELECT feed_id, start_stop, end_stop, count(*) AS n FROM change GROUP BY ALL)
 SELECT way.feed_id, s AS start_stop, e AS end_stop, o AS option, f AS from_stop, t AS to_stop,
  CAST(coalesce(ceil(sqrt(pow((x2.stop_lon - x1.stop_lon) * {KX!r}, 2) + pow((x2.stop_lat - x1.stop_lat) * {KY!r}, 2)) * 1000 / CAST(1.4 AS DOUBLE) / 60), 0) + coalesce(ceil(sqrt(pow((y2.stop_lon - y1.stop_lon) * {KX!r}, 2) + pow((y2.stop_lat - y1.stop_lat) * {KY!r}, 2)) * 1000 / CAST(1.4 AS DOUBLE) / 60), 0) AS BIGINT) AS walk_minutes,
  coalesce(nd.n, 0) AS direct, coalesce(nc.n, 0) AS transfers
 FROM way LEFT JOIN nd ON nd.feed_id = way.feed_id AND nd.start_stop = f AND nd.end_stop = t LEFT JOIN nc ON nc.feed_id = way.feed_id AND nc.start_stop = f AND nc.end_stop = t
 LEFT JOIN v_stops x1 ON x1.feed_id = way.feed_id AND x1.stop_id = s LEFT JOIN v_stops x2 ON x2.feed_id = way.feed_id AND x2.stop_id = f LEFT JOIN v_stops y1 ON y1.feed_id = way.feed_id AND y1.stop_id = e LEFT JOIN v_stops y2 ON y2.feed_id = way.feed_id AND y2.stop_id = t""", T, ST, S, "requests"),
    "opposite_side": oracle(f""", o AS (SELECT *, CASE WHEN stop_id LIKE '%1' THEN substr(stop_id, 1, len(stop_id) - 1) || '9' WHEN stop_id LIKE '%9' THEN substr(stop_id, 1, len(stop_id) - 1) || '1' END AS op FROM v_stops)
 SELECT o.feed_id, o.stop_id, p.stop_id AS opposite, coalesce(degrees(atan2((p.stop_lon - o.stop_lon) * {KX!r}, (p.stop_lat - o.stop_lat) * {KY!r})) > 0, false) AS left FROM o LEFT JOIN v_stops p ON p.feed_id = o.feed_id AND p.stop_id = op""", S),
    "interchange_stops": oracle(" SELECT feed_id, stop_id, stop_name AS name FROM v_stops WHERE stop_name ILIKE '% int' AND NOT regexp_matches(lower(stop_name), '^(bef|aft|opp|bet)')", S),
    "shared_stops": oracle(PATTERNS + """,
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, route_id ORDER BY dest_rank, variant_idx) AS k FROM patterns) WHERE k <= 2),
vis AS (SELECT feed_id, route_id, unnest(stops) AS stop_id, generate_subscripts(stops, 1) AS pos, len(stops) AS n FROM two),
per AS (SELECT feed_id, stop_id, route_id, bool_or(pos = 1 OR pos = n) AS terminal FROM vis GROUP BY ALL)
 SELECT feed_id, stop_id, string_agg(route_id, ',' ORDER BY route_id) AS services, CASE WHEN bool_or(terminal) THEN 'end' ELSE 'intersect' END AS kind FROM per GROUP BY feed_id, stop_id HAVING count(*) > 1""", T, ST),
    "route_bounds": oracle(VISITS + " SELECT v.feed_id, v.route_id, min(stop_lon) AS west, min(stop_lat) AS south, max(stop_lon) AS east, max(stop_lat) AS north FROM visits v JOIN v_stops s ON s.feed_id = v.feed_id AND s.stop_id = v.stop_id GROUP BY ALL", T, ST, S),
    "known_services": oracle(PATTERNS + " SELECT DISTINCT feed_id, route_id FROM patterns", T, ST),
    "live_services": oracle(LIVE + " SELECT * EXCLUDE (later_visit, ord) FROM live", "predictions", "vehicles"),
    "soonest": oracle(LIVE + " SELECT feed_id, stop_id, no, min(next_ms) AS soonest_ms FROM live GROUP BY ALL", "predictions", "vehicles"),
    "service_issues": oracle(LIVE + " SELECT feed_id, stop_id, no, count(*) > 1 OR bool_or(later_visit) AS issue FROM live GROUP BY ALL", "predictions", "vehicles"),
    "arrivals_with_fallback": oracle(LIVE + SCHEDULE + """,
st AS (SELECT feed_id, stop_id, no, destination, (CAST(substr(t, 1, 2) AS BIGINT) * 60 + CAST(substr(t, 4, 2) AS BIGINT) - 480) * 60000 AS ms FROM (SELECT feed_id, stop_id, no, destination, unnest(trips) AS t FROM sched)),
lv AS (SELECT 'BUILDING' AS feed_id, 'S' || stop_id AS stop_id, no, destination, frequency, next_ms, true AS live FROM live)
 SELECT * FROM lv UNION ALL SELECT feed_id, stop_id, no, destination, count(*), min(ms), false FROM st WHERE ms > 0 AND ms <= 1800000 AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.feed_id = st.feed_id AND lv.stop_id = st.stop_id) GROUP BY feed_id, stop_id, no, destination""", "predictions", "vehicles", T, ST),
    "dedupe_vehicles": oracle(" SELECT feed_id, vehicle_number, vehicle_id, direction, ord FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, vehicle_number ORDER BY CASE direction WHEN 'up' THEN 0 ELSE 1 END, ord) AS k FROM v_vehicles) WHERE k = 1", "vehicles"),
    "vehicle_map": oracle(VEHICLE + " SELECT feed_id, vehicle_id, direction, ord FROM vmap", "vehicles"),
    "latest_positions": oracle(" SELECT feed_id, vehicle_id, ts, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, vehicle_id ORDER BY ts DESC, ord DESC) AS k FROM v_vehicles WHERE NOT (lat = 0 AND lng = 0)) WHERE k = 1", "vehicles"),
    "vehicles_by_stop": oracle(" SELECT feed_id, coalesce(nullif(last_location, ''), nullif(current_location, '')) AS stop_id, string_agg(DISTINCT vehicle_id, ',' ORDER BY vehicle_id) AS vehicles FROM v_vehicles GROUP BY ALL", "vehicles"),
    "top_routes": oracle(ROUTES_AT + " SELECT feed_id, stop_id, route_id, destination, trips, place FROM top8", T, ST),
    "stop_diagram": oracle(ROUTES_AT + """,
ah AS (SELECT feed_id, stop_id, route_id, unnest(stops[at_:]) AS other, generate_subscripts(stops[at_:], 1) - 1 AS off_, len(stops) - at_ AS last_ FROM top8 WHERE at_ > 0),
rk AS (SELECT ah.*, row_number() OVER (PARTITION BY ah.feed_id, ah.stop_id, route_id ORDER BY coalesce(dc.destinations, 0) DESC, off_) AS k FROM ah LEFT JOIN dc ON dc.feed_id = ah.feed_id AND dc.stop_id = other),
mj AS (SELECT DISTINCT feed_id, stop_id, other FROM rk WHERE k <= 5 OR off_ = last_ OR other = stop_id)
 SELECT ah.feed_id, ah.stop_id, ah.other, round(avg(DISTINCT off_), 6) AS avg_position, count(*) AS routes FROM ah JOIN mj ON mj.feed_id = ah.feed_id AND mj.stop_id = ah.stop_id AND mj.other = ah.other GROUP BY ALL""", T, ST),
    "run_segments": oracle(VISITS + """, x AS (SELECT DISTINCT feed_id, stop_id, CAST(substr(route_id, 2) AS BIGINT) AS idx FROM visits), y AS (SELECT *, idx - row_number() OVER (PARTITION BY feed_id, stop_id ORDER BY idx) AS island FROM x)
 SELECT feed_id, stop_id, min(idx) AS seg_start, max(idx) AS seg_end FROM y GROUP BY feed_id, stop_id, island""", T, ST),
    "route_similarity": oracle(SIMILAR + " SELECT feed_id, a, b, round(jaccard, 9) AS jaccard FROM sim WHERE jaccard >= 0.2", T, ST),
    "cluster_routes": oracle(SIMILAR + """,
ed AS MATERIALIZED (SELECT feed_id, a, b FROM sim WHERE jaccard >= 0.2 UNION ALL SELECT feed_id, b, a FROM sim WHERE jaccard >= 0.2),
reach(feed_id, x, y) AS (SELECT DISTINCT feed_id, route_id, route_id FROM patterns UNION SELECT r.feed_id, r.x, ed.b FROM reach r JOIN ed ON ed.feed_id = r.feed_id AND ed.a = r.y),
cl AS (SELECT feed_id, x AS route_id, min(y) AS cluster FROM reach GROUP BY ALL)
 SELECT *, count(*) OVER (PARTITION BY feed_id, cluster) AS size FROM cl""", T, ST, recursive=True),
    "service_order": oracle(""", n AS (SELECT feed_id, CASE WHEN route_id LIKE '%3' THEN route_id ELSE substr(route_id, 2) END AS no FROM v_routes)
 SELECT feed_id, no, row_number() OVER (PARTITION BY feed_id ORDER BY CASE WHEN no LIKE 'R%' THEN 1 ELSE 0 END, substr(no, 1, 1), TRY_CAST(no AS BIGINT), no) AS place FROM n""", R),
    "schedule_order": oracle(""", n AS (SELECT feed_id, CASE WHEN route_id LIKE '%3' THEN route_id ELSE substr(route_id, 2) END AS no FROM v_routes)
 SELECT feed_id, no, row_number() OVER (PARTITION BY feed_id ORDER BY TRY_CAST(no AS DOUBLE) NULLS LAST, no) AS place FROM n""", R),
    "top_stops": oracle(REACH.format(t="v_stop_times") + " SELECT feed_id, stop_id, CAST(destinations AS DOUBLE) AS score FROM dc ORDER BY destinations DESC, feed_id, stop_id LIMIT 20", ST),
    "feed_report": oracle(" SELECT count(DISTINCT feed_id) FILTER (feed_id = 'BUILDING') AS success, count(DISTINCT feed_id) FILTER (feed_id <> 'BUILDING') AS partial, CAST(0 AS BIGINT) AS error, 2 AS exit_code FROM v_routes", R),
    "unknown_references": oracle(" SELECT feed_id, 'visit_to_unknown_stop' AS what, count(*) AS n FROM v_stop_times WHERE stop_id = 'S7' GROUP BY feed_id UNION ALL SELECT feed_id, 'stop_without_coordinates', count(*) FROM v_stops WHERE stop_id = 'S9' GROUP BY feed_id", ST, S),
    "service_board": oracle(LIVE + " SELECT feed_id, stop_id, no, destination, frequency, concat_ws(',', next_ms, next2_ms, next3_ms) AS buses, no = 'click' AS pinned, row_number() OVER (PARTITION BY feed_id, stop_id ORDER BY no = 'click' DESC, frequency DESC, ord) AS place FROM live", "predictions", "vehicles"),
    "grouped_arrivals": oracle(LIVE + " SELECT feed_id, stop_id, no, arg_min(destination, ord) AS destination, arg_min(frequency, ord) AS frequency, string_agg(concat_ws(',', next_ms, next2_ms, next3_ms), ',' ORDER BY ord) AS arrivals FROM live GROUP BY ALL", "predictions", "vehicles"),
    "longest_variants": oracle(PATTERNS + " SELECT * FROM (SELECT feed_id, route_id, destination, variant_idx, row_number() OVER (PARTITION BY feed_id, route_id ORDER BY len(stops) DESC, dest_rank, variant_idx) AS place FROM patterns) WHERE place <= 2", T, ST),
    "shape_round_trip": oracle(STANDIN + " SELECT feed_id, shape_id, pt_seq, CAST(round(lat * 100000) AS BIGINT) AS lat_e5, CAST(round(lon * 100000) AS BIGINT) AS lon_e5 FROM pts", T, ST, S),
    "shape_lengths": oracle(STANDIN + f""", leg AS (SELECT feed_id, shape_id, sqrt(pow((lon - lag(lon) OVER w) * {KX!r}, 2) + pow((lat - lag(lat) OVER w) * {KY!r}, 2)) AS km FROM pts WINDOW w AS (PARTITION BY feed_id, shape_id ORDER BY pt_seq))
 SELECT feed_id, shape_id, round(coalesce(sum(km), 0), 6) AS km FROM leg GROUP BY ALL""", T, ST, S),
}
