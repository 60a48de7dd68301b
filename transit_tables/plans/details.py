"""Queries of single functions and smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, order, sql
from ..operators import diagram, graphs, live, network, places, schedule, shapes
from ..sources import artefacts, feeds
from . import queries as q
from .fixtures import DIRECTED, PATTERNS, VISITS, load, oracle

#: The moment that arrivals are compared with.
NOW = "2024-01-15 00:00:00"


def parsed_arrivals(s, d):
    """Arrival texts in Indian time as milliseconds since 1970, milliseconds from now, and texts for readers."""
    (arrivals,) = load(s, d, "arrival_texts")
    at = clock.parse_ist(F.col("arrivaltime"))
    rows = arrivals.select("event_id", clock.epoch_ms(at).alias("epoch_ms"), clock.duration_ms(at, F.expr(f"timestamp_ntz'{NOW}'")).alias("duration_ms"))
    return rows.withColumns({"text": clock.arrival_text(F.col("duration_ms")), "label": clock.arrival_label(F.col("duration_ms"))})


def service_durations(s, d):
    rows = q.first_last_times(s, d).withColumn("hours", clock.service_span(F.col("first"), F.col("last"))["duration"])
    return rows.select("feed_id", "stop_id", "no", clock.format_duration(F.col("hours")).alias("duration"))


def route_keys(s, d):
    rows = q._patterns(s, d).select("feed_id", order.route_key(F.col("route_id"), F.col("destination"), F.col("variant_idx")).alias("key"))
    return rows.select("feed_id", "key", order.split_route_key(F.col("key")).alias("k")).select("feed_id", "key", "k.*")


def variant_similarity(s, d):
    """How alike the first two variants to each destination are."""
    known = q.save(q._patterns(s, d).where("variant_idx < 2").select("feed_id", "route_id", "destination", "variant_idx", "stops"), "variants")
    a, b = (known.where(F.col("variant_idx") == i).select("feed_id", "route_id", "destination", F.col("stops").alias(x)) for i, x in enumerate("ab"))
    return a.join(b, ["feed_id", "route_id", "destination"]).select("feed_id", "route_id", "destination", F.round(order.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


def strict_positions(s, d):
    """Events with a place on the earth, the first of three ways in which it may be given."""
    (raw,) = load(s, d, "raw_places")
    placed = raw.withColumn("location", live.first_location(F.when(F.col("lat1").isNotNull(), F.struct(F.col("lat1").alias("lat"), F.col("lng1").alias("lng"))), F.when(F.col("lng2").isNotNull(), F.array("lng2", "lat2")), F.col("lat3"), F.col("lng3")))
    return placed.where(live.strict_coordinate(F.col("location.lat"), F.col("location.lng"))).select("event_id", "location.lat", "location.lng")


def fresh_stops(s, d):
    return live.data_present(q._live(s, d))


def pinned_services(s, d):
    (predictions,) = load(s, d, "predictions")
    pinned = predictions.select("feed_id", "no").distinct().unionByName(predictions.select("feed_id", F.concat(F.lit("X"), "vehicle_id").alias("no")).distinct())
    return live.active_pinned(pinned, q._live(s, d).where("frequency > 1"))


def located_vehicles(s, d):
    (vehicles,) = load(s, d, "vehicles")
    rows = live.with_location(live.dedupe_vehicles(vehicles).select("feed_id", "vehicle_id", "vehicle_number"), live.latest_positions(vehicles))
    return rows.select("feed_id", "vehicle_id", "vehicle_number", "location.lat", "location.lng")


def numbered_routes(s, d):
    """Route of each service number, whatever its case, by the first known route."""
    (routes,) = load(s, d, "routes")
    known = routes.select("feed_id", F.concat(F.lit("N"), F.substring("route_id", -2, 2)).alias("no"), "route_id", F.substring("route_id", 2, 9).cast("long").alias("ord"))
    asked = known.select("feed_id", F.lower("no").alias("no")).distinct().unionByName(known.select("feed_id", F.concat("no", F.lit("z")).alias("no")).distinct())
    return live.route_ids(asked, known)


def weekend_services(s, d):
    return schedule.weekend_flags(q.combine_first_last(s, d))


def usable_services(s, d):
    return network.usable_services(q._patterns(s, d))


def _own_shapes(s, d):
    """Feed tables in which one feed has shapes of its own, made of each trip's stops."""
    routes, directed, times = q._trips(s, d)
    stops = q._stops(s, d)
    trips = directed.withColumn("shape_id", F.expr("if(feed_id = 'BUILDING' and direction = '0', concat('own-', route_id), null)"))
    points = shapes.standin_shapes(directed.where("feed_id = 'BUILDING' and direction = '0'"), times, stops)
    own = points.withColumn("shape_id", F.concat(F.lit("own-"), F.regexp_replace("shape_id", "-0$", "")))
    return trips, own, directed, times, stops


def route_shapes(s, d):
    """Points of each route's own shapes, or of stand-ins in feeds without any."""
    lines = shapes.route_shapes(*_own_shapes(s, d))
    back = shapes.decode_shapes(lines).join(lines.select("feed_id", "route_id", "shape_id"), ["feed_id", "shape_id"])
    return back.select("feed_id", "route_id", "shape_id", "pt_seq", F.round(F.col("lat") * 100000).cast("long").alias("lat_e5"), F.round(F.col("lon") * 100000).cast("long").alias("lon_e5"))


def level_paths(s, d):
    """Shapes lifted by levels, here a digit of the route's number."""
    points = q._shape_points(s, d)
    route_of = points.select("feed_id", "shape_id").distinct().withColumn("route_id", F.regexp_replace("shape_id", "-[^-]*$", ""))
    levels = load(s, d, "routes")[0].select("feed_id", "route_id", (F.substring("route_id", -1, 1).cast("int") + 1).alias("level"))
    return shapes.level_paths(points, route_of, levels).select("feed_id", "route_id", "shape_id", "level", "pt_seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "z")


def stop_rings(s, d):
    rings = shapes.stop_markers(q._stops(s, d)).select("feed_id", "stop_id", F.posexplode("ring").alias("corner", "p"))
    return rings.select("feed_id", "stop_id", "corner", F.round(F.get("p", F.lit(0)), 8).alias("lon"), F.round(F.get("p", F.lit(1)), 8).alias("lat"))


def prefix_groups(s, d):
    return diagram.prefix_groups(diagram.forward(q._top_routes(s, d)[0]), q._stops(s, d))


def forward_id_order(s, d):
    return diagram.order_by_forward_ids(q.save(q._top_routes(s, d)[0], "top"))


def ranking_rows(s, d):
    return artefacts.ranking_rows(q._scores(s, d).withColumn("score", F.col("score") / 7))


def variant_geometry(s, d):
    """Points of the line that each variant's key names, where its service has one."""
    lines = shapes.encode_shapes(q._shape_points(s, d)).select("feed_id", F.regexp_replace("shape_id", "-[^-]*$", "").alias("route_id"), F.regexp_extract("shape_id", "-([^-]*)$", 1).cast("int").alias("shape_idx"), "polyline")
    keys = q._patterns(s, d).select("feed_id", order.route_key(F.col("route_id"), F.col("destination"), F.col("variant_idx")).alias("key"))
    found = shapes.geometry_of_variants(lines, keys)
    points = shapes.decode_shapes(found.select("feed_id", F.concat_ws("-", "route_id", "shape_idx").alias("shape_id"), "polyline"))
    return points.groupBy("feed_id", "shape_id").agg(F.count("*").alias("points"))


def universal_names(s, d):
    """Areas, as names of their stops, that all routes of a feed reach."""
    areas = q._stops(s, d).withColumn("name", F.when(F.col("lat") < AREAS, "South").otherwise("North"))
    return graphs.universal_names(graphs.route_stops(q._patterns(s, d)), areas)


def simplified_shapes(s, d):
    return shapes.simplify_shapes(q._shape_points(s, d), 0.05)


def undecodable_shapes(s, d):
    """Lines by whether they can be decoded, where a third lost their last character and a third got one outside the alphabet."""
    lines = shapes.encode_shapes(q._shape_points(s, d))
    third = F.substring("shape_id", 2, 20).substr(F.lit(1), F.instr(F.substring("shape_id", 2, 20), "-") - 1).cast("bigint") % 3
    cut = F.col("polyline").substr(F.lit(1), F.length("polyline") - 1)
    broken = lines.withColumn("polyline", F.when(third == 0, cut).when(third == 1, F.concat("polyline", F.lit("!"))).otherwise(F.col("polyline")))
    return shapes.decodable(broken).select("feed_id", "shape_id", "error")


#: The latitude between two areas of the test tables' stops.
AREAS = 12.9705

#: An example registry around the stops of the test tables: boxes in boxes, two of one size, one over the date line.
PLACES = (
    ("default", "Default feed", -180.0, -90.0, 180.0, 90.0, False, False),
    ("city", "City", 77.4, 12.8, 77.7, 13.1, True, False),
    ("core", "Core", 77.5, 12.9, 77.6, 13.0, True, True),
    ("gate", "Gate", 77.6, 12.9, 77.7, 13.0, False, True),
    ("north", "North", 77.3, 13.0, 77.8, 13.3, False, True),
    ("dateline", "Dateline", 175.0, -20.0, -175.0, -10.0, True, True),
)


def feed_of_stops(s, d):
    """The feed of the smallest box around each stop."""
    stops = q._stops(s, d).select(F.col("feed_id").alias("own_feed"), "stop_id", "lon", "lat")
    return places.locate_feeds(stops, feeds.feeds(s, PLACES)).select("own_feed", "stop_id", "feed_id", "live_arrivals", "live_vehicles")


def shared_stop_labels(s, d):
    return network.shared_labels(q._patterns(s, d), load(s, d, "routes")[0].select("feed_id", "route_id"))


def stop_hours_in_sql(s, d):
    """Hours of service at each stop, by the functions that SQL can call."""
    sql.register(s)
    text = """SELECT feed_id, stop_id, min(gtfs_seconds(arrival_time)) AS first_s, max(gtfs_seconds(arrival_time)) AS last_s,
      hhmm_packed(min(gtfs_hhmm(arrival_time))) AS first, format_hhmm(hhmm_packed(max(gtfs_hhmm(arrival_time)))) AS last,
      max(arrival_label(schedule_ms(gtfs_hhmm(arrival_time, true), '12:00'))) AS label FROM {times} GROUP BY feed_id, stop_id"""
    return s.sql(text, times=load(s, d, "stop_times")[0])


QUERIES = {
    f.__name__: f
    for f in (
        parsed_arrivals, service_durations, route_keys, variant_similarity, strict_positions, fresh_stops, pinned_services, located_vehicles, numbered_routes, weekend_services, usable_services,
        route_shapes, level_paths, stop_rings, prefix_groups, forward_id_order, ranking_rows, variant_geometry, universal_names, simplified_shapes, undecodable_shapes,
        feed_of_stops, shared_stop_labels, stop_hours_in_sql,
    )
}

R, T, ST, S = "routes", "trips", "stop_times", "stops"
AHEAD = """,
ah AS (SELECT feed_id, stop_id, route_id, unnest(stops[at_:]) AS other, generate_subscripts(stops[at_:], 1) - 1 AS off_ FROM top8 WHERE at_ > 0),
an AS (SELECT ah.*, coalesce(stop_name, other) AS name FROM ah LEFT JOIN v_stops n ON n.feed_id = ah.feed_id AND n.stop_id = other WHERE off_ > 0)"""
MEMBERS = PATTERNS + """,
mem AS (SELECT DISTINCT feed_id, route_id, unnest(stops) AS stop_id FROM patterns)"""
KY0 = shapes.scales(0.0)[1]
FEED_LIST = "[" + ", ".join(f"'{f}'" for f in q.FEEDS) + "]"

BOXES = ", ".join(f"('{f}', {w}, {s}, {e}, {n}, {a}, {v})" for f, _, w, s, e, n, a, v in PLACES)
SHARED = VISITS + """,
two AS (SELECT *, dense_rank() OVER (PARTITION BY feed_id, route_id ORDER BY dest_rank, variant_idx) AS k FROM visits),
met AS (SELECT feed_id, stop_id FROM two WHERE k <= 2 GROUP BY ALL HAVING count(DISTINCT route_id) > 1)"""

ORACLE = {
    "feed_of_stops": oracle(f""",
box (feed, west, south, east, north, a, v) AS (VALUES {BOXES}),
held AS (SELECT s.feed_id AS own_feed, stop_id, feed, a, v, row_number() OVER (PARTITION BY s.feed_id, stop_id ORDER BY (CASE WHEN west > east THEN east + 360 - west ELSE east - west END) * (north - south), feed) AS k FROM v_stops s
  JOIN box ON stop_lat BETWEEN south AND north AND CASE WHEN west > east THEN stop_lon >= west OR stop_lon <= east ELSE stop_lon BETWEEN west AND east END)
 SELECT own_feed, stop_id, feed AS feed_id, a AS live_arrivals, v AS live_vehicles FROM held WHERE k = 1""", S),
    "shared_stop_labels": oracle(SHARED + """
 SELECT feed_id, stop_id, route_id, row_number() OVER (PARTITION BY feed_id, stop_id ORDER BY route_id) AS place FROM (SELECT DISTINCT feed_id, stop_id, route_id FROM visits SEMI JOIN met USING (feed_id, stop_id))""", T, ST),
    "stop_hours_in_sql": oracle("""
, t AS (SELECT *, CAST(substr(arrival_time, 1, 2) AS BIGINT) AS h, CAST(substr(arrival_time, 4, 2) AS BIGINT) AS m FROM v_stop_times),
u AS (SELECT feed_id, stop_id, h * 3600 + m * 60 AS s, lpad(CAST(h % 24 AS VARCHAR), 2, '0') AS hh, lpad(CAST(m AS VARCHAR), 2, '0') AS mm, h * 60 + m - 720 AS d FROM t)
 SELECT feed_id, stop_id, min(s) AS first_s, max(s) AS last_s, replace(min(hh || ':' || mm), ':', '') AS first, max(hh || ':' || mm) AS last,
  max(CASE WHEN d = 0 THEN 'N/A' WHEN d < 0 THEN 'Arriving' WHEN d = 1 THEN '1 min' ELSE CAST(d AS VARCHAR) || ' min' END) AS label FROM u GROUP BY ALL""", ST),
    "parsed_arrivals": oracle(f""", p AS (SELECT event_id, strptime(arrivaltime, '%d-%m-%Y %H:%M:%S') - INTERVAL 330 MINUTE AS at_ FROM v_arrival_texts),
m AS (SELECT event_id, epoch_ms(at_) AS epoch_ms, epoch_ms(at_) - epoch_ms(TIMESTAMP '{NOW}') AS duration_ms FROM p)
 SELECT *, CASE WHEN duration_ms < 60000 THEN 'Arr' ELSE CAST(duration_ms // 60000 AS VARCHAR) || 'm' END AS text,
  CASE WHEN duration_ms = 0 THEN 'N/A' WHEN duration_ms < 60000 THEN 'Arriving' WHEN duration_ms < 120000 THEN '1 min' ELSE CAST(duration_ms // 60000 AS VARCHAR) || ' min' END AS label FROM m""", "arrival_texts"),
    "service_durations": oracle(q.FIRST_LAST + """, m AS (SELECT *, CAST(substr(first, 1, 2) AS INTEGER) + CAST(substr(first, 3) AS INTEGER) / CAST(60 AS DOUBLE) AS a, CAST(substr(last, 1, 2) AS INTEGER) + CAST(substr(last, 3) AS INTEGER) / CAST(60 AS DOUBLE) AS b FROM fl),
n AS (SELECT *, CASE WHEN b < a THEN b + 24 ELSE b END - a AS h FROM m)
 SELECT feed_id, stop_id, no, CAST(CAST(floor(h) AS INTEGER) AS VARCHAR) || 'h ' || CAST(CAST(round((h - floor(h)) * 60) AS INTEGER) AS VARCHAR) || 'm' AS duration FROM n""", T, ST),
    "route_keys": oracle(PATTERNS + " SELECT feed_id, route_id || '|' || destination || '|' || CAST(variant_idx AS VARCHAR) AS key, route_id AS service, destination, CAST(variant_idx AS INTEGER) AS variant_idx FROM patterns", T, ST),
    "variant_similarity": oracle(PATTERNS + """ SELECT a.feed_id, a.route_id, a.destination, round(len(list_intersect(a.stops, b.stops)) / CAST(len(list_distinct(list_concat(a.stops, b.stops))) AS DOUBLE), 9) AS jaccard
 FROM patterns a JOIN patterns b ON a.feed_id = b.feed_id AND a.route_id = b.route_id AND a.destination = b.destination WHERE a.variant_idx = 0 AND b.variant_idx = 1""", T, ST),
    "strict_positions": oracle(""", f AS (SELECT event_id, CASE WHEN lat1 IS NOT NULL THEN lat1 WHEN lng2 IS NOT NULL THEN lat2 ELSE lat3 END AS lat, CASE WHEN lat1 IS NOT NULL THEN lng1 WHEN lng2 IS NOT NULL THEN lng2 ELSE lng3 END AS lng FROM v_raw_places)
 SELECT * FROM f WHERE abs(lat) <= 90 AND abs(lng) <= 180 AND NOT (lat = 0 AND lng = 0)""", "raw_places"),
    "fresh_stops": oracle(q.LIVE + " SELECT feed_id, stop_id, bool_or(coalesce(next_ms >= 0, false)) AS fresh FROM live GROUP BY ALL", "predictions", "vehicles"),
    "pinned_services": oracle(q.LIVE + " SELECT DISTINCT feed_id, no FROM live WHERE frequency > 1", "predictions", "vehicles"),
    "located_vehicles": oracle(""", one AS (SELECT *, row_number() OVER (PARTITION BY feed_id, vehicle_number ORDER BY CASE direction WHEN 'up' THEN 0 ELSE 1 END, ord) AS k FROM v_vehicles),
pos AS (SELECT *, row_number() OVER (PARTITION BY feed_id, vehicle_id ORDER BY ts DESC, ord DESC) AS k FROM v_vehicles WHERE NOT (lat = 0 AND lng = 0))
 SELECT one.feed_id, one.vehicle_id, one.vehicle_number, pos.lat, pos.lng FROM one LEFT JOIN pos ON pos.feed_id = one.feed_id AND pos.vehicle_id = one.vehicle_id AND pos.k = 1 WHERE one.k = 1""", "vehicles"),
    "numbered_routes": oracle(""", k AS (SELECT feed_id, 'N' || right(route_id, 2) AS no, route_id, CAST(substr(route_id, 2) AS BIGINT) AS ord FROM v_routes)
 SELECT feed_id, lower(no) AS no, arg_min(route_id, ord) AS route_id FROM k GROUP BY feed_id, lower(no) UNION ALL SELECT DISTINCT feed_id, no || 'z', NULL FROM k""", R),
    "weekend_services": oracle(q.FIRST_LAST + " SELECT DISTINCT feed_id, stop_id, true AS has_saturday, false AS has_sunday FROM fl", T, ST),
    "usable_services": oracle(PATTERNS + " SELECT feed_id, route_id FROM patterns GROUP BY ALL HAVING max(len(stops)) > 1", T, ST),
    "route_shapes": oracle(q.STANDIN + """ SELECT feed_id, regexp_replace(shape_id, '-[^-]*$', '') AS route_id, CASE WHEN feed_id = 'BUILDING' THEN 'own-' || regexp_replace(shape_id, '-[^-]*$', '') ELSE shape_id END AS shape_id, pt_seq,
  CAST(round(lat * 100000) AS BIGINT) AS lat_e5, CAST(round(lon * 100000) AS BIGINT) AS lon_e5 FROM pts WHERE feed_id <> 'BUILDING' OR shape_id LIKE '%-0'""", T, ST, S),
    "level_paths": oracle(q.STANDIN + """, l AS (SELECT *, regexp_replace(shape_id, '-[^-]*$', '') AS route_id FROM pts)
 SELECT feed_id, route_id, shape_id, CAST(right(route_id, 1) AS INTEGER) + 1 AS level, pt_seq, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(right(route_id, 1) AS DOUBLE) * 100 AS z FROM l""", T, ST, S),
    "stop_rings": oracle(f""", c AS (SELECT *, unnest([0, 1, 2, 3]) AS corner FROM v_stops), a AS (SELECT *, 2 * pi() / 3 * (corner % 3) AS w FROM c)
 SELECT feed_id, stop_id, corner, round(stop_lon + CAST(0.015 AS DOUBLE) * sin(w) / ({KY0!r} * cos(radians(stop_lat))), 8) AS lon, round(stop_lat + CAST(0.015 AS DOUBLE) * cos(w) / {KY0!r}, 8) AS lat FROM a""", S),
    "prefix_groups": oracle(q.ROUTES_AT + AHEAD + " SELECT feed_id, stop_id, off_ AS offset, name, count(*) AS routes FROM an GROUP BY ALL", T, ST, S),
    "forward_id_order": oracle(q.ROUTES_AT + """,
ah AS (SELECT feed_id, stop_id, route_id, unnest(stops[at_:]) AS other, generate_subscripts(stops[at_:], 1) - 1 AS off_ FROM top8 WHERE at_ > 0),
ks AS (SELECT feed_id, stop_id, route_id, list(other ORDER BY off_) AS key FROM ah WHERE off_ > 0 GROUP BY ALL)
 SELECT t.feed_id, t.stop_id, t.route_id, row_number() OVER (PARTITION BY t.feed_id, t.stop_id ORDER BY ks.key NULLS FIRST, t.route_id) AS place FROM top8 t LEFT JOIN ks ON ks.feed_id = t.feed_id AND ks.stop_id = t.stop_id AND ks.route_id = t.route_id""", T, ST),
    "ranking_rows": oracle(q.REACH.format(t="v_stop_times") + " SELECT feed_id, stop_id, round(CAST(destinations AS DOUBLE) / 7, 2) AS score FROM dc", ST),
    "variant_geometry": oracle(VISITS + q.STANDIN.removeprefix(DIRECTED) + """,
ks AS (SELECT DISTINCT feed_id, route_id || '-' || CAST(variant_idx AS VARCHAR) AS shape_id FROM patterns)
 SELECT feed_id, shape_id, count(*) AS points FROM pts WHERE EXISTS (SELECT 1 FROM ks WHERE ks.feed_id = pts.feed_id AND ks.shape_id = pts.shape_id) GROUP BY ALL""", T, ST, S),
    "universal_names": oracle(MEMBERS + f""",
nm AS (SELECT DISTINCT mem.feed_id, route_id, CASE WHEN stop_lat < CAST({AREAS!r} AS DOUBLE) THEN 'South' ELSE 'North' END AS name FROM mem JOIN v_stops n ON n.feed_id = mem.feed_id AND n.stop_id = mem.stop_id)
 SELECT feed_id, name FROM nm GROUP BY feed_id, name HAVING count(*) = (SELECT count(DISTINCT route_id) FROM nm n2 WHERE n2.feed_id = nm.feed_id)""", T, ST, S),
    "undecodable_shapes": oracle(q.STANDIN + """
 SELECT DISTINCT feed_id, shape_id, CASE WHEN CAST(split_part(substr(shape_id, 2), '-', 1) AS BIGINT) % 3 < 2 THEN 'not a polyline' END AS error FROM pts""", T, ST, S),
}

#: SQL of queries in ``queries`` that have none there.
MORE = {
    "major_stops": oracle(q.REACH.format(t="v_stop_times") + """,
r0 AS (SELECT feed_id, stop_id, destinations AS r, stop_id LIKE '%7' OR stop_id = 'S5' AS fixed, CAST(substr(stop_id, 2) AS BIGINT) AS ord FROM dc),
r1 AS (SELECT *, max(r) OVER (PARTITION BY feed_id) AS best, fixed OR r >= max(r) OVER (PARTITION BY feed_id) * CAST(0.2 AS DOUBLE) AS given FROM r0),
r2 AS (SELECT *, sum(CAST(given AS INTEGER)) OVER (PARTITION BY feed_id) + coalesce(sum(CAST(NOT given AS INTEGER)) OVER (PARTITION BY feed_id ORDER BY r DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM r1),
r3 AS (SELECT *, given OR max(CASE WHEN held >= 20 AND r < best * CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY r DESC, ord ROWS UNBOUNDED PRECEDING) = 0 AS kept FROM r2),
r4 AS (SELECT *, least(5, count(*) OVER (PARTITION BY feed_id)) - sum(CAST(kept AS INTEGER)) OVER (PARTITION BY feed_id) AS lack, sum(CAST(NOT kept AS INTEGER)) OVER (PARTITION BY feed_id ORDER BY r DESC, ord ROWS UNBOUNDED PRECEDING) AS spare FROM r3)
 SELECT feed_id, stop_id, kept OR spare <= lack AS selected FROM r4""", ST),
    "route_groups": oracle(MEMBERS + """,
nm AS (SELECT DISTINCT mem.feed_id, route_id, stop_name AS name FROM mem JOIN v_stops n ON n.feed_id = mem.feed_id AND n.stop_id = mem.stop_id),
tot AS (SELECT feed_id, count(DISTINCT route_id) AS routes FROM nm GROUP BY ALL),
ln AS (SELECT nm.feed_id, name, min(route_id) AS b FROM nm JOIN tot ON tot.feed_id = nm.feed_id GROUP BY nm.feed_id, name HAVING count(*) < max(routes) AND count(*) > 1),
ed AS MATERIALIZED (SELECT DISTINCT nm.feed_id, route_id AS a, b FROM nm JOIN ln ON ln.feed_id = nm.feed_id AND ln.name = nm.name WHERE route_id <> b),
bd AS MATERIALIZED (SELECT feed_id, a, b FROM ed UNION SELECT feed_id, b, a FROM ed),
reach(feed_id, x, y) AS (SELECT DISTINCT feed_id, route_id, route_id FROM mem UNION SELECT r.feed_id, r.x, bd.b FROM reach r JOIN bd ON bd.feed_id = r.feed_id AND bd.a = r.y)
 SELECT feed_id, x AS route_id, min(y) AS grp FROM reach GROUP BY ALL""", T, ST, S, recursive=True),
    "shared_prefix_order": oracle(q.ROUTES_AT.replace("WHERE coalesce(at_, 0) <> len(stops)", "") + AHEAD + """,
sz AS (SELECT *, -count(*) OVER (PARTITION BY feed_id, stop_id, off_, name) AS less FROM an),
ks AS (SELECT feed_id, stop_id, route_id, list({'less': less, 'name': name} ORDER BY off_) AS key FROM sz GROUP BY ALL)
 SELECT t.feed_id, t.stop_id, t.route_id, row_number() OVER (PARTITION BY t.feed_id, t.stop_id ORDER BY list_append(coalesce(ks.key, []), {'less': 1, 'name': ''}), t.route_id) AS place
 FROM top8 t LEFT JOIN ks ON ks.feed_id = t.feed_id AND ks.stop_id = t.stop_id AND ks.route_id = t.route_id""", T, ST, S),
    "snap_to_shapes": oracle(q.VEHICLE + q.STANDIN + f""",
legs AS (SELECT feed_id, lag(lon) OVER w AS x1, lag(lat) OVER w AS y1, lon AS x2, lat AS y2 FROM pts WINDOW w AS (PARTITION BY feed_id, shape_id ORDER BY pt_seq)),
lg AS (SELECT DISTINCT * FROM legs WHERE x1 IS NOT NULL),
v AS (SELECT {FEED_LIST}[CAST(vehicle_id AS INTEGER) % 5 + 1] AS feed_id, vehicle_id, lat, lng FROM vmap),
t0 AS (SELECT v.*, x1, y1, (x2 - x1) * {q.KX!r} AS dx, (y2 - y1) * {q.KY!r} AS dy, (lng - x1) * {q.KX!r} AS px, (lat - y1) * {q.KY!r} AS py, x2, y2 FROM v JOIN lg ON lg.feed_id = v.feed_id
  AND lng BETWEEN least(x1, x2) - 0.01 AND greatest(x1, x2) + 0.01 AND lat BETWEEN least(y1, y2) - 0.01 AND greatest(y1, y2) + 0.01),
t1 AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM t0),
t2 AS (SELECT *, x1 + t * (x2 - x1) AS sx, y1 + t * (y2 - y1) AS sy FROM t1),
t3 AS (SELECT vehicle_id, arg_min(sx, km) AS sx, arg_min(sy, km) AS sy, min(km) AS km FROM (SELECT *, sqrt(pow((sx - lng) * {q.KX!r}, 2) + pow((sy - lat) * {q.KY!r}, 2)) AS km FROM t2) WHERE km < 0.5 GROUP BY ALL)
 SELECT v.feed_id, v.vehicle_id, round(coalesce(sy, lat), 9) AS lat, round(coalesce(sx, lng), 9) AS lng, round(km * 1000, 3) AS metres FROM v LEFT JOIN t3 ON t3.vehicle_id = v.vehicle_id""", "vehicles", T, ST, S),
}
