"""Transit views over the test tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "orders", "lineitem", "supplier", "part", "events")

#: Name and text of each view, in order of dependence; braces name views and tables.
VIEWS = {
    "routes": """SELECT c_mktsegment AS feed_id, concat('R', c_custkey) AS route_id,
  concat(c_name, CASE WHEN c_custkey % 3 = 0 THEN ' UP' WHEN c_custkey % 3 = 1 THEN ' DOWN' ELSE '' END) AS route_long_name
FROM {customer}""",
    "trips": """SELECT c_mktsegment AS feed_id, concat('T', o_orderkey) AS trip_id, concat('R', o_custkey) AS route_id,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS direction_id, o_orderkey AS ord
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "lines": """SELECT l_orderkey, l_suppkey, l_partkey, CAST(o_custkey AS BIGINT) AS custkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "stop_times": """SELECT c_mktsegment AS feed_id, concat('T', l_orderkey) AS trip_id, concat('S', l_suppkey) AS stop_id, seq AS stop_sequence, seq AS ord,
  concat(lpad(CAST(CAST(floor(((l_orderkey * 7) % 1440 + seq * 3) / 60) AS BIGINT) AS STRING), 2, '0'), ':', lpad(CAST(((l_orderkey * 7) % 1440 + seq * 3) % 60 AS STRING), 2, '0'), ':00') AS arrival_time
FROM {lines} JOIN {customer} ON custkey = c_custkey""",
    "sparse_times": """SELECT c_mktsegment AS feed_id, concat('T', l_orderkey) AS trip_id, concat('P', l_partkey) AS stop_id, seq AS stop_sequence, seq AS ord
FROM {lines} JOIN {customer} ON custkey = c_custkey""",
    "stops": """SELECT feed_id, concat('S', s_suppkey) AS stop_id,
  concat(s_name, CASE WHEN s_suppkey % 7 = 0 THEN ' Int' ELSE '' END) AS stop_name,
  CAST(12.8 AS DOUBLE) + CAST(s_suppkey * 37 % 350 AS DOUBLE) / CAST(1000 AS DOUBLE) AS stop_lat,
  CAST(77.4 AS DOUBLE) + CAST(s_suppkey * 53 % 350 AS DOUBLE) / CAST(1000 AS DOUBLE) AS stop_lon, CAST(s_suppkey AS BIGINT) AS ord
FROM {supplier} JOIN (SELECT DISTINCT c_mktsegment AS feed_id FROM {customer}) f ON s_suppkey >= 0""",
    "predictions": """SELECT 'live' AS feed_id, CAST(user_id % 20 AS STRING) AS stop_id, event_type AS no, CAST(event_id % 3 AS STRING) AS destination,
  CAST(user_id AS STRING) AS vehicle_id, CAST(event_id % 2 AS INT) AS devicestatusflag, event_id AS ord,
  CASE WHEN event_id % 3 = 0 THEN 'DD' ELSE 'SD' END AS type, CASE WHEN event_id % 97 = 0 THEN 2 ELSE 1 END AS visit_number, CAST(event_id % 13 AS STRING) AS origin_code, concat('B', user_id) AS bus_no,
  CAST(floor(CAST(event_id * 977 % 7200000 AS DOUBLE)) AS BIGINT) - 600000 AS duration_ms
FROM {events}""",
    "vehicles": """SELECT 'live' AS feed_id, CAST(user_id AS STRING) AS vehicle_id, CAST(user_id % 97 AS STRING) AS vehicle_number,
  CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction, event_id AS ord, ts,
  CASE WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(12.8 AS DOUBLE) + CAST(event_id % 350 AS DOUBLE) / 1000 END AS lat,
  CASE WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(77.4 AS DOUBLE) + CAST(event_id % 353 AS DOUBLE) / 1000 END AS lng,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id % 20 AS STRING) END AS last_location, CAST(user_id % 7 AS STRING) AS current_location, CAST(NULL AS STRING) AS next_location
FROM {events}""",
    "arrival_texts": """SELECT event_id, concat(lpad(CAST(day(ts) AS STRING), 2, '0'), '-', lpad(CAST(month(ts) AS STRING), 2, '0'), '-', CAST(year(ts) AS STRING), ' ',
  lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0')) AS arrivaltime FROM {events}""",
    "raw_places": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 200 AS DOUBLE) - 100 END AS lat1, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 400 AS DOUBLE) - 200 END AS lng1,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 90 AS DOUBLE) END AS lat2, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 180 AS DOUBLE) END AS lng2,
  CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 10 AS DOUBLE) END AS lat3, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 15 AS DOUBLE) END AS lng3 FROM {events}""",
    "requests": """SELECT feed_id, concat('S', start_key) AS start_stop, concat('S', end_key) AS end_stop
FROM (SELECT DISTINCT c_mktsegment AS feed_id, CAST(c_custkey * 13 % n AS BIGINT) AS start_key, CAST((c_custkey * 29 + CAST(floor(c_custkey / n) AS BIGINT)) % n AS BIGINT) AS end_key
  FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) k) r WHERE start_key <> end_key""",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views as DataFrames."""
    known: dict[str, DataFrame] = {}

    def view(name: str) -> DataFrame:
        if name not in known:
            if name in VIEWS:
                text = VIEWS[name]
                known[name] = spark.sql(text, **{x: view(x) for x in (*TABLES, *VIEWS) if "{" + x + "}" in text})
            else:
                known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return known[name]

    return [view(n) for n in names]


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL of ``body`` over the named views. Each is a common table expression with the prefix v_."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for x in VIEWS:
            if "{" + x + "}" in VIEWS[name]:
                add(x)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    refs = {x: "v_" + x for x in VIEWS} | {x: x for x in TABLES}
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"v_{n} AS ({VIEWS[n].format(**refs)})" for n in wanted) + body


#: Common to the oracles of patterns: directed trips, stop lists, patterns with ranks and numbers.
DIRECTED = """,
directed AS (SELECT *, CAST(coalesce(direction_id, 0) AS VARCHAR) AS direction FROM v_trips)"""
PATTERNS = DIRECTED + """,
lists AS (SELECT feed_id, trip_id, list(stop_id ORDER BY stop_sequence, ord) AS stops FROM v_stop_times GROUP BY feed_id, trip_id),
seen AS (SELECT d.feed_id, d.route_id, d.trip_id, d.direction, d.ord, l.stops, l.stops[-1] AS destination FROM directed d JOIN lists l ON d.trip_id = l.trip_id AND d.feed_id = l.feed_id WHERE d.direction IN ('0', '1')),
variants AS (SELECT feed_id, route_id, destination, stops, min(direction || lpad(CAST(ord AS VARCHAR), 20, '0')) AS first_seen, count(DISTINCT trip_id) AS pattern_trips FROM seen GROUP BY ALL),
dests AS (SELECT feed_id, route_id, destination, min(direction || lpad(CAST(ord AS VARCHAR), 20, '0')) AS dest_seen, count(DISTINCT trip_id) AS destination_trips FROM seen GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feed_id, route_id ORDER BY destination_trips DESC, dest_seen) AS dest_rank FROM dests),
patterns AS (SELECT v.*, r.dest_rank, r.destination_trips, row_number() OVER (PARTITION BY v.feed_id, v.route_id, v.destination ORDER BY first_seen) - 1 AS variant_idx
  FROM variants v JOIN ranked r ON v.feed_id = r.feed_id AND v.route_id = r.route_id AND v.destination = r.destination)"""
VISITS = PATTERNS + """,
visits AS (SELECT feed_id, route_id, destination, dest_rank, variant_idx, stops, len(stops) AS n, unnest(stops) AS stop_id, generate_subscripts(stops, 1) AS pos FROM patterns)"""
