"""The functions of this package for SQL, as SQL functions whose bodies Catalyst puts in place of their calls.

``register`` names them in a session as temporary functions. No Python runs in a query that calls them. Each gives
what the function of the same name in ``clock``, ``geo`` or ``order`` gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .geo import REF_LAT, scales

#: name, parameters, type and body, in order of dependence.
SCALAR = (
    ("time_part", "t STRING, i INT", "INT", "try_cast(get(split(t, ':'), i) AS INT)"),
    ("gtfs_seconds", "t STRING", "INT", "time_part(t, 0) * 3600 + time_part(t, 1) * 60 + coalesce(time_part(t, 2), 0)"),
    (
        "gtfs_hhmm", "t STRING, service_day BOOLEAN DEFAULT FALSE", "STRING",
        "CASE WHEN time_part(t, 0) IS NULL OR time_part(t, 1) IS NULL THEN t"
        " ELSE format_string('%02d:%02d', CASE WHEN NOT service_day AND time_part(t, 0) >= 24 THEN time_part(t, 0) % 24 ELSE time_part(t, 0) END, time_part(t, 1)) END",
    ),
    ("hhmm_packed", "t STRING", "STRING", "CASE WHEN time_part(t, 0) IS NULL OR time_part(t, 1) IS NULL THEN '0000' ELSE format_string('%02d%02d', time_part(t, 0), time_part(t, 1)) END"),
    ("first_last_entry", "route STRING, first STRING, last STRING", "STRING", "concat_ws(' ', route, first, last, '= = = =')"),
    ("entry_word", "entry STRING, i INT", "STRING", "get(split(entry, '\\\\s+'), i)"),
    ("entry_size", "entry STRING", "INT", "size(split(entry, '\\\\s+'))"),
    ("entry_slot", "entry STRING, i INT", "STRING", "CASE WHEN entry_size(entry) >= 7 THEN entry_word(entry, entry_size(entry) - 6 + i) ELSE entry_word(entry, i + 1) END"),
    (
        "parse_first_last", "entry STRING", "STRUCT<route: STRING, wd_first: STRING, wd_last: STRING, sat_first: STRING, sat_last: STRING, sun_first: STRING, sun_last: STRING>",
        "named_struct('route', CASE WHEN entry_size(entry) >= 7 THEN array_join(slice(split(entry, '\\\\s+'), 1, greatest(entry_size(entry) - 6, 1)), ' ') ELSE entry_word(entry, 0) END,"
        " 'wd_first', entry_slot(entry, 0), 'wd_last', entry_slot(entry, 1), 'sat_first', entry_slot(entry, 2), 'sat_last', entry_slot(entry, 3), 'sun_first', entry_slot(entry, 4), 'sun_last', entry_slot(entry, 5))",
    ),
    ("is_timing", "t STRING", "BOOLEAN", "coalesce(t RLIKE '\\\\d{4}', FALSE)"),
    ("hhmm_to_hours", "t STRING", "DOUBLE", "try_cast(substring(t, 1, 2) AS INT) + try_cast(substring(t, 3, 99) AS INT) / 60.0D"),
    ("span_hours", "first STRING, last STRING", "DOUBLE", "CASE WHEN hhmm_to_hours(last) < hhmm_to_hours(first) THEN hhmm_to_hours(last) + 24 ELSE hhmm_to_hours(last) END - hhmm_to_hours(first)"),
    (
        "service_span", "first STRING, last STRING", "STRUCT<start_hours: DOUBLE, duration: DOUBLE, left: DOUBLE, width: DOUBLE, wrap: DOUBLE>",
        "named_struct('start_hours', hhmm_to_hours(first), 'duration', span_hours(first, last), 'left', hhmm_to_hours(first) / 24 * 100, 'width', span_hours(first, last) / 24 * 100,"
        " 'wrap', greatest(hhmm_to_hours(first) / 24 * 100 + span_hours(first, last) / 24 * 100 - 100, 0.0D))",
    ),
    ("format_duration", "hours DOUBLE", "STRING", "concat(CAST(floor(hours) AS STRING), 'h ', CAST(CAST(round((hours - floor(hours)) * 60) AS INT) AS STRING), 'm')"),
    ("format_hhmm", "t STRING", "STRING", "CASE WHEN is_timing(t) THEN concat(substring(t, 1, 2), ':', substring(t, 3, 2)) ELSE '-' END"),
    ("full_ist", "t STRING", "STRING", "CASE WHEN trim(t) RLIKE '^\\\\d{2}-\\\\d{2}-\\\\d{4}$' THEN concat(trim(t), ' 00:00:00') ELSE trim(t) END"),
    (
        "parse_ist", "t STRING", "TIMESTAMP_NTZ",
        "to_timestamp_ntz(CASE WHEN full_ist(t) RLIKE '^\\\\d{2}-\\\\d{2}-\\\\d{4} \\\\d{2}:\\\\d{2}:\\\\d{2}$' THEN full_ist(t) END, 'dd-MM-yyyy HH:mm:ss') - INTERVAL 330 MINUTES",
    ),
    ("epoch_ms", "t TIMESTAMP_NTZ", "BIGINT", "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t) / 1000 AS BIGINT)"),
    ("arrival_ms", "arrival TIMESTAMP_NTZ, now TIMESTAMP_NTZ", "BIGINT", "CAST(timestampdiff(MICROSECOND, now, arrival) / 1000 AS BIGINT)"),
    ("schedule_ms", "hhmm STRING, now_hhmm STRING", "BIGINT", "CAST((time_part(hhmm, 0) * 60 + time_part(hhmm, 1)) - (time_part(now_hhmm, 0) * 60 + time_part(now_hhmm, 1)) AS BIGINT) * 60000"),
    ("arrival_text", "ms BIGINT", "STRING", "CASE WHEN floor(ms / 60000) <= 0 THEN 'Arr' ELSE concat(CAST(floor(ms / 60000) AS STRING), 'm') END"),
    (
        "arrival_label", "ms BIGINT", "STRING",
        "CASE WHEN ms IS NULL OR ms = 0 THEN 'N/A' WHEN floor(ms / 60000) <= 0 THEN 'Arriving' WHEN floor(ms / 60000) = 1 THEN '1 min' ELSE concat(CAST(floor(ms / 60000) AS STRING), ' min') END",
    ),
    ("planar_distance", "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "sqrt(pow(x1 - x2, 2.0D) + pow(y1 - y2, 2.0D))"),
    ("degrees_between", "a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b - a < -180 THEN b - a + 360 WHEN b - a > 180 THEN b - a - 360 ELSE b - a END"),
    ("ruler_distance_km", "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE", "sqrt(degrees_between(lon1, lon2) * {kx} * (degrees_between(lon1, lon2) * {kx}) + (lat2 - lat1) * {ky} * ((lat2 - lat1) * {ky}))"),
    ("ruler_bearing", "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE", "degrees(atan2(degrees_between(lon1, lon2) * {kx}, (lat2 - lat1) * {ky}))"),
    ("walking_minutes", "metres DOUBLE", "BIGINT", "CAST(ceil(metres / 1.4D / 60) AS BIGINT)"),
    (
        "opposite_stop_id", "stop STRING", "STRING",
        "CASE WHEN endswith(stop, '1') THEN concat(substr(stop, 1, length(stop) - 1), '9') WHEN endswith(stop, '9') THEN concat(substr(stop, 1, length(stop) - 1), '1') END",
    ),
    ("jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    ("route_key", "service STRING, destination STRING, variant INT", "STRING", "concat_ws('|', service, destination, CAST(variant AS STRING))"),
    (
        "split_route_key", "key STRING", "STRUCT<service: STRING, destination: STRING, variant_idx: INT>",
        "named_struct('service', get(split(key, '\\\\|'), 0), 'destination', get(split(key, '\\\\|'), 1), 'variant_idx', try_cast(get(split(key, '\\\\|'), 2) AS INT))",
    ),
    (
        "service_sort_key", "no STRING", "STRUCT<other: INT, first: INT, number: BIGINT, no: STRING>",
        "named_struct('other', CASE WHEN no RLIKE '^\\\\d' THEN 0 ELSE 1 END, 'first', CASE WHEN no RLIKE '^\\\\d' THEN try_cast(substring(no, 1, 1) AS INT) END,"
        " 'number', CASE WHEN no RLIKE '^\\\\d' THEN try_cast(regexp_extract(no, '^\\\\d+', 0) AS BIGINT) END, 'no', no)",
    ),
    (
        "schedule_sort_key", "no STRING", "STRUCT<number: DOUBLE, no: STRING>",
        "named_struct('number', coalesce(CASE WHEN no RLIKE '^\\\\d+$' THEN try_cast(no AS DOUBLE) END, double('inf')), 'no', no)",
    ),
)

#: Table functions over the view that ``register_schedule`` names.
TABLE = (
    (
        "first_last_at", "feed STRING, stop STRING", "no STRING, first STRING, last STRING, entry STRING",
        "SELECT no, hhmm_packed(a), hhmm_packed(b), first_last_entry(no, hhmm_packed(a), hhmm_packed(b)) FROM"
        " (SELECT no, min(array_min(trips)) AS a, max(array_max(trips)) AS b FROM {view} AS s WHERE s.feed_id = first_last_at.feed AND s.stop_id = first_last_at.stop GROUP BY no)",
    ),
    (
        "departures_at", "feed STRING, stop STRING, now_hhmm STRING, minutes INT", "no STRING, destination STRING, hhmm STRING, ms BIGINT",
        "SELECT no, destination, t, schedule_ms(t, departures_at.now_hhmm) FROM (SELECT s.no, s.destination, explode(s.trips) AS t FROM {view} AS s WHERE s.feed_id = departures_at.feed AND s.stop_id = departures_at.stop)"
        " WHERE schedule_ms(t, departures_at.now_hhmm) > 0 AND schedule_ms(t, departures_at.now_hhmm) <= departures_at.minutes * 60000L",
    ),
)


def register(spark: SparkSession, ref_lat: float = REF_LAT) -> list[str]:
    """Names the scalar functions in the session and returns their names; distances and bearings are those at ``ref_lat``."""
    kx, ky = scales(ref_lat)
    for name, given, kind, body in SCALAR:
        text = body.replace("{kx}", f"{kx!r}D").replace("{ky}", f"{ky!r}D")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {text}")
    return [name for name, *_ in SCALAR]


def register_schedule(spark: SparkSession, schedule: DataFrame, view: str = "stop_schedules") -> list[str]:
    """Names the schedule (feed_id, stop_id, no, destination, trips) as a view and the table functions over it; ``register`` comes first."""
    schedule.createOrReplaceTempView(view)
    for name, given, kind, body in TABLE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE({kind}) RETURN {body.replace('{view}', view)}")
    return [name for name, *_ in TABLE]
