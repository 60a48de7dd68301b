"""Polylines: encoding, decoding, lengths, stand-ins, simplification, snapping."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import REF_LAT, ruler_distance_km, scales
from ..functions.order import split_route_key
from ..tables import save
from .patterns import representative_trips

SHAPE = ["feed_id", "shape_id"]
#: A number of a polyline: characters from _ on go on, any below ends it.
NUMBER = r"[^\x00-\x5E]*[\x00-\x5E]"


def encode_shapes(points: DataFrame) -> DataFrame:
    """(feed, shape, polyline) of points (feed, shape, pt_seq, lat, lon): deltas at precision 5, latitude first."""
    order = Window.partitionBy(*SHAPE).orderBy("pt_seq")
    whole = points
    for c in ("lat", "lon"):
        whole = whole.withColumn(f"{c}_e5", F.round(F.col(c) * 100000).cast("long"))
    for c in ("lat", "lon"):
        delta = F.col(f"{c}_e5") - F.coalesce(F.lag(f"{c}_e5").over(order), F.lit(0))
        whole = whole.withColumn(f"{c}_z", F.shiftleft(delta, 1).bitwiseXOR(F.shiftright(delta, 63)))
    for c in ("lat", "lon"):
        last = " ".join(f"when {c}_z < {1 << 5 * (k + 1)} then {k}" for k in range(6))
        whole = whole.withColumn("n", F.expr(f"case {last} else 6 end")).withColumn(f"{c}_t", F.expr(f"array_join(transform(sequence(0, n), i -> chr(63 + (shiftright({c}_z, 5 * i) & 31) + if(i < n, 32, 0))), '')"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("pt_seq", F.concat("lat_t", "lon_t").alias("t")))), lambda x: x["t"])
    return whole.groupBy(*SHAPE).agg(F.array_join(text, "").alias("polyline"))


def decode_shapes(lines: DataFrame) -> DataFrame:
    """(feed, shape, pt_seq, lat, lon) of polylines; pt_seq counts from 1. Points cut short at the end are left out.

    A line is cut into points where it is; only points are summed up in order.
    """
    numbers = F.regexp_extract_all("polyline", F.lit(f"({NUMBER})({NUMBER})"), F.lit(0))
    pairs = lines.select(*SHAPE, F.posexplode(numbers).alias("pt", "pair"))
    texts = pairs.select(*SHAPE, "pt", F.regexp_extract("pair", f"^({NUMBER})", 1).alias("dlat"), F.regexp_extract("pair", f"({NUMBER})\\z", 1).alias("dlon"))
    number = "aggregate(sequence(0, length({c}) - 1), 0L, (z, k) -> z + shiftleft(cast((ascii(substr({c}, k + 1, 1)) - 63) & 31 as bigint), 5 * k))"
    points = texts.select(*SHAPE, "pt", *(F.expr(number.format(c=c)).alias(c) for c in ("dlat", "dlon")))
    points = points.select(*SHAPE, "pt", *(F.shiftright(c, 1).bitwiseXOR(-(F.col(c).bitwiseAND(1))).alias(c) for c in ("dlat", "dlon")))
    upto = Window.partitionBy(*SHAPE).orderBy("pt").rowsBetween(Window.unboundedPreceding, 0)
    return points.select(*SHAPE, (F.col("pt") + 1).alias("pt_seq"), (F.sum("dlat").over(upto) / 100000).alias("lat"), (F.sum("dlon").over(upto) / 100000).alias("lon"))


def decodable(lines: DataFrame) -> DataFrame:
    """Lines of the alphabet whose last number is complete and which hold whole points."""
    ends = F.length(F.regexp_replace("polyline", "[_-~`-~]", ""))
    ok = F.col("polyline").rlike(r"^[?-~]+$") & F.substring("polyline", -1, 1).rlike(r"^[?-^]$") & (ends % 2 == 0)
    return lines.withColumn("error", F.when(ok, F.lit(None)).otherwise(F.lit("not a polyline")))


def standin_shapes(directed: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Points (feed, shape, pt_seq, lat, lon) of each route and direction: the stops of its first trip; shape_id is "route-direction"."""
    visits = stop_times.join(representative_trips(directed), ["feed_id", "trip_id"])
    placed = visits.join(stops.select("feed_id", "stop_id", "lat", "lon"), ["feed_id", "stop_id"], "left").where("lat is not null and lon is not null")
    seq = F.row_number().over(Window.partitionBy("feed_id", "route_id", "direction").orderBy("stop_sequence", "ord"))
    return placed.select("feed_id", F.concat_ws("-", "route_id", "direction").alias("shape_id"), seq.alias("pt_seq"), "lat", "lon")


def route_shapes(trips: DataFrame, shapes: DataFrame | None, directed: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """(feed, route, shape, polyline): each route's distinct shapes; stand-ins for feeds without shapes or without shape_id."""
    standins = encode_shapes(standin_shapes(directed, stop_times, stops)).withColumn("route_id", F.regexp_replace("shape_id", "-[^-]*$", ""))
    if shapes is None or "shape_id" not in trips.columns:
        return standins.select("feed_id", "route_id", "shape_id", "polyline")
    pairs = trips.where("shape_id is not null").select("feed_id", "route_id", "shape_id").distinct()
    own = encode_shapes(shapes).join(pairs, SHAPE).select("feed_id", "route_id", "shape_id", "polyline")
    rest = standins.join(own.select("feed_id").distinct(), "feed_id", "left_anti")
    return own.unionByName(rest.select("feed_id", "route_id", "shape_id", "polyline"))


def geometry_of_variants(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(feed, service, variant, polyline) of keys (feed, key) "service|destination|variant": the variant-th line of the service; keys without one are dropped.

    Lines of a service (feed, route, shape_idx, polyline) count from 0 over all its shapes.
    """
    parts = keys.select("feed_id", split_route_key(F.col("key")).alias("k")).select("feed_id", F.col("k.service").alias("route_id"), F.col("k.variant_idx").alias("shape_idx"))
    return parts.distinct().join(lines, ["feed_id", "route_id", "shape_idx"]).select("feed_id", "route_id", "shape_idx", "polyline")


def shape_lengths(points: DataFrame, ref_lat: float = REF_LAT) -> DataFrame:
    """(feed, shape, km)."""
    order = Window.partitionBy(*SHAPE).orderBy("pt_seq")
    leg = ruler_distance_km(F.lag("lon").over(order), F.lag("lat").over(order), F.col("lon"), F.col("lat"), ref_lat)
    return points.withColumn("leg", leg).groupBy(*SHAPE).agg(F.coalesce(F.sum("leg"), F.lit(0.0)).alias("km"))


def simplify(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    work = [(0, len(x) - 1)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        t = np.clip((px * dx + py * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else 0.0
        off = (px - t * dx) ** 2 + (py - t * dy) ** 2
        k = int(np.argmax(off))
        if off[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            work += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify_shapes(points: DataFrame, tolerance: float = 0.0005) -> DataFrame:
    """The points that stay; one shape is handled by one task, shapes in parallel."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("pt_seq")
        return table.filter(pa.array(simplify(table.column("lon").to_numpy(), table.column("lat").to_numpy(), tolerance)))

    cols = points.select(*SHAPE, F.col("pt_seq").cast("long").alias("pt_seq"), "lat", "lon")
    return cols.groupBy(*SHAPE).applyInArrow(one, cols.schema)


def level_paths(points: DataFrame, route_of: DataFrame, levels: DataFrame, step: float = 100.0) -> DataFrame:
    """(feed, route, shape, level, pt_seq, lat, lon, z): z rises by ``step`` with each level."""
    return points.join(route_of, SHAPE).join(levels, ["feed_id", "route_id"]).select("feed_id", "route_id", "shape_id", "level", "pt_seq", "lat", "lon", ((F.col("level") - 1) * step).alias("z"))


def stop_markers(stops: DataFrame, metres: float = 15.0, corners: int = 3) -> DataFrame:
    """(feed, stop, ring): a closed ring of corners round each stop, as [lon, lat]."""
    angle = lambda i: F.lit(2 * math.pi / corners) * i
    ky = scales(0.0)[1]
    point = lambda i: F.array(F.col("lon") + F.lit(metres / 1000) * F.sin(angle(i)) / (F.lit(ky) * F.cos(F.radians("lat"))), F.col("lat") + F.lit(metres / 1000) * F.cos(angle(i)) / F.lit(ky))
    return stops.select("feed_id", "stop_id", F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: point(i % corners)).alias("ring"))


def snap_to_shapes(positions: DataFrame, points: DataFrame, metres: float = 10.0, ref_lat: float = REF_LAT) -> DataFrame:
    """(feed, vehicle, lat, lng, metres) with positions moved onto the nearest segment within reach, null metres if none is.

    Segments are registered in every cell that their line widened by the reach may touch: row by row, from
    the part of the line in the widened row. A position looks in its own cell, so none within reach is missed.
    Positions at one place are looked up once.
    """
    kx, ky = scales(ref_lat)
    reach = metres / 1000
    cell = max(0.005, 2 * reach / ky)
    order = Window.partitionBy(*SHAPE).orderBy("pt_seq")
    legs = points.select("feed_id", F.lag("lon").over(order).alias("x1"), F.lag("lat").over(order).alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2")).where("x1 is not null").distinct()
    at = lambda c: F.floor(c / cell).cast("long")
    span = lambda a, b, k: F.sequence(at(F.least(a, b) - reach / k), at(F.greatest(a, b) + reach / k))
    legs = legs.withColumns({"dx": (F.col("x2") - F.col("x1")) * kx, "dy": (F.col("y2") - F.col("y1")) * ky}).withColumn("square", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    legs = legs.withColumn("cy", F.explode(span(F.col("y1"), F.col("y2"), ky)))
    rise, slack = F.col("y2") - F.col("y1"), 1e-9
    share = lambda y: F.when(rise == 0, F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("y1")) / rise)))
    low, high = share(F.col("cy") * cell - reach / ky - slack), share((F.col("cy") + 1) * cell + reach / ky + slack)
    x = lambda t: F.col("x1") + t * (F.col("x2") - F.col("x1"))
    west, east = F.coalesce(x(low), F.col("x1")), F.coalesce(x(high), F.col("x2"))
    legs = legs.withColumn("west", F.least(west, east) - slack).withColumn("east", F.greatest(west, east) + slack).withColumn("cx", F.explode(span(F.col("west"), F.col("east"), kx))).drop("west", "east")
    legs = save(legs, "legs")
    placed = positions.select("feed_id", "lng", "lat").distinct().withColumn("cx", at(F.col("lng"))).withColumn("cy", at(F.col("lat")))
    near = placed.join(legs, ["feed_id", "cx", "cy"])
    along = (F.col("lng") - F.col("x1")) * kx * F.col("dx") + (F.col("lat") - F.col("y1")) * ky * F.col("dy")
    near = near.withColumn("t", F.when(F.col("square") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / F.col("square")))).otherwise(0.0))
    near = near.withColumn("sx", F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))).withColumn("sy", F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1")))
    near = near.withColumn("km", F.sqrt(F.pow((F.col("sx") - F.col("lng")) * kx, F.lit(2.0)) + F.pow((F.col("sy") - F.col("lat")) * ky, F.lit(2.0)))).where(F.col("km") < reach)
    best = near.groupBy("feed_id", "lng", "lat").agg(F.min(F.struct("km", "sx", "sy")).alias("b"))
    out = positions.join(best, ["feed_id", "lng", "lat"], "left")
    return out.select("feed_id", "vehicle_id", F.coalesce("b.sy", "lat").alias("lat"), F.coalesce("b.sx", "lng").alias("lng"), (F.col("b.km") * 1000).alias("metres"))
