"""Feeds by place: the smallest box of the registry around a point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells are 2 ** level degrees wide. A box is laid over cells that are at least a quarter of its longer side.
LEVELS = range(-8, 8)


def box_cells(registry: DataFrame) -> DataFrame:
    """(level, cx, cy, feed_id, box) of every cell that a box touches, at most 36; boxes over the date line are two, those with nulls none."""
    over = F.col("west") > F.col("east")
    whole = F.struct("west", "east")
    parts = F.when(over, F.array(F.struct("west", F.lit(180.0).alias("east")), F.struct(F.lit(-180.0).alias("west"), "east"))).otherwise(F.array(whole))
    width = F.when(over, F.col("east") + 360 - F.col("west")).otherwise(F.col("east") - F.col("west"))
    area = (width * (F.col("north") - F.col("south"))).alias("area")
    known = registry.where("west is not null and east is not null and south is not null and north is not null")
    part = known.select("feed_id", area, "south", "north", F.explode(parts).alias("p")).select("feed_id", "area", "south", "north", "p.west", "p.east")
    span = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1e-9))
    level = F.least(F.greatest(F.ceil(F.log2(span / 4)), F.lit(LEVELS[0])), F.lit(LEVELS[-1])).cast("int")
    size = F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(F.col(c) / size)
    named = part.withColumn("level", level)
    box = F.struct("west", "south", "east", "north", "area").alias("box")
    columns = named.select("feed_id", "level", box, F.explode(F.sequence(cell("west"), cell("east"))).alias("cx"), cell("south").alias("low"), cell("north").alias("high"))
    return columns.select("level", "cx", F.explode(F.sequence("low", "high")).alias("cy"), "feed_id", "box")


def locate_feeds(points: DataFrame, registry: DataFrame, default: str = "default") -> DataFrame:
    """Rows with lon and lat, with ``feed_id`` of the smallest box around them, its edges included, and the feed's live flags.

    Boxes of equal size go by feed_id. Points that no box holds, or without a place, get the default feed. A point
    looks up one cell of each level that boxes have; points at one place are looked up once.
    """
    boxes = box_cells(registry)
    levels = sorted(r.level for r in boxes.select("level").distinct().collect())  # at most as many as LEVELS
    at = points.select("lon", "lat").where("lon is not null and lat is not null").distinct()
    size = F.pow(F.lit(2.0), F.col("level"))
    looked = at.withColumn("level", F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>"))).withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
    inside = F.col("lon").between(F.col("box.west"), F.col("box.east")) & F.col("lat").between(F.col("box.south"), F.col("box.north"))
    best = F.min(F.struct("box.area", "feed_id")).alias("best")
    found = looked.join(boxes, ["level", "cx", "cy"]).where(inside).groupBy("lon", "lat").agg(best)
    named = points.join(found.select("lon", "lat", F.col("best.feed_id").alias("_found")), ["lon", "lat"], "left")
    flags = registry.select(F.col("feed_id").alias("_known"), "live_arrivals", "live_vehicles")
    kept = [c for c in points.columns if c not in ("feed_id", "live_arrivals", "live_vehicles")]
    coded = named.withColumn("_feed", F.coalesce("_found", F.lit(default))).join(flags, F.col("_feed") == F.col("_known"), "left")
    return coded.select(*kept, F.col("_feed").alias("feed_id"), "live_arrivals", "live_vehicles")
