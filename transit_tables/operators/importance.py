"""Importance of stops as interchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save
from .patterns import trip_stops

STOP = ["feed_id", "stop_id"]
#: Stop numbers of one part of a set of destinations, as many as a bitmap holds.
PART = 32768
#: Neighbours' destinations up to which they are held as arrays; beyond it, as bitmaps.
ARRAYS = 4096
#: The part of a set that is held whole.
WHOLE = -1


def distinct_patterns(stop_times: DataFrame) -> DataFrame:
    """(feed, stops): each stop list once, however many trips run it; pairs are made of these."""
    return trip_stops(stop_times).select("feed_id", "stops").distinct()


def pairs_of_lists(lists: DataFrame) -> DataFrame:
    """Distinct (feed, stop, other) of distinct stop lists: other comes later in some list; a loop reaches its own stop.

    The later stops are sent as lists, to where the pairs are made, and counts of a stop's pairs need no exchange more.
    """
    each = lists.select("feed_id", "stops", F.posexplode("stops").alias("at", "stop_id"))
    later = each.select(*STOP, F.slice("stops", F.col("at") + 2, F.size("stops")).alias("later")).where("size(later) > 0").repartition(*STOP)
    return later.select(*STOP, F.explode("later").alias("other")).distinct()


def reachable_pairs(stop_times: DataFrame) -> DataFrame:
    """Distinct (feed, stop, other): other comes later in some trip."""
    return pairs_of_lists(distinct_patterns(stop_times))


def destination_counts(pairs: DataFrame) -> DataFrame:
    """(feed, stop, destinations) from reachable pairs."""
    return pairs.groupBy(*STOP).agg(F.count("*").alias("destinations"))


def neighbors_of_lists(lists: DataFrame) -> DataFrame:
    """Distinct (feed, stop, other) of stop lists: neighbours in some list, in either direction, other than the stop itself."""
    each = lists.select("feed_id", F.explode(F.arrays_zip(F.col("stops").alias("a"), F.slice("stops", 2, F.size("stops")).alias("b"))).alias("hop")).select("feed_id", "hop.*").where("a <> b")
    once = each.select("feed_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ways = F.array(F.struct(F.col("a").alias("stop_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("stop_id"), F.col("a").alias("other")))
    return once.select("feed_id", F.explode(ways).alias("way")).select("feed_id", "way.*")


def stop_neighbors(stop_times: DataFrame) -> DataFrame:
    """Distinct (feed, stop, other): neighbours in some trip, in either direction."""
    return neighbors_of_lists(distinct_patterns(stop_times))


def stop_numbers(stop_times: DataFrame) -> DataFrame:
    """(feed, stop, number) of all stops; numbers are dense in runs of a feed's stops. Saved, so that they stay."""
    stops = stop_times.select(*STOP).distinct().repartitionByRange(*STOP).sortWithinPartitions(*STOP)
    return save(stops.withColumn("number", F.monotonically_increasing_id()), "numbers")


def destination_sets(lists: DataFrame) -> DataFrame:
    """(feed, stop, part, dests) of stop lists of numbers: the distinct later stops, at most ``PART`` in a row.

    Up to ``PART`` destinations of a stop are one row, whatever their numbers: their part is ``WHOLE``. Lists are sent to
    the stop that they are for once, and parts are made and put together there.
    """
    each = lists.select("feed_id", F.posexplode("stops").alias("at", "stop_id"), "stops")
    later = each.select(*STOP, F.slice("stops", F.col("at") + 2, F.size("stops")).alias("later")).where("size(later) > 0").repartition(*STOP)
    parts = later.select(*STOP, F.explode("later").alias("dest")).groupBy(*STOP, F.expr(f"dest div {PART}").alias("part")).agg(F.collect_set("dest").alias("dests"))
    small = F.sum(F.size("dests")).over(Window.partitionBy(*STOP)) <= PART
    joined = parts.withColumn("part", F.when(small, F.lit(WHOLE)).otherwise(F.col("part")))
    return joined.groupBy(*STOP, "part").agg(F.flatten(F.collect_list("dests")).alias("dests"))


def neighbor_means(sets: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(feed, stop, neighbors, avg_neighbor, members): number of neighbours, mean and sum of their destinations."""
    n = sets.groupBy("feed_id", F.col("stop_id").alias("other")).agg(F.sum(F.size("dests")).alias("m"))
    m = F.coalesce("m", F.lit(0))
    return neighbors.join(n, ["feed_id", "other"], "left").groupBy(*STOP).agg(F.count("*").alias("neighbors"), F.avg(m).alias("avg_neighbor"), F.sum(m).alias("members"))


def exclusive_counts(sets: DataFrame, neighbors: DataFrame, means: DataFrame, arrays: int = ARRAYS) -> DataFrame:
    """(feed, stop, exclusive): how many destinations of a stop none of its neighbours has.

    A stop whose neighbours have few destinations together meets their arrays whole. Where they have
    many, they are bitmaps, and the count is that of all bits less that of the neighbours'. So a
    hub never needs more than ``arrays`` numbers of its neighbours or one bitmap of a part at a time.
    """
    others, hubs = F.col("stop_id").alias("other"), save(means.where(F.col("members") > arrays).select(*STOP), "hubs")
    near = neighbors.join(hubs, STOP, "left_anti").join(sets.select("feed_id", others, F.col("dests").alias("near")), ["feed_id", "other"])
    near = near.repartition(*STOP).groupBy(*STOP).agg(F.flatten(F.collect_list("near")).alias("near"))
    own = sets.join(hubs, STOP, "left_anti").join(near, STOP, "left")
    few = own.select(*STOP, F.size(F.when(F.col("near").isNull(), F.col("dests")).otherwise(F.array_except("dests", "near"))).alias("n"))
    if not hubs.limit(1).count():
        return few.groupBy(*STOP).agg(F.sum("n").alias("exclusive"))
    key, at = [*STOP, "part"], ["feed_id", "other", "part"]
    around = save(neighbors.join(hubs, STOP, "left_semi"), "around")
    used = around.select("feed_id", "other").unionByName(hubs.select("feed_id", others)).distinct()
    members = sets.select("feed_id", others, "dests").join(used, ["feed_id", "other"]).select("feed_id", "other", F.explode("dests").alias("dest"))
    bits = members.groupBy("feed_id", "other", F.expr(f"dest div {PART}").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("dest")).alias("bits"))
    bits = save(bits, "bits")
    mine = bits.join(hubs.select("feed_id", others), ["feed_id", "other"], "left_semi").select("feed_id", F.col("other").alias("stop_id"), "part")
    met = around.join(mine, STOP).join(bits, at).select(*key, F.col("bits").alias("near"), "bits")
    alone = mine.join(bits.withColumnRenamed("other", "stop_id"), key).select(*key, F.lit(None).cast("binary").alias("near"), "bits")
    either = met.unionByName(alone).groupBy(*key).agg(F.bitmap_or_agg("bits").alias("either"), F.bitmap_or_agg("near").alias("near"))
    many = either.select(*STOP, (F.bitmap_count("either") - F.bitmap_count("near")).cast("int").alias("n"))
    return few.unionByName(many).groupBy(*STOP).agg(F.sum("n").alias("exclusive"))


def stop_importance(stop_times: DataFrame, arrays: int = ARRAYS) -> DataFrame:
    """(feed, stop, destinations, neighbors, avg_neighbor, exclusive, importance) of stops with destinations.

    Without neighbours the importance is the number of destinations n; else 0.8 times
    n over the neighbours' mean (n if that is 0), plus 0.2 times the exclusive ones.
    """
    numbers = stop_numbers(stop_times)
    lists = save(distinct_patterns(stop_times.join(numbers, STOP).drop("stop_id").withColumnRenamed("number", "stop_id")), "lists")
    sets, around = save(destination_sets(lists), "sets"), save(neighbors_of_lists(lists), "neighbors")
    means = save(neighbor_means(sets, around), "means")
    n = sets.groupBy(*STOP).agg(F.sum(F.size("dests")).alias("destinations"))
    out = n.join(means, STOP, "left").join(exclusive_counts(sets, around, means, arrays), STOP).na.fill(0, ["neighbors"])
    ratio = F.when(F.col("avg_neighbor") > 0, F.col("destinations") / F.col("avg_neighbor")).otherwise(F.col("destinations").cast("double"))
    score = F.when(F.col("neighbors") == 0, F.col("destinations").cast("double")).otherwise(F.lit(0.8) * ratio + F.lit(0.2) * F.col("exclusive"))
    scored = out.withColumn("avg_neighbor", F.coalesce("avg_neighbor", F.lit(0.0))).withColumn("importance", score)
    named = scored.withColumnRenamed("stop_id", "number").join(numbers, ["feed_id", "number"])
    return named.select(*STOP, "destinations", "neighbors", "avg_neighbor", "exclusive", "importance")


def normalize_0_100(scores: DataFrame, col: str = "importance", out: str = "score") -> DataFrame:
    """Scores of each feed scaled to 0-100; 50 if all are equal."""
    ends = scores.groupBy("feed_id").agg(F.min(col).alias("_low"), F.max(col).alias("_high"))
    wide = F.col("_high") - F.col("_low")
    scaled = F.when(wide > 0, F.lit(100) * (F.col(col) - F.col("_low")) / wide).otherwise(F.lit(50.0))
    return scores.join(ends, "feed_id").withColumn(out, scaled).drop("_low", "_high")


def top_stops(scores: DataFrame, k: int = 20, col: str = "score") -> DataFrame:
    """The ``k`` best stops, ties by feed and stop."""
    return scores.orderBy(F.desc(col), *STOP).limit(k)
