"""Readers and writers of the JSON artefacts; keys are data, so schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEDULE = "services array<struct<no:string,origin:string,destination:string,trips:array<string>,trip_count:int>>, _corrupt_record string"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(feed, value): each JSON file whole; the feed is its folder."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return spark.read.option("wholetext", True).text(path).select(F.regexp_replace(folder, "^feed_id=", "").alias("feed_id"), "value")


def _entries(docs: DataFrame, kind: str) -> DataFrame:
    return docs.select("feed_id", F.explode(F.from_json("value", f"map<string,{kind}>")).alias("key", "val"))


def read_schedule_docs(spark: SparkSession, path: str) -> DataFrame:
    """(feed, stop, no, origin, destination, trips, trip_count); the stop is the file's name. Files that are no JSON are left out."""
    docs = spark.read.schema(SCHEDULE).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    named = docs.where("_corrupt_record is null").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("feed_id"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("stop_id"), F.explode("services").alias("s"))
    return named.select("feed_id", "stop_id", "s.*")


def read_stops(spark: SparkSession, path: str) -> DataFrame:
    e = _entries(_documents(spark, path), "array<string>")
    return e.select("feed_id", F.col("key").alias("stop_id"), F.get("val", F.lit(0)).try_cast("double").alias("lon"), F.get("val", F.lit(1)).try_cast("double").alias("lat"), F.get("val", F.lit(2)).alias("name"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    e = _entries(_documents(spark, path), "array<string>")
    return e.select("feed_id", F.col("key").alias("route_id"), F.posexplode("val").alias("shape_idx", "polyline"))


def read_services(spark: SparkSession, path: str) -> DataFrame:
    """(feed, route, name, destination, dest_rank, variant_idx, stops): every key but "name" is a destination, in the file's order."""
    e = _entries(_documents(spark, path), "map<string,string>")
    dest = e.select("feed_id", F.col("key").alias("route_id"), F.try_element_at("val", F.lit("name")).alias("name"), F.posexplode(F.filter(F.map_entries("val"), lambda x: x["key"] != "name")).alias("rank0", "d"))
    lists = F.from_json("d.value", "array<array<string>>")
    return dest.select("feed_id", "route_id", "name", F.col("d.key").alias("destination"), (F.col("rank0") + 1).alias("dest_rank"), F.posexplode(lists).alias("variant_idx", "stops"))


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    e = _entries(_documents(spark, path), "double")
    return e.select("feed_id", F.col("key").alias("stop_id"), F.col("val").alias("score"))


def read_firstlast(spark: SparkSession, path: str) -> DataFrame:
    e = _entries(_documents(spark, path), "array<string>")
    return e.select("feed_id", F.col("key").alias("stop_id"), F.explode("val").alias("entry"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feed, type, properties, coordinates): features with any properties; coordinates as JSON text."""
    docs = _documents(spark, path).select("feed_id", F.from_json("value", "features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").alias("d"))
    return docs.select("feed_id", F.explode("d.features").alias("f")).select("feed_id", F.col("f.geometry.type").alias("type"), "f.properties", "f.geometry.coordinates")


#: Heads and tails of documents.
OBJECT, LIST, FEATURES = ("{", "}"), ("[", "]"), ('{"type":"FeatureCollection","features":[', "]}")


def _quoted(text):
    """A text as a JSON string."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _entries_of(rows: DataFrame, key: str, value) -> DataFrame:
    """(feed, key, piece): an entry of a JSON object for each row."""
    return rows.select("feed_id", F.col(key).alias("key"), F.concat(_quoted(F.col(key)), F.lit(":"), value).alias("piece"))


def whole(pieces: DataFrame, ends: tuple[str, str] = OBJECT) -> DataFrame:
    """(feed, value): documents as values, for those that fit into a row; ``write_pieces`` writes any."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("key", "piece"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["piece"]), ",")
    return pieces.groupBy("feed_id").agg(F.concat(F.lit(ends[0]), joined, F.lit(ends[1])).alias("value"))


def stops_pieces(stops: DataFrame) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return _entries_of(stops, "stop_id", F.concat(F.lit("["), number("lon"), F.lit(","), number("lat"), F.lit(","), _quoted(F.col("name")), F.lit(',""]')))


def stops_document(stops: DataFrame) -> DataFrame:
    return whole(stops_pieces(stops))


def _texts(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(feed, key, v): a JSON list of a key's texts in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy("feed_id", key).agg(F.to_json(F.transform(listed, lambda x: x[text])).alias("v"))


def routes_pieces(lines: DataFrame) -> DataFrame:
    return _entries_of(_texts(lines, "route_id", "shape_id", "polyline"), "route_id", F.col("v"))


def routes_document(lines: DataFrame) -> DataFrame:
    return whole(routes_pieces(lines))


def services_pieces(patterns: DataFrame, routes: DataFrame) -> DataFrame:
    """Each service: its name, then destinations by rank, each with its variants in order."""
    variants = F.transform(F.array_sort(F.collect_list(F.struct("variant_idx", "stops"))), lambda x: x["stops"])
    dest = patterns.groupBy("feed_id", "route_id", "destination", "dest_rank").agg(F.to_json(variants).alias("v"))
    dest = dest.withColumn("pair", F.concat(_quoted(F.col("destination")), F.lit(":"), "v"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("dest_rank", "pair"))), lambda x: x["pair"])
    per = dest.groupBy("feed_id", "route_id").agg(F.array_join(pairs, ",").alias("d"))
    named = per.join(routes.select("feed_id", "route_id", "route_long_name"), ["feed_id", "route_id"], "left")
    name = _quoted(F.coalesce("route_long_name", F.lit("")))
    return _entries_of(named, "route_id", F.concat(F.lit('{"name":'), name, F.lit(","), "d", F.lit("}")))


def services_document(patterns: DataFrame, routes: DataFrame) -> DataFrame:
    return whole(services_pieces(patterns, routes))


def firstlast_pieces(entries: DataFrame) -> DataFrame:
    return _entries_of(_texts(entries, "stop_id", "no", "entry"), "stop_id", F.col("v"))


def firstlast_document(entries: DataFrame) -> DataFrame:
    return whole(firstlast_pieces(entries))


def ranking_rows(scores: DataFrame) -> DataFrame:
    """(feed, stop, score) with scores of two decimals, best first."""
    return scores.select("feed_id", "stop_id", F.round("score", 2).alias("score")).orderBy("feed_id", F.desc("score"), "stop_id")


def route_levels_pieces(paths: DataFrame) -> DataFrame:
    """{level, number, path} by route and shape; a path is a list of [lon, lat, height]."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("pt_seq", "lon", "lat", "z"))), lambda x: F.array(x["lon"], x["lat"], x["z"]))
    each = paths.groupBy("feed_id", "route_id", "shape_id", "level").agg(points.alias("path"))
    return each.select("feed_id", F.struct("route_id", "shape_id").alias("key"), F.to_json(F.struct("level", F.col("route_id").alias("number"), "path")).alias("piece"))


def route_levels_document(paths: DataFrame) -> DataFrame:
    """(feed, value): the list of ``route_levels_pieces``."""
    return whole(route_levels_pieces(paths), LIST)


def stop_levels_pieces(levels: DataFrame) -> DataFrame:
    return _entries_of(levels, "stop_id", F.col("level").cast("string"))


def stop_levels_document(levels: DataFrame) -> DataFrame:
    """(feed, value): the level of each stop by its id."""
    return whole(stop_levels_pieces(levels))


def stop_markers_pieces(markers: DataFrame, levels: DataFrame, names: DataFrame) -> DataFrame:
    """{number, name, level, contour} by stop."""
    rows = markers.join(levels, ["feed_id", "stop_id"], "left").join(names.select("feed_id", "stop_id", "name"), ["feed_id", "stop_id"], "left")
    one = F.struct(F.col("stop_id").alias("number"), "name", "level", F.array("ring").alias("contour"))
    return rows.select("feed_id", F.col("stop_id").alias("key"), F.to_json(one).alias("piece"))


def stop_markers_document(markers: DataFrame, levels: DataFrame, names: DataFrame) -> DataFrame:
    """(feed, value): the list of ``stop_markers_pieces``."""
    return whole(stop_markers_pieces(markers, levels, names), LIST)


def write_documents(docs: DataFrame, path: str) -> None:
    """One text file below ``path``/feed_id=<feed> for each document."""
    docs.write.mode("overwrite").partitionBy("feed_id").text(path)


def write_schedules(schedule: DataFrame, path: str) -> None:
    """One JSON document of services for each stop, below feed and stop, in schedule order."""
    number = F.coalesce(F.when(F.col("no").rlike(r"^\d+$"), F.col("no").try_cast("double")), F.lit(float("inf")))
    services = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("k"), "no", "direction", "origin", "destination", "trips", "trip_count"))), lambda x: F.struct(x["no"].alias("no"), x["origin"].alias("origin"), x["destination"].alias("destination"), x["trips"].alias("trips"), x["trip_count"].alias("trip_count")))
    schedule.groupBy("feed_id", "stop_id").agg(services.alias("services")).write.mode("overwrite").partitionBy("feed_id", "stop_id").json(path)


def feature_pieces(features: DataFrame, kind: str = "Point") -> DataFrame:
    """GeoJSON features by id of rows (feed, id, properties map, coordinates array)."""
    one = F.struct(F.lit("Feature").alias("type"), "id", F.col("properties"), F.struct(F.lit(kind).alias("type"), F.col("coordinates")).alias("geometry"))
    return features.select("feed_id", F.col("id").alias("key"), F.to_json(one).alias("piece"))


def to_feature_collection(features: DataFrame, kind: str = "Point") -> DataFrame:
    """(feed, value): a FeatureCollection of ``feature_pieces``."""
    return whole(feature_pieces(features, kind), FEATURES)


def services_record(services: DataFrame) -> DataFrame:
    """(feed, stop, value): {"services": [...]} with the slots of each service, in order of number."""
    one = F.struct("no", "destination", "frequency", "next", "next2", "next3")
    return services.groupBy("feed_id", "stop_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("services"))).alias("value"))
