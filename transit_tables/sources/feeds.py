"""GTFS feeds from folders of text files or from zips, and the feed registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import save
from .zips import listed, read_heads, read_zips

#: Columns of each table and their types; ids are text. The first is mandatory.
TABLES = {
    "routes": {"route_id": "string", "route_long_name": "string"},
    "trips": {"trip_id": "string", "route_id": "string", "direction_id": "int", "shape_id": "string"},
    "stop_times": {"trip_id": "string", "stop_id": "string", "stop_sequence": "int", "arrival_time": "string", "departure_time": "string"},
    "stops": {"stop_id": "string", "stop_name": "string", "stop_lat": "double", "stop_lon": "double"},
    "shapes": {"shape_id": "string", "shape_pt_sequence": "int", "shape_pt_lat": "double", "shape_pt_lon": "double"},
}
MANDATORY = ("routes", "trips", "stop_times", "stops")
#: Tables with names of things, whose quoted values may go over lines; the others hold ids, numbers and times.
FREE_TEXT = ("routes", "stops")


def _absent(table: str, names: list[str]) -> list[str]:
    return [c for c in TABLES[table] if c not in names]


def _typed(rows: DataFrame, table: str, absent) -> DataFrame:
    """The known columns by type; empty values are null. ``absent`` names the columns that a row's feed lacks."""
    cols = [F.nullif(F.col(c), F.lit("")).try_cast(t).alias(c) for c, t in TABLES[table].items()]
    return rows.select("feed_id", *cols, "ord", absent.alias("absent"))


def _heads(spark: SparkSession, path: str, name: str, zipped: bool) -> list[tuple[str, str, list[str]]]:
    """(file, feed, column names) of a table in all folders or zips: a row for each feed."""
    found = read_heads(spark, path, name).where("columns is not null").collect()
    return sorted((r.file, r.feed_id, r.columns) for r in found if r.file.endswith(".zip") == zipped)


def _folder_rows(spark: SparkSession, path: str, name: str, multi_line: bool) -> list[DataFrame]:
    """Typed rows of all folders: files of one header are read together, and only the known columns of them."""
    alike: dict[tuple, list[str]] = {}
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    for file, _, names in _heads(spark, path, name, zipped=False):
        alike.setdefault(tuple(names), []).append(scheme + file)
    out = []
    for names, found in alike.items():
        kind = ", ".join(f"c{i} string" for i in range(len(names)))
        rows = spark.read.schema(kind).options(header=True, enforceSchema=True, multiLine=multi_line, escape='"', mode="PERMISSIVE").csv(found)
        feed = F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -2), F.lit("+"), F.lit("%2B"))).alias("feed_id")
        at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord")
        known = [(F.col(f"c{names.index(c)}") if c in names else F.lit(None).cast("string")).alias(c) for c in TABLES[name]]
        absent = F.array(*(F.lit(c) for c in _absent(name, list(names)))).cast("array<string>")
        out.append(_typed(rows.select(feed, *known, at), name, absent))
    return out


def _zipped(rows: DataFrame, name: str) -> DataFrame:
    at = F.struct(F.lit(0).cast("long").alias("block"), "row").alias("ord")
    return _typed(rows.where("error is null").select("feed_id", *TABLES[name], at, "absent"), name, F.col("absent"))


def read_gtfs_table(spark: SparkSession, path: str, name: str, multi_line: bool | None = None) -> DataFrame:
    """Rows of ``path``/<feed>/``name``.txt and of ``name``.txt in ``path``/<feed>.zip of all feeds, read as text and cast; values that don't fit are null.

    ``ord`` keeps each file's order. Feeds may have different columns, any number of
    them and in any order: columns are taken by name, file by file, the first of those
    with one name. ``absent`` lists the known columns that a row's feed lacks, as
    directions fall back by that, not by null values. Quoted values may hold commas and, in zips and with ``multi_line``,
    line ends; by default that is so in ``FREE_TEXT``. A file read so is one task; others are split, and
    ``broken_lines`` finds those of them that would need it.
    """
    lines = name in FREE_TEXT if multi_line is None else multi_line
    parts = _folder_rows(spark, path, name, lines)
    if listed(path, ".zip"):
        parts.append(_zipped(read_zips(spark, path, name, list(TABLES[name])), name))
    if not parts:
        kind = "feed_id string, " + ", ".join(f"{c} {t}" for c, t in TABLES[name].items())
        return spark.createDataFrame([], kind + ", ord struct<block: bigint, row: bigint>, absent array<string>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def broken_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(feed, lines): how many lines of a table in folders leave a quote open; such a table needs ``multi_line``."""
    lines = spark.read.option("pathGlobFilter", f"{name}.txt").option("recursiveFileLookup", True).text(path)
    feed = F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -2), F.lit("+"), F.lit("%2B"))).alias("feed_id")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.where(quotes % 2 == 1).select(feed).groupBy("feed_id").agg(F.count("*").alias("lines"))


def present_columns(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(feed, columns): the header of each feed's table."""
    return read_heads(spark, path, name).where("columns is not null").select("feed_id", "columns")


def load_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All five tables by name, of folders and zips; shapes may have no rows."""
    return {name: read_gtfs_table(spark, path, name) for name in TABLES}


def unzip_feeds(spark: SparkSession, zips: str, out: str) -> DataFrame:
    """Writes the tables of every <feed>.zip as Parquet below ``out``/<table>, typed and with ``ord``, and returns (feed, table, lines): lines from the header to the last row.

    Each member is read once. A damaged zip is reported with null table and lines and stops no other.
    """
    reports = []
    for t in TABLES:
        raw = save(read_zips(spark, zips, t, list(TABLES[t])), "unzipped")
        _zipped(raw, t).write.mode("overwrite").parquet(f"{out}/{t}")
        last = raw.groupBy("feed_id").agg(F.max("row").alias("last"), F.bool_or(F.col("error").isNotNull()).alias("broken"))
        there = read_heads(spark, zips, t).where("columns is not null").select("feed_id").distinct().withColumn("there", F.lit(True))
        both = last.join(there, "feed_id", "full")
        reports.append(both.where("there").select("feed_id", F.lit(t).alias("name"), (F.coalesce("last", F.lit(0)) + 1).alias("lines")))
        reports.append(both.where("broken").select("feed_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("lines")))
    return reduce(DataFrame.unionByName, reports).distinct()


#: code, name, west, south, east, north, live arrivals, live vehicles; the first is the default. Our own example registry.
FEEDS = (("default", "Default feed", -180.0, -90.0, 180.0, 90.0, False, False),)


def feeds(spark: SparkSession, known=FEEDS) -> DataFrame:
    return spark.createDataFrame(list(known), "feed_id string, name string, west double, south double, east double, north double, live_arrivals boolean, live_vehicles boolean")


def with_feed(rows: DataFrame, registry: DataFrame, default: str = "default") -> DataFrame:
    """Rows with a feed of the registry; unknown and null codes become the default."""
    known = registry.select(F.col("feed_id").alias("known"))
    return rows.join(known, F.col("feed_id") == F.col("known"), "left").withColumn("feed_id", F.coalesce("known", F.lit(default))).drop("known")
