"""Results of a run over many feeds; a bad feed is put aside and stops no other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feed_status(tables: dict[str, DataFrame], feeds: DataFrame) -> DataFrame:
    """(feed, status, missing): error if a mandatory table has no rows, partial without shapes, else success."""
    out = feeds.select("feed_id").distinct()
    names = ("routes", "trips", "stop_times", "stops", "shapes")
    for n in names:
        out = out.join(tables[n].groupBy("feed_id").agg(F.count("*").alias(n)), "feed_id", "left")
    lacks = F.array_compact(F.array(*(F.when(F.coalesce(F.col(n), F.lit(0)) == 0, F.lit(n)) for n in names)))
    return out.withColumn("missing", lacks).select("feed_id", F.when(F.size(F.array_except("missing", F.array(F.lit("shapes")))) > 0, "error").when(F.size("missing") > 0, "partial").otherwise("success").alias("status"), F.array_join("missing", ",").alias("missing"))


def run_report(status: DataFrame) -> DataFrame:
    """One row (success, partial, error, exit_code): 1 if a feed failed, 2 if one is partial, else 0."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = status.agg(n("success"), n("partial"), n("error"))
    return counts.withColumn("exit_code", F.when(F.col("error") > 0, 1).when(F.col("partial") > 0, 2).otherwise(0))


def without_bad_feeds(table: DataFrame, status: DataFrame) -> DataFrame:
    return table.join(status.where("status <> 'error'"), "feed_id", "left_semi")
