"""Durable tables between steps, and distributed connected components.

Steps that are read more than once are written as Parquet below the folder of
``spark.checkpoint.dir``, so lost executors lose nothing and lineage stays short.
"""

from __future__ import annotations

import contextlib
import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in local tests.
LOCAL_DIR = "/tmp/checkpoints"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of intermediate tables; only a local master, where all tasks share one disk, may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or LOCAL_DIR).rstrip("/") + "/corpus"


def fresh(table: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``table`` has, whatever its case."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove saved tables that no later step reads."""
    delete_folders(spark, *{f.rsplit("/", 1)[0] for table in tables for f in table.inputFiles()})


def delete_folders(spark: SparkSession, *folders: str) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, a row's place (from 0) among those of its key in ascending order, nulls first, and ``n``, their number.

    Rows are sorted in ranges over all keys, counted for each key and range, and the counts of earlier ranges
    added, so a key may have any share of the rows. Rows equal in ``key`` and ``order`` take their places in any one order.
    """
    spark = rows.sparkSession
    tie, by = F.monotonically_increasing_id(), [F.col(key), *map(F.col, order)]
    dealt = rows.withColumn("tie", tie).repartitionByRange(partitions(spark), *by, "tie").sortWithinPartitions(*by, "tie").drop("tie")
    kept = save(dealt.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "ranked")
    counts = kept.groupBy(key, "part").agg(F.count("*").alias("here"), F.min("seq").alias("first"))
    all_parts = Window.partitionBy(key)
    before = F.coalesce(F.sum("here").over(all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(key).alias("of"), F.col("part").alias("in"), (before - F.col("first")).alias("shift"), F.sum("here").over(all_parts).alias("n"))
    joined = kept.join(starts, F.col("part").eqNullSafe(F.col("in")) & F.col(key).eqNullSafe(F.col("of")))
    return joined.withColumn("pos", F.col("seq") + F.col("shift")).drop("part", "seq", "of", "in", "shift")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is its smallest reachable node.

    Alternates the large-star and small-star steps until the edges are stars. Each
    step shrinks long paths, keeps at most the number of edges it was given, and
    needs only a minimum per node, which Spark aggregates before its shuffle.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = save(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        stepped = save(_star(_star(now, large=True), large=False), "edges")
        seen, mark = mark, _mark(stepped)
        delete(spark, now)
        now = stepped
        if mark == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free hash sum, equal for equal sets of edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v after one star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def trim() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def files(uri: str):
    """The file system and path of a folder's URI, for tasks that write a format Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
