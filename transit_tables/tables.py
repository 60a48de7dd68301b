"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
LOCAL_DIR = "/tmp/checkpoints"


def work_dir(spark: SparkSession) -> str:
    """The folder for tables between steps."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or LOCAL_DIR).rstrip("/") + "/transit"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str, by: str) -> None:
    """Add ``df`` to the table at ``path``, in a folder for each value of ``by``."""
    df.write.mode("append").partitionBy(by).parquet(path)


def files(uri: str):
    """The file system and path of a folder's URI, for formats that Spark has no reader or writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
