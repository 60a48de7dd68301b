"""Zipped feeds as a Spark data source: a partition for each zip, of which only the asked-for table's bytes are read.

A zip is opened by its central directory at the end and the member by its place there, both by
range reads, so a zip may be larger than memory and other members cost nothing. A member is one
deflated stream and so one task, which unpacks it row by row and passes on only the wanted columns. Files are
opened through Arrow's file systems, so executors must reach the folder's URI that way.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..tables import files

DAMAGED = (zipfile.BadZipFile, zlib.error, csv.Error, EOFError, NotImplementedError, RuntimeError, ValueError)
#: Rows of a batch, and files whose first rows one task reads.
ROWS, HEADS = 10_000, 64


def column_names(head: list[str]) -> list[str]:
    """Names of a header row without marks of byte order and spaces around them."""
    return [c.replace("﻿", "").strip() for c in head]


def listed(path: str, ending: str) -> list[str]:
    """Files below a folder, largest first; hidden ones are left out."""
    from pyarrow import fs

    system, root = files(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    kept = [x for x in found if x.is_file and x.path.endswith(ending) and not x.base_name.startswith(("_", "."))]
    return [x.path for x in sorted(kept, key=lambda x: (-(x.size or 0), x.path))]


def feed_of(file: str) -> str:
    """A zip's feed is its name, a text file's that of its folder."""
    parts = file.rsplit("/", 2)
    return unquote(parts[-1].removesuffix(".zip")) if file.endswith(".zip") else unquote(parts[-2])


def csv_rows(stream) -> Iterator[list[str]]:
    """Rows of a CSV file from its header on; blank lines are empty lists."""
    csv.field_size_limit(1 << 30)
    with io.TextIOWrapper(stream, "utf-8-sig", errors="replace", newline="") as text:
        full = (f if any(x.strip() for x in f) else [] for f in csv.reader(text))
        yield from itertools.dropwhile(lambda f: not f, full)


def member_rows(handle, table: str) -> Iterator[list[str]]:
    """Rows of a table's member in an open zip; none if the zip has no such member."""
    with zipfile.ZipFile(handle) as z:
        inside = {n.rsplit("/", 1)[-1]: n for n in z.namelist() if not n.startswith("__MACOSX/")}
        if f"{table}.txt" in inside:
            yield from csv_rows(z.open(inside[f"{table}.txt"]))


@dataclass
class Files(InputPartition):
    names: tuple[str, ...] = ()


class Reader(DataSourceReader):
    """Rows (feed_id, row, absent, error, wanted columns as text), or of headers alone (feed_id, file, columns, error)."""

    def __init__(self, options):
        self.path, self.table, self.heads = options["path"], options["table"], options.get("heads", "false") == "true"
        self.columns = json.loads(options.get("columns", "[]"))

    def partitions(self):
        zips = listed(self.path, ".zip")
        if not self.heads:
            return [Files((x,)) for x in zips] or [Files()]
        both = zips + listed(self.path, f"/{self.table}.txt")
        return [Files(tuple(both[i : i + HEADS])) for i in range(0, len(both), HEADS)] or [Files()]

    def read(self, partition):
        system = files(self.path)[0]
        for name in getattr(partition, "names", ()):
            with system.open_input_file(name) as handle:
                yield from self._heads(name, handle) if self.heads else self._rows(feed_of(name), handle)

    def _heads(self, name: str, handle):
        try:
            for head in itertools.islice(member_rows(handle, self.table) if name.endswith(".zip") else csv_rows(handle), 1):
                yield feed_of(name), name, column_names(head), None
        except DAMAGED as e:
            yield feed_of(name), name, None, str(e)

    def _rows(self, feed: str, handle):
        import pyarrow as pa

        kinds = pa.schema([("feed_id", pa.string()), ("row", pa.int64()), ("absent", pa.list_(pa.string())), ("error", pa.string()), *((c, pa.string()) for c in self.columns)])

        def pack(numbers, values, error=None):
            n = len(numbers)
            given = [[feed] * n, numbers, [absent] * n, [error] * n, *values]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(given, kinds.types, strict=True)], schema=kinds)

        absent: list[str] = []
        numbers, values = [], [[] for _ in self.columns]
        try:
            rows = member_rows(handle, self.table)
            names = column_names(next(rows, []))
            absent = [c for c in self.columns if c not in names]
            places = [names.index(c) if c in names else -1 for c in self.columns]
            for row, fields in enumerate(rows, 1):
                if not fields:
                    continue
                numbers.append(row)
                for at, column in zip(places, values, strict=True):
                    column.append(fields[at] if 0 <= at < len(fields) else None)
                if len(numbers) == ROWS:
                    yield pack(numbers, values)
                    numbers, values = [], [[] for _ in self.columns]
            if numbers:
                yield pack(numbers, values)
        except DAMAGED as e:
            if numbers:
                yield pack(numbers, values)
            yield pack([None], [[None] for _ in self.columns], str(e) or type(e).__name__)


class GtfsZips(DataSource):
    """Options: path, table, columns (a JSON list of names), heads."""

    @classmethod
    def name(cls):
        return "gtfs_zips"

    def schema(self):
        if self.options.get("heads", "false") == "true":
            return "feed_id string, file string, columns array<string>, error string"
        columns = "".join(f", {c} string" for c in json.loads(self.options.get("columns", "[]")))
        return "feed_id string, row bigint, absent array<string>, error string" + columns

    def reader(self, schema):
        return Reader(self.options)


def read_zips(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """(feed_id, row, absent, error, columns as text) of a table in every <feed>.zip; rows count from 1.

    ``absent`` lists the columns that the feed lacks. A zip that can't be opened or read to its end has a last row
    with ``error`` and without ``row``, and stops no other. Blank lines are counted but left out.
    """
    spark.dataSource.register(GtfsZips)
    return spark.read.format("gtfs_zips").option("table", table).option("columns", json.dumps(columns)).load(path)


def read_heads(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(feed_id, file, columns, error): the first row of a table in every feed, zipped or not, and of damaged zips the error."""
    spark.dataSource.register(GtfsZips)
    return spark.read.format("gtfs_zips").option("table", table).option("heads", "true").load(path)
