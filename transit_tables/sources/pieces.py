"""Documents of any size, one file for each feed, written from sorted pieces.

Pieces are dealt in ranges of feed and key, and each task streams its own to part files. The commit
lists the parts in order. Then one task for each feed copies its parts into the document, with its
head and tail around them, a block at a time. So neither the driver nor a task holds a document, and a task that is run
again leaves only parts that the list doesn't name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..tables import files

#: Bytes copied at once.
COPY = 1 << 20
#: Characters that Spark writes as % and two digits in folder names.
ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\{[]^", "\x7f"}


def feed_folder(feed: str | None) -> str:
    """The folder of a feed, named as Spark names partitions."""
    name = "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in feed) if feed else "__HIVE_DEFAULT_PARTITION__"
    return f"feed_id={name}"


@dataclass
class Written(WriterCommitMessage):
    #: (task, number in the task, feed, file)
    parts: list[tuple[int, int, str | None, str]] = field(default_factory=list)


class PieceWriter(DataSourceArrowWriter):
    """Rows (feed_id, piece) in order of feed; each run of a feed is a part, its pieces joined by commas."""

    def __init__(self, options):
        self.folder, self.listing = options["path"], options["listing"]

    def write(self, batches: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = files(self.folder)
        system.create_dir(root, recursive=True)
        task, out, now, done = TaskContext.get().partitionId(), None, None, Written()
        for batch in batches:
            for feed, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or feed != now:
                    if out is not None:
                        out.close()
                    name, now = f"{root}/{uuid.uuid4().hex}.part", feed
                    out = system.open_output_stream(name, compression=None)
                    done.parts.append((task, len(done.parts), feed, name))
                else:
                    out.write(b",")
                out.write(piece.encode())
        if out is not None:
            out.close()
        return done

    def commit(self, messages) -> None:
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: p[:2])
        system, name = files(self.listing)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(name) as out:
            out.write(json.dumps([p[2:] for p in parts]).encode())

    def abort(self, messages) -> None:
        system = files(self.folder)[0]
        for _, _, _, name in (p for m in messages if m is not None for p in m.parts):
            system.delete_file(name)


class PieceFiles(DataSource):
    @classmethod
    def name(cls):
        return "document_pieces"

    def writer(self, schema, overwrite):
        return PieceWriter(self.options)


def _joined(folder: str, head: str, tail: str):
    def over(batches):
        import pyarrow as pa

        system, root = files(folder)
        for batch in batches:
            for feed, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                home = f"{root}/{feed_folder(feed)}"
                system.create_dir(home, recursive=True)
                made = f"{home}/.{uuid.uuid4().hex}"
                with system.open_output_stream(made, compression=None) as out:
                    out.write(head.encode())
                    for i, part in enumerate(parts):
                        out.write(b"," if i else b"")
                        with system.open_input_stream(part, compression=None) as source:
                            while block := source.read(COPY):
                                out.write(block)
                    out.write(tail.encode() + b"\n")
                    size = out.tell()
                system.move(made, f"{home}/part-00000.txt")
                yield pa.RecordBatch.from_pydict({"feed_id": pa.array([feed], pa.string()), "bytes": pa.array([size], pa.int64())})

    return over


def write_pieces(pieces: DataFrame, path: str, ends: tuple[str, str]) -> list[tuple[str, int]]:
    """Writes rows (feed_id, key, piece) as one document for each feed below ``path``/feed_id=<feed>, and returns feeds with their bytes.

    A document is the head, its pieces in order of key, joined by commas, the tail and a line end. What was
    below ``path`` is replaced at the end. Repeated keys stay, in order of their pieces; null pieces are left out.
    """
    spark: SparkSession = pieces.sparkSession
    spark.dataSource.register(PieceFiles)
    base = path.rstrip("/")
    made, order = f"{base}/_new-{uuid.uuid4().hex}", ["feed_id", "key", "piece"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.where("piece is not null").select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).select("feed_id", "piece")
    listing = f"{made}/_parts.json"
    dealt.write.format("document_pieces").option("listing", listing).mode("append").save(f"{made}/_parts")
    system, root = files(made)
    with system.open_input_stream(f"{root}/_parts.json") as source:
        parts = json.loads(source.read())
    by_feed: dict[str | None, list[str]] = {}
    for feed, name in parts:
        by_feed.setdefault(feed, []).append(name)
    listed = spark.createDataFrame(list(by_feed.items()), "feed_id string, parts array<string>")
    joined = listed.repartition(max(1, len(by_feed))).mapInArrow(_joined(f"{made}/documents", *ends), "feed_id string, bytes long")
    sizes = [(r.feed_id, r.bytes) for r in joined.collect()]  # a row for each feed
    _replace(base, f"{made}/documents", [feed_folder(f) for f, _ in sizes])
    return sorted(sizes, key=str)


def _replace(path: str, made: str, folders: list[str]) -> None:
    """Moves the new documents to their place."""
    from pyarrow import fs

    system, root = files(path)
    for old in system.get_file_info(fs.FileSelector(root)):
        if old.base_name.startswith("feed_id="):
            system.delete_dir(old.path)
    new = files(made)[1]
    for name in folders:
        system.move(f"{new}/{name}", f"{root}/{name}")
    system.delete_dir(new.rsplit("/", 1)[0])
