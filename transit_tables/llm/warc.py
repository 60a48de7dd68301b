"""WARC archives as a PySpark data source, read by filters on record headers.

Each record is a gzip member of its own, with its compressed size in an extra field
and a flush point after the header. A reader inflates the header only, drops records
that the pushed-down filters exclude, and jumps over payloads that nobody reads.
Plain and gzip archives of other writers are read too, member by member.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import delete, files, new_path, save

SCHEMA = "page_id long, record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to long, headers map<string,string>, payload binary"
#: Payloads from this size on are stored once.
SHARED = 1000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MARK = b"sz"
#: Bytes that are read at a time, at least, and bytes after which a task begins another file; a file is one task's to read.
READ, FILE = 1 << 16, 1 << 28
#: Rows of repeated payloads (about 100 bytes each) up to which they are sent to all tasks.
REPEATED = 100_000


def line(value: str) -> str:
    """A header value on one line: control characters and % as in URIs."""
    return "".join(c if " " <= c != "%" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url, digest: str, length: int, payload: bytes | None, refers_to) -> bytes:
    """A response, or without payload a revisit, as one gzip member."""
    block = HTTP + (payload or b"")
    head = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else line(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", PROFILE if payload is None else None),
        ("X-Payload-Length", str(length)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n"
    raw = text.encode()
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush(zlib.Z_FULL_FLUSH) + z.compress(block + b"\r\n\r\n") + z.flush()
    whole = raw + block + b"\r\n\r\n"
    extra = MARK + (4).to_bytes(2, "little") + (len(body) + 28).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(whole).to_bytes(4, "little") + (len(whole) & 0xFFFFFFFF).to_bytes(4, "little")


def parse(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(digits) if digits.lstrip("-").isdigit() else None


def digest_hex(value: str | None) -> str | None:
    """Lower-case hex of a sha1: digest in base32, or of one that is hex already."""
    value = (value or "").rpartition(":")[2]
    if len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower() or None


class Source:
    """Buffered bytes of a file with jumps."""

    def __init__(self, handle):
        self.handle, self.at, self.data = handle, 0, b""

    def peek(self, n: int) -> bytes:
        while len(self.data) < n and (more := self.handle.read(max(READ, n - len(self.data)))):
            self.data += more
        return self.data[:n]

    def skip(self, n: int) -> None:
        if n > len(self.data):
            self.handle.seek(n - len(self.data), 1)
        self.data = self.data[n:]


def members(handle, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block or None) of each record that ``wanted`` accepts by its headers."""
    source = Source(handle)
    while start := source.peek(28):
        if start[:2] == b"\x1f\x8b":
            sized = start[3] == 4 and start[12:14] == MARK
            if not sized:
                yield from _foreign(source, wanted, payloads)
                continue
            size = int.from_bytes(start[16:20], "little")
            head, n = b"", 1024
            while b"\r\n\r\n" not in head and (n == 1024 or n < 2 * size or len(head) == n):  # the header only
                n *= 2
                head = zlib.decompressobj(-15).decompress(source.peek(min(n, size))[20:], n)
            head = head.partition(b"\r\n\r\n")[0]
            fields = parse(head)
            if wanted(fields):
                block = None
                if payloads:
                    whole = zlib.decompress(source.peek(size)[20:-8], -15)
                    block = whole[len(head) + 4 : len(head) + 4 + int(fields["content-length"])]
                yield fields, block
            source.skip(size)
        elif start[:5] == b"WARC/":
            n = 1024
            while b"\r\n\r\n" not in (head := source.peek(n)) and len(head) == n:
                n *= 2
            head = head.partition(b"\r\n\r\n")[0]
            fields = parse(head)
            size = int(fields.get("content-length", 0))
            source.skip(len(head) + 4)
            if wanted(fields):
                yield fields, source.peek(size) if payloads else None
            source.skip(size)
            while source.peek(1) in (b"\r", b"\n"):
                source.skip(1)
        else:
            raise ValueError("neither a WARC record nor a gzip member")


def _foreign(source: Source, wanted, payloads: bool):
    """A gzip member without its size: inflated to find its end; what nobody wants is dropped as it comes."""
    z, whole, fields, keep = zlib.decompressobj(31), bytearray(), None, True
    while not z.eof and (data := source.peek(READ)):
        part = z.decompress(data)
        source.skip(len(data) - len(z.unused_data))
        if keep:
            whole += part
        if fields is None and b"\r\n\r\n" in whole:
            head, _, rest = bytes(whole).partition(b"\r\n\r\n")
            fields = parse(head)
            accepted = wanted(fields)
            keep, whole = accepted and payloads, bytearray(rest)
    if fields is None:  # a header without its end
        fields, whole = parse(bytes(whole)), bytearray()
        accepted = wanted(fields)
    if accepted:
        yield fields, bytes(whole[: int(fields.get("content-length", len(whole)))]) if payloads else None


class File(InputPartition):
    def __init__(self, name: str):
        self.name = name


#: Columns that filters can be pushed to, and the header of each.
PUSHED = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id"}


def header_test(f) -> tuple | None:
    """(header, kind of test, values) of a filter that a record's header can answer."""
    name = PUSHED.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
    if name is None:
        return None
    if isinstance(f, (EqualTo, In)):
        return name, "in", (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
    if isinstance(f, StringStartsWith):
        return name, "starts", f.value
    return (name, "null", isinstance(f, IsNull)) if isinstance(f, (IsNull, IsNotNull)) else None


def passes(headers: dict[str, str], tests: list[tuple]) -> bool:
    for name, kind, values in tests:
        value = headers.get(name)
        if not (value in values if kind == "in" else (value is None) == values if kind == "null" else value is not None and value.startswith(values)):
            return False
    return True


class Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            if test := header_test(f):
                self.tests.append(test)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = files(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [File(x.path) for x in sorted(found, key=lambda x: -(x.size or 0)) if x.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition):
        if partition is None or not getattr(partition, "name", None):
            return
        system, tests = files(self.folder)[0], self.tests
        with system.open_input_file(partition.name) as handle:
            for h, block in members(handle, lambda h: passes(h, tests), self.payloads):
                kind = h.get("warc-type")
                payload = block.partition(b"\r\n\r\n")[2] if block is not None and "http" in h.get("content-type", "") else block
                length = h.get("x-payload-length")
                yield (
                    _page(h.get("warc-record-id")), h.get("warc-record-id"), kind, h.get("warc-target-uri"), digest_hex(h.get("warc-payload-digest")),
                    int(length) if length else None, _page(h.get("warc-refers-to")), h, None if kind == "revisit" else payload,
                )


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceWriter):
    """Rows (page_id, url, digest, length, payload, refers_to); archives of each task, seen once the job commits."""

    def __init__(self, options):
        self.folder, self.most = options["path"], int(options.get("file_bytes", FILE))

    def write(self, rows):
        system, root = files(self.folder)
        names, out, size = [], None, 0
        for r in rows:
            if out is not None and size >= self.most:
                out.close()
                out = None
            if out is None:
                system.create_dir(root, recursive=True)
                names.append(f"{root}/{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(names[-1] + ".part", compression=None), 0
            data = record(r.page_id, r.url, r.digest, r.length, None if r.payload is None else bytes(r.payload), r.refers_to)
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        system, root = files(self.folder)
        system.create_dir(root, recursive=True)
        for name in (n for m in messages if m is not None for n in m.names):
            system.move(name + ".part", name)

    def abort(self, messages):
        system = files(self.folder)[0]
        for name in (n for m in messages if m is not None for n in m.names):
            system.delete_file(name + ".part")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE) -> None:
    """Writes a record for each row: of equal payloads of ``SHARED`` bytes or more, the one with the largest id holds it, the others refer to it.

    A null html is an empty payload, a null url leaves the header out. Rows with a
    null id hold their payload unless a row with an id has the same. If ids repeat,
    each row with the largest holds the payload. Equal payloads are found by length and
    digest alone; rows with their payloads are dealt by digest only if more than
    ``REPEATED`` payloads repeat.
    """
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("length") >= SHARED).groupBy("digest", "length").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    repeated = save(large.where("n > 1").drop("n"), "repeated")
    few = repeated.limit(REPEATED + 1).count() <= REPEATED
    joined = rows.join(F.broadcast(repeated) if few else repeated, ["digest", "length"], "left").withColumn("refers_to", F.expr("if(keeper is null or keeper <=> page_id, null, keeper)"))
    out = joined.select("page_id", "url", "digest", "length", F.expr("if(refers_to is null, payload, null)").alias("payload"), "refers_to")
    out.write.format("warc").mode("append").option("file_bytes", str(file_bytes)).save(path)
    delete(spark, repeated)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read back: of responses from their payloads, of revisits from headers alone."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    held = read_archives(spark, path).where("record_type = 'response'").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    others = read_archives(spark, path, payload=False).where("record_type = 'revisit'").select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return held.unionByName(others)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS keeper FROM p WHERE octet_length(b) >= 1000 GROUP BY html)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper = page_id THEN NULL ELSE keeper END AS refers_to
FROM p LEFT JOIN m ON m.html = p.html
"""
