"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Equal vectors of a label are one class with a weight. Classes of a label whose signs
agree in a table meet in one bucket, first without their vectors: each has a sketch,
the signs for hyperplanes of its own, and is a candidate in a bucket if another
sketch there differs in few enough signs. Only candidates' vectors are sent to their buckets,
where every cosine is computed in double precision. A pair is counted in the first
table in which it meets, so a vector goes to few tables and links need no list of
pairs: each bucket gives sums for its members and a forest of its links. Buckets
over ``BLOCK`` members are dealt into blocks, and each pair of blocks is a piece of
work of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, delete, partitions, save

COSINE = 0.93
#: Chance that a pair at the threshold meets in some table; closer pairs meet more surely.
RECALL = 0.9999
#: Vectors expected in a bucket of the largest label, and the most in a block.
BUCKET, BLOCK = 128, 1024
#: Signs in a sketch, and the share of pairs at the threshold whose sketches may differ too much; closer pairs do more rarely.
SKETCH, MISSED = 128, 1e-6
SEED = 7


def plan(largest: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a signature and number of tables for a largest label of so many classes."""
    bits = min(24, max(4, math.ceil(math.log2(max(largest, 1) / BUCKET))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sketch_reach(cosine: float = COSINE, missed: float = MISSED) -> int:
    """The fewest signs of a sketch so that more differ in at most a share ``missed`` of pairs at the threshold."""
    p, above = math.acos(cosine) / math.pi, 0.0
    for k in range(SKETCH, -1, -1):
        above += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if above > missed:
            return k
    return 0


def _vectors(kind: str):
    """Rows with a node: the hash of label and vector, null if the vector links with nothing; components are packed as ``kind``."""

    def over(batches):
        for batch in batches:
            nodes, packed = [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ok = label is not None and values and None not in values
                x = np.array(values if ok else [], np.float64) + 0.0  # -0.0 is 0.0
                ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
                nodes.append(xxhash.xxh3_64_intdigest(repr(label).encode() + b"|" + x.tobytes()) - (1 << 63) if ok else None)
                packed.append(x.astype(kind).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], names=["id", "label", "node", "vector"])

    return over


def sign_kind(bits: int) -> str:
    """The smallest unsigned integers that hold a table's signs."""
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"


def _signed(bits: int, tables: int, kind: str):
    """Adds the signs of each table and the sketch."""
    planes: dict[int, np.ndarray] = {}
    of_tables = tables * bits

    def over(batches):
        for batch in batches:
            data = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            signs, sketch = [None] * len(data), [None] * len(data)
            sizes = np.array([len(d) for d in data])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(data[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, x.shape[1]]).normal(size=(of_tables + SKETCH, x.shape[1])).T
                up = (x / np.abs(x).max(1, keepdims=True)) @ planes[size] > 0
                codes = (up[:, :of_tables].reshape(len(at), tables, bits) @ (1 << np.arange(bits))).astype(sign_kind(bits))
                for i, own, other in zip(at, codes, np.packbits(up[:, of_tables:], axis=1), strict=True):
                    signs[i], sketch[i] = own.tobytes(), other.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.binary()), pa.array(sketch, pa.binary())], names=[*batch.schema.names, "signs", "sketch"])

    return over


def _exploded(bits: int):
    """A row for each table: its number, and a hash of label, length, table and sign; of the signs it keeps those of earlier tables."""
    width = np.dtype(sign_kind(bits)).itemsize

    def over(batches):
        for batch in batches:
            key, tab, node, earlier, sketch = [], [], [], [], []
            for label, dim, n, signs, sk in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "node", "signs", "sketch")), strict=True):
                of = f"{label}|{dim}|".encode()
                for t in range(len(signs) // width):
                    key.append(xxhash.xxh3_64_intdigest(of + bytes([t & 255, t >> 8]) + signs[t * width : (t + 1) * width]) - (1 << 63))
                    tab.append(t)
                    node.append(n)
                    earlier.append(signs[: t * width])
                    sketch.append(sk)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(tab, pa.int32()), pa.array(node, pa.int64()), pa.array(earlier, pa.binary()), pa.array(sketch, pa.binary())], names=["key", "tab", "node", "signs", "sketch"])

    return over


def _groups(batches, key: tuple[str, ...], columns: tuple[str, ...]):
    """(key, rows) of groups of two rows or more, which lie together in the stream."""
    now, rows = None, []
    for batch in batches:
        cols = batch.to_pydict()
        for k, row in zip(zip(*(cols[c] for c in key), strict=True), zip(*(cols[c] for c in columns), strict=True), strict=True):
            if k != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = k, []
            rows.append(row)
    if len(rows) > 1:
        yield now, rows


def _first_here(signs: np.ndarray, a: np.ndarray, b: np.ndarray, tab: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that met in no table before ``tab``."""
    for t in range(tab):
        new = signs[a, t] != signs[b, t]
        a, b = a[new], b[new]
    return a, b


PIECE = ("key", "tab", "bi", "bj")


def _candidates(reach: int, bits: int):
    """Of pieces of work without vectors, the members with a partner whose sketch is within reach and which they met in no earlier table."""

    def over(batches):
        out: list[list] = [[] for _ in range(6)]
        for (key, tab, bi, bj), rows in _groups(batches, PIECE, ("node", "signs", "sketch", "block")):
            nodes, block = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
            words = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), -1)
            apart = sum(np.bitwise_count(w[:, None] ^ w[None, :]) for w in words.T.copy())  # at most SKETCH, so a byte holds it
            near = (apart <= reach) & (nodes[:, None] != nodes[None, :])
            if bi != bj:
                near &= block[:, None] != block[None, :]
            a, b = np.nonzero(near)
            if tab and len(a):
                signs = np.frombuffer(b"".join(r[1] for r in rows), sign_kind(bits)).reshape(len(rows), tab)
                a, b = _first_here(signs, a, b, tab)
            for i in np.unique(a).tolist():
                for col, value in zip(out, (rows[i][0], key, tab, bi, bj, rows[i][3]), strict=True):
                    col.append(value)
            if len(out[0]) > 50_000:
                yield _batch(out)
                out = [[] for _ in range(6)]
        if out[0]:
            yield _batch(out)

    def _batch(cols):
        kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["node", *PIECE, "block"])

    return over


KEY = ("label", "dim", *PIECE)


def _linked(cosine: float, bits: int, kind: str):
    """Streams pieces of work that lie together in the partition; out: links and a local root of each node that has links."""

    def links(key, rows):
        _, _, _, tab, bi, bj = key
        nodes, x = np.array([r[0] for r in rows]), np.array([np.frombuffer(r[2], kind) for r in rows], np.float64)
        weight, block = np.array([r[1] for r in rows]), np.array([r[4] for r in rows])
        signs = np.array([np.frombuffer(r[3], sign_kind(bits)) for r in rows])
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        near = x @ x.T >= cosine
        near &= nodes[:, None] != nodes[None, :]
        if bi != bj:
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(near)
        here = signs[a, tab] == signs[b, tab]  # two signs may have one hash
        a, b = _first_here(signs, a[here], b[here], tab)
        if not len(a):
            return None
        total = np.bincount(a, weight[b], len(nodes)).astype(np.int64)
        root = np.arange(len(nodes))
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            low = low[low]
            if (low == root).all():
                break
            root = low
        has = np.flatnonzero(total)
        return nodes[has], total[has], nodes[root[has]]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], names=["node", "links", "root"])

    def over(batches):
        found = []
        for key, rows in _groups(batches, KEY, ("node", "weight", "vector", "signs", "block")):
            if got := links(key, rows):
                found.append(got)
            if sum(len(f[0]) for f in found) > 50_000:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    return over


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row (id, n_links, component_id, kept) for each row.

    Vectors of equal labels and lengths link if their cosine in double precision is
    at least ``cosine``; n_links counts other rows linked directly, equal vectors
    included. Rows with a null label, a null, empty or zero vector, or one with null
    or non-finite components link with nothing: 0 links, a component of their own.
    component_id is the smallest id reachable; null ids count as rows but name no
    component. kept is id = component_id, false for a null id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    packed = "<f4" if single else "<f8"  # as exact as the input
    rows = save(rows.mapInArrow(_vectors(packed), f"id {kind}, label string, node long, vector binary"), "vectors")
    classes = save(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.min("label").alias("label"), F.min("vector").alias("vector")), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, cosine, recall)

    base = classes.select("label", (F.octet_length("vector") / (4 if single else 8)).cast("int").alias("dim"), "node", "weight", "vector")
    signed = save(base.mapInArrow(_signed(bits, tables, packed), "label string, dim int, node long, weight long, vector binary, signs binary, sketch binary"), "signed")
    narrow = signed.drop("vector", "weight").mapInArrow(_exploded(bits), "key long, tab int, node long, signs binary, sketch binary")
    counts = narrow.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    crowded = save(counts.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowded")
    dealt = narrow.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pieces = dealt.select("*", other).select("key", "tab", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "node", "signs", "sketch", "block")
    pieces = pieces.repartition(partitions(spark), *PIECE).sortWithinPartitions(*PIECE)
    candidates = save(pieces.mapInArrow(_candidates(sketch_reach(cosine), bits), "node long, key long, tab int, bi int, bj int, block int"), "candidates")
    work = candidates.join(signed.drop("sketch"), "node").select(*KEY, "node", "weight", "vector", "signs", "block")
    work = work.repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY)
    found = save(work.mapInArrow(_linked(cosine, bits, packed), "node long, links long, root long"), "links")

    joined = connected_components(found.select("node", "root"), "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = classes.select("node", "least", "weight").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = save(roots.join(named, "root").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "components")
    delete(spark, signed, classes, crowded, candidates, found)
    out = rows.drop("label", "vector").join(of_node, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
links AS (SELECT x, count(*) AS n FROM p GROUP BY x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, least.y), vec_id) AS component_id,
       vec_id = coalesce(least(vec_id, least.y), vec_id) AS kept
FROM v LEFT JOIN links ON links.x = vec_id LEFT JOIN least ON least.x = vec_id
"""
