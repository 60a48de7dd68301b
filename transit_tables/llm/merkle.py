"""A Merkle manifest by time-forward processing.

A forest's leaves have places 0 to n - 1 in their tree; every 8 nodes in a row become one
of the next level. A node's label is (the last place below it, its level), so labels
ascend from children to parents. The sweep up reads leaves in order of label; a priority queue
ordered by label brings each digest to the parent's turn. Then the reversed sweep reads
leaves and nodes in descending order, and the queue brings each node the part of the proof that lies
above it, from which it makes that of its children.

The queue's outer part is Spark's sort: a sweep climbs ``HEIGHT`` levels, and what it sends further
is sorted again by label for the next sweep over ``8 ** HEIGHT`` times fewer rows. Inside a task it is a heap
that holds at most 8 digests a level, as a sweep finishes one subtree before the next.

One tree for each language has its documents as leaves, ascending by id (nulls first, ties by
the leaf's digest). A last tree has the languages' roots as leaves, nulls first and then bytewise. Texts may be of any length: only digests
are sorted. Rows without a language are one tree; a null id is never tampered with; an empty
table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ranked, save

FAN, HEIGHT = 8, 3
SPAN = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def levels(n: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def last_below(at: int, level: int, n: int) -> int:
    """The last place below node ``at`` of a level."""
    return min(n, (at + 1) * FAN**level) - 1


class Queue:
    """Messages to nodes, by label; descending if ``sign`` is -1."""

    def __init__(self, sign: int = 1):
        self.heap, self.sign, self.sent = [], sign, 0

    def send(self, last: int, level: int, what) -> None:
        self.sent += 1  # messages to one node keep their order
        heapq.heappush(self.heap, (self.sign * last, self.sign * level, self.sent, what))

    def next_label(self) -> tuple[int, int] | None:
        return (self.sign * self.heap[0][0], self.sign * self.heap[0][1]) if self.heap else None

    def receive(self, last: int, level: int) -> list:
        out = []
        while self.next_label() == (last, level):
            out.append(heapq.heappop(self.heap)[3])
        return out


def _up(batches):
    """Nodes above leaves that come in order of tree and place, up to ``HEIGHT`` levels."""
    queue = Queue()
    for batch in batches:
        made = []
        for tree, pos, n, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            top = min(HEIGHT, levels(n))
            if top:
                queue.send(last_below(pos // FAN, 1, n), 1, digest)
            while (label := queue.next_label()) and label[0] == pos:
                level, children = label[1], "".join(queue.receive(*label))
                digest, at = sha256(children.encode()).hexdigest(), pos // FAN**level
                made.append((tree, level, at, n, digest, children))
                if level < top:
                    queue.send(last_below(at // FAN, level + 1, n), level + 1, digest)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["tree", "level", "at", "n", "digest", "children"])


def _down(batches):
    """Proofs of leaves; rows come in descending order of label, a message to a node before the node."""
    queue = Queue(-1)
    for batch in batches:
        kept, lefts, rights, offsets, seen = [], [], [], [0], []
        for i, (last, level, at, n, digest, proof, roots) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:8]), strict=True)):
            if proof is not None:
                above = None
                for x in reversed(proof):
                    above = (x["left"], x["right"], above)
                queue.send(last, level, (above, roots))
                continue
            ((above, roots),) = queue.receive(last, level)
            if level:
                width = len(digest) // 64
                for k in range(width):
                    child = at * FAN + k
                    queue.send(last_below(child, level - 1, n), level - 1, ((digest[: 64 * k], digest[64 * k + 64 :], above), roots))
            else:
                kept.append(i)
                seen.append(roots)
                while above:
                    lefts.append(above[0])
                    rights.append(above[1])
                    above = above[2]
                offsets.append(len(lefts))
        if kept:
            steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], names=["left", "right"])
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(3), rows.column(5), rows.column(8), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps), pa.array(seen, pa.list_(pa.string()))], names=["tree", "pos", "leaf", "carried", "proof", "roots"])


class Forest:
    """Trees over rows (tree, pos, n, digest, carried)."""

    def __init__(self, leaves: DataFrame):
        self.leaves = leaves
        n = partitions(leaves.sparkSession)
        most = leaves.agg(F.max("n")).first()[0] or 0
        rows, self.rounds = leaves, []
        done = leaves.where("n = 1").select("tree", "digest")
        while most > 1:
            dealt = rows.select("tree", "pos", "n", "digest").repartition(n, "tree", F.expr(f"pos div {SPAN}")).sortWithinPartitions("tree", "pos")
            nodes = save(dealt.mapInArrow(_up, "tree string, level int, at long, n long, digest string, children string"), "nodes")
            self.rounds.append((rows, nodes))
            done = done.unionByName(nodes.where(f"n <= {SPAN} and n > pow({FAN}, level - 1) and n <= pow({FAN}, level)").select("tree", "digest"))
            rows = nodes.where(f"level = {HEIGHT} and n > {SPAN}").select("tree", F.col("at").alias("pos"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), "digest", F.lit(None).cast(leaves.schema["carried"].dataType).alias("carried"))
            most = -(-most // SPAN) if most > SPAN else 0
        if not self.rounds:
            self.rounds.append((leaves, None))
        #: (tree, digest) of each tree.
        self.roots = done

    def proofs(self, above: DataFrame) -> DataFrame:
        """(tree, pos, leaf, carried, proof, roots) of each leaf, from (tree, proof, roots) of each tree's root: what lies above it."""
        sent = None
        for rows, nodes in reversed(self.rounds):
            n = partitions(rows.sparkSession)
            cut = F.expr("aggregate(sequence(1, 3), 0, (k, i) -> if(n > pow(8, i - 1), i, k))")  # levels below a small tree's root
            small = rows.where(f"pos = 0 and n <= {SPAN}").select("tree", "n", cut.alias("level")).alias("r").join(above.alias("a"), F.expr("r.tree <=> a.tree")).select("r.tree", (F.col("r.n") - 1).alias("last"), "r.level", F.lit(0).cast("long").alias("at"), "a.proof", "a.roots")
            messages = small if sent is None else small.unionByName(sent)
            kind = rows.schema["carried"].dataType
            none = {c: F.lit(None).cast(t).alias(c) for c, t in (("at", "long"), ("n", "long"), ("digest", "string"), ("proof", PROOF), ("roots", "array<string>"), ("carried", kind))}
            named = ["tree", "last", "level", "at", "n", "digest", "proof", "roots", "carried"]
            stream = messages.select("tree", "last", "level", "at", none["n"], none["digest"], "proof", "roots", none["carried"])
            stream = stream.unionByName(rows.select("tree", F.col("pos").alias("last"), F.lit(0).alias("level"), F.col("pos").alias("at"), "n", "digest", none["proof"], none["roots"], "carried"))
            if nodes is not None:
                last = F.least("n", (F.col("at") + 1) * F.pow(F.lit(FAN), "level").cast("long")) - 1
                stream = stream.unionByName(nodes.select("tree", last.alias("last"), "level", "at", "n", F.col("children").alias("digest"), none["proof"], none["roots"], none["carried"]))
            dealt = stream.select(*named).repartition(n, "tree", F.expr(f"last div {SPAN}")).sortWithinPartitions("tree", F.desc("last"), F.desc("level"), F.col("proof").isNull())
            found = dealt.mapInArrow(_down, f"tree string, pos long, leaf string, carried {kind.simpleString()}, proof {PROOF}, roots array<string>")
            if rows is self.leaves:
                return found
            # A leaf of this sweep is a node at the top of one below it.
            size = self.sizes(rows)
            sent = save(found, "proofs").alias("f").join(size.alias("s"), F.expr("f.tree <=> s.tree")).select("f.tree", (F.least(F.col("s.n"), (F.col("f.pos") + 1) * SPAN) - 1).alias("last"), F.lit(HEIGHT).alias("level"), F.col("f.pos").alias("at"), "f.proof", "f.roots")
        raise AssertionError("the leaves' sweep comes last")

    def sizes(self, rows: DataFrame) -> DataFrame:
        """(tree, n) of the sweep below that of ``rows``."""
        below = self.rounds[[r is rows for r, _ in self.rounds].index(True) - 1][0]
        return below.where("pos = 0").select("tree", "n")


def leaf_digest(text=None):
    """SHA-256 of the five fields: ``-`` for null, else the value after its number of bytes and a colon."""
    values = [(text if text is not None and c == "text" else F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def lower_ascii(text: str):
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.col(text).cast("string"), upper, upper.lower())


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, tampered, leaf, proof, subroot, root) for each row.

    ``proof`` has a step for each level from the leaf to the root: the digests left and right of
    the path in its run, joined. ``tampered`` is the leaf's digest with the text's A-Z lower-cased
    where 3 divides crc32 of the id, else the leaf itself.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").alias("id"), leaf_digest().alias("digest"), F.when(chosen, leaf_digest(lower_ascii("text"))).alias("tampered"))
    placed = save(ranked(rows, "tree", ["id", "digest"]).select("tree", "pos", "n", "digest", F.struct("id", "tampered").alias("carried")), "leaves")
    languages = Forest(placed)
    tops = save(languages.roots.select(F.lit("").alias("top"), F.col("tree").alias("language"), "digest"), "subroots")
    last = Forest(save(ranked(tops, "top", ["language"]).select(F.col("top").alias("tree"), "pos", "n", "digest", F.struct("language").alias("carried")), "top"))
    start = last.roots.select("tree", F.expr(f"cast(array() as {PROOF})").alias("proof"), F.array("digest").alias("roots"))
    above = save(last.proofs(start).select(F.col("carried.language").alias("tree"), "proof", F.concat(F.array("leaf"), F.col("roots")).alias("roots")), "above")
    found = languages.proofs(above)
    return found.select(F.col("carried.id").alias("doc_id"), F.coalesce("carried.tampered", "leaf").alias("tampered"), "leaf", "proof", F.col("roots")[0].alias("subroot"), F.col("roots")[1].alias("root"))


def folded(leaf: str, proof: str):
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, F.col(leaf), lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def manifest_report(docs: DataFrame) -> DataFrame:
    found = manifest(docs).withColumn("folded_root", folded("tampered", "proof"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = r"""
WITH RECURSIVE
bits AS (SELECT [list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t),
rows_ AS (
  SELECT row_number() OVER () AS r, d.*,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) % 3 = 0 AS chosen,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents d, bits),
digested AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN chosen THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM rows_),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM digested),
nodes AS (
  SELECT 0 AS level, lang, pos AS idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, lang, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, lang, idx // 8, n),
tops AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
above AS (
  SELECT 0 AS level, pos AS idx, n, digest FROM tops
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM above WHERE n > 1 GROUP BY level, idx // 8, n),
-- The siblings before and after the path of each leaf, level by level.
steps AS (
  SELECT l.r, s.level, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < l.pos // CAST(8 ** s.level AS BIGINT)), '') AS lft, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > l.pos // CAST(8 ** s.level AS BIGINT)), '') AS rgt
  FROM leaves l JOIN nodes s ON l.lang IS NOT DISTINCT FROM s.lang AND s.n > 1 AND s.idx // 8 = l.pos // CAST(8 ** (s.level + 1) AS BIGINT)
  GROUP BY l.r, s.level, l.pos
  UNION ALL
  SELECT l.r, 1000 + s.level, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < t.pos // CAST(8 ** s.level AS BIGINT)), ''), coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > t.pos // CAST(8 ** s.level AS BIGINT)), '')
  FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang JOIN above s ON s.n > 1 AND s.idx // 8 = t.pos // CAST(8 ** (s.level + 1) AS BIGINT)
  GROUP BY l.r, s.level, t.pos),
proofs AS (SELECT r, list({'l': lft, 'r': rgt} ORDER BY level) AS proof FROM steps GROUP BY r),
folds AS (
  SELECT l.r, 0 AS k, coalesce(l.tampered, l.leaf) AS digest, coalesce(p.proof, []) AS proof FROM leaves l LEFT JOIN proofs p USING (r)
  UNION ALL
  SELECT r, k + 1, sha256(proof[k + 1].l || digest || proof[k + 1].r), proof FROM folds WHERE k < len(proof))
SELECT l.doc_id, l.leaf, t.digest AS subroot, a.digest AS root,
       sha256(coalesce(array_to_string([x.l || x.r FOR x IN f.proof], ''), '')) AS proof_sha256, f.digest AS folded_root, f.digest = a.digest AS verified
FROM leaves l JOIN folds f ON f.r = l.r AND f.k = len(f.proof) JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang JOIN above a ON a.n = 1
"""
