"""Exact Jaccard join of texts on word shingles, by token-combination prefixes.

Tokens are hashed shingles in one global order: rarest first. If two sets of n and
m shingles reach the similarity, each lacks at most tau = n - ceil(0.75 n) of the
other, so their first tau + 1 tokens share one. Frequent tokens (over ``RARE``
sets) form a class of their own that is indexed by pairs of tokens: with f of them
in a prefix, f - 1 count towards tau + 1, so the prefix is one token longer. Sets
whose prefix holds so many frequent tokens that their pairs would outgrow the
tokens index those singly instead, beside their pairs, so no link is lost. The smaller
set of a pair needs 6/7 of its own shingles in the other, so only the shorter prefix
that this gives counts on its side.

Equal sets are one node from the start. The first round verifies each set of an
index list with its most central one only, that whose shingles are the most common,
so a text with its altered copies; it joins large groups in as many steps as they
have members. Next, sets outside a list's largest component meet the most central set
of that component. The last round verifies every pair of an index list that is left
in different components. All use whole sets, so the components are those of the exact
join; pairs within a component need no check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, delete, partitions, release, save

WORDS = 5
#: Sets that share a token at most for it to count as rare, as 16 * log2.
RARE = 80
#: Frequent tokens in a prefix, up to which all their pairs are indexed.
PAIRED = 16
#: Tokens of one hash range, which one task holds at a time, and ranges at most; only beyond their product ranges grow.
RANGE_TOKENS, RANGES = 3_000_000, 1 << 20
#: Tokens gathered from documents before they are dealt to hash ranges.
FLUSH_TOKENS = 1_000_000
LOW = np.uint64((1 << 48) - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of all words if fewer; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= ODD
        out += h[j : j + n]
    out = mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def node_of(found: np.ndarray) -> int:
    """Signed 64-bit hash of a set; equal sets are one node of the join."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def equal_tokens(found: np.ndarray) -> int:
    """How many of a set's hashes are lost if only 48 bits are kept; its prefixes are so much longer."""
    low = np.sort(found & LOW)
    return int((low[1:] == low[:-1]).sum())


def _sizes(id_col: str, text_col: str, k: int):
    def over(batches):
        for batch in batches:
            found = [shingles(t, k) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), *(pa.array([of(x) for x in found], pa.int64()) for of in (len, node_of, equal_tokens))],
                names=["id", "n_shingles", "node", "slack"],
            )

    return over


def _dealt(text_col: str, k: int, ranges: int):
    """Tokens of the partition's distinct sets, packed by hash range."""

    def packed(nodes, found):
        token = np.concatenate(found)
        node = np.repeat(np.arange(len(found), dtype=np.uint32), [len(x) for x in found])
        part = ((token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        token, node, part = token[order], node[order], part[order]
        names = np.array(nodes, np.int64)
        keys, blobs = [], []
        edges = np.searchsorted(part, np.arange(ranges + 1))
        for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            s, e = edges[p], edges[p + 1]
            own, counts = _runs(node[s:e])
            keys.append(p)
            blobs.append(pack(names[own], counts, token[s:e]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def over(batches):
        nodes, found, held, seen = [], [], 0, set()
        for batch in batches:
            for text in batch.column(text_col).to_pylist():
                x = shingles(text, k)
                node = node_of(x)
                if len(x) and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    found.append(x)
                    held += len(x)
                if held >= FLUSH_TOKENS:
                    yield packed(nodes, found)
                    nodes, found, held = [], [], 0
        if held:
            yield packed(nodes, found)

    return over


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sorted array and how often each occurs."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[starts], np.diff(np.r_[starts, len(x)])


def pack(nodes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, classes: np.ndarray | None = None) -> bytes:
    """Nodes, how many tokens each has, the tokens' low 48 bits in that order, and a class byte of each token if given."""
    low = np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    head = np.array([len(nodes), len(tokens)], "<u4").tobytes()
    return head + nodes.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + low.tobytes() + (b"" if classes is None else classes.tobytes())


def unpack(blob: bytes, classed: bool = False) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(blob, "<u4", 2)
    nodes = np.frombuffer(blob, "<i8", n, 8)
    counts = np.frombuffer(blob, "<u4", n, 8 + 8 * n)
    low = np.zeros((m, 8), np.uint8)
    low[:, :6] = np.frombuffer(blob, np.uint8, 6 * m, 8 + 12 * n).reshape(-1, 6)
    tokens = low.view("<u8").reshape(-1)
    return (nodes, counts, tokens, np.frombuffer(blob, np.uint8, m, 8 + 12 * n + 6 * m)) if classed else (nodes, counts, tokens)


def _shared(ranges: int):
    """Of one hash range: the tokens that at least two sets have, with their frequency class, packed by node."""

    def over(key, table):
        part = key[0].as_py()
        own, counts, token = (np.concatenate(x) for x in zip(*(unpack(blob.as_buffer()) for blob in table.column("blob")), strict=True))
        new = np.zeros(len(own), bool)
        new[np.unique(own, return_index=True)[1]] = True  # equal sets of other partitions are left out
        node, token = np.repeat(own[new], counts[new]), token[np.repeat(new, counts)]
        order = np.argsort(token)
        node, token = node[order], token[order]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df = np.diff(np.r_[starts, len(token)])
        df = np.repeat(df, df)
        keep = df > 1
        node, token = node[keep], token[keep]
        classes = np.minimum(255, 16 * np.log2(df[keep])).astype(np.uint8)
        order = np.argsort(node)
        to = (node % ranges).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
        order = order[np.argsort(to[order], kind="stable")]
        node, token, classes, to = node[order], token[order], classes[order], to[order]
        edges = np.searchsorted(to, np.arange(ranges + 1))
        keys, blobs = [], []
        for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            s, e = edges[p], edges[p + 1]
            own, counts = _runs(node[s:e])
            keys.append(p)
            blobs.append(pack(own, counts, token[s:e], classes[s:e]))
        return pa.table([pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], names=["to", "part", "blob"])

    return over


def _prefixed(_key, sets, packed):
    """Sets that can have a partner: their shared tokens, rarest first."""
    rows = []
    if packed.num_rows and sets.num_rows:
        node, token, classes = [], [], []
        for part, blob in zip(packed.column("part").to_pylist(), packed.column("blob"), strict=True):
            own, counts, low, kind = unpack(blob.as_buffer(), True)
            node.append(np.repeat(own, counts))
            token.append(low | (np.uint64(part & 0xFFFF) << np.uint64(48)))
            classes.append(kind)
        node, token, classes = np.concatenate(node), np.concatenate(token), np.concatenate(classes)
        _, code = np.unique(node, return_inverse=True)
        order = np.argsort(token)  # by node, then class, then token: the last key first
        order = order[np.argsort(classes[order], kind="stable")]
        order = order[np.argsort(code[order].astype(np.uint16 if len(code) and code.max() < 1 << 16 else np.int64), kind="stable")]
        node, token, classes = node[order], token[order], classes[order]
        sizes = dict(zip(sets.column("node").to_pylist(), zip(sets.column("n").to_pylist(), sets.column("slack").to_pylist(), strict=True), strict=True))
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(node)], strict=True):
            n, slack = sizes[int(node[s])]
            least = (3 * n + 3) // 4
            shared = e - s
            prefix = n - least + 1 + slack - (n - shared)
            if prefix > 0 and shared >= least - slack:
                rows.append((int(node[s]), n, slack, int(prefix), token[s:e].tobytes(), classes[s:e].tobytes()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "n", "slack", "prefix", "tokens", "classes"])


def _through_ties(token: np.ndarray, end: int) -> int:
    """The prefix's end, moved past tokens equal to its last."""
    end = max(0, min(end, len(token)))
    while 0 < end < len(token) and token[end] == token[end - 1]:
        end += 1
    return end


def _signed(rare_to: int, paired: int):
    """Index rows of each set.

    near: in the prefix of the smaller set of a pair. whole: false on single frequent
    tokens of sets whose pairs of tokens are indexed too.
    """
    return lambda batches: _index_rows(batches, rare_to, paired)


def _index_rows(batches, rare_to: int, paired: int):
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for who, n, slack, prefix, tokens, classes in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "slack", "prefix", "tokens", "classes")), strict=True):
            token, kind = np.frombuffer(tokens, "<u8"), np.frombuffer(classes, np.uint8)
            end = _through_ties(token, prefix)
            short = _through_ties(token, n - (6 * n + 6) // 7 + 1 + slack - (n - len(token)))
            rare = int((kind[:end] < rare_to).sum())
            longer = token[rare : min(end + 1, len(token))] if end > rare else token[:0]
            few = len(longer) <= paired
            rows, near = [mix(token[:end])], [np.arange(end) < short]
            whole = [np.arange(end) < rare if few else np.ones(end, bool)]
            if few and len(longer) > 1:
                i, j = np.triu_indices(len(longer), 1)
                rows.append(mix(mix(np.minimum(longer[i], longer[j])) * ODD + np.maximum(longer[i], longer[j])))
                near.append(rare + j <= short)
                whole.append(np.ones(len(i), bool))
            rows = np.concatenate(rows).view(np.int64)
            same = [np.full(len(rows), x) for x in (who, n, len(token) + slack, int(kind.sum(dtype=np.int64)) * 1000 // n)]
            for held, x in zip(columns, (rows, *same, np.concatenate(near), np.concatenate(whole)), strict=True):
                held.append(x)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["sig", "node", "n", "shared", "central", "near", "whole"])


def _verified(batches):
    for batch in batches:
        a, b = [], []
        for x, y, n, m, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "m", "s", "t")), strict=True):
            both = np.concatenate([np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")])
            both.sort()
            if 7 * int((both[1:] == both[:-1]).sum()) >= 3 * (n + m):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), "n", F.col("tokens").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("t"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_verified, "a long, b long")


#: n and m are the sizes of two sets, shared and held how many of their tokens other sets have too: neither has fewer than the overlap they need; the smaller meets the other in its shorter prefix.
FITS = "4 * n >= 3 * m and 4 * m >= 3 * n and 7 * least(shared, held) >= 3 * (n + m) and (n > m or near) and (m > n or close)"


#: A pair of nodes, the larger first.
PAIR = ("greatest(node, b) AS a", "least(node, b) AS b")


def _open(index: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of the index lists with sets of several components, each with its component and the list's largest one."""
    placed = index.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = placed.groupBy("sig", "component").agg(F.count("*").alias("rows"), F.max("whole").alias("whole"))
    mixed = counted.groupBy("sig").agg(F.max(F.struct("rows", "component")).alias("most"), F.count("*").alias("parts"), F.max("whole").alias("whole")).where("parts > 1 and whole").select("sig", F.col("most.component").alias("most"))
    return placed.join(mixed, "sig").select("sig", "node", "n", "shared", "central", "near", "component", "most")


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links, a few rounds from those known."""
    if not links.limit(1).count():
        return components
    return connected_components(links.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row (id, n_shingles, component_id) for each row of ``docs``.

    Texts link when their sets of lower-cased word shingles have a Jaccard
    similarity of 0.75 or more. component_id is the smallest id reachable by links,
    at least the row's own. Null and empty texts and texts without words have no
    shingles and link with nothing. Rows with equal ids are rows of one document:
    each keeps its own set, and the component is found for each set. A null id
    gives a null component unless a linked text has an id. Other columns are ignored.

    Equal 64-bit hashes count as equal sets and, within two sets, equal 48-bit
    hashes of one range as equal shingles (odds below 1e-10 for two usual texts).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sized = save(rows.mapInArrow(_sizes("id", "text", words), "id long, n_shingles long, node long, slack long"), "sized")
    per_node = sized.where("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("slack").alias("slack"), F.min("id").alias("least"))
    total = per_node.agg(F.sum("n")).first()[0] or 0
    ranges = min(RANGES, partitions(spark, -(-total // RANGE_TOKENS)))

    # As many tasks as ranges, whatever the session's number of shuffle partitions is.
    dealt = rows.select("text").mapInArrow(_dealt("text", words, ranges), "part int, blob binary").repartition(ranges, "part")
    shared = dealt.groupBy("part").applyInArrow(_shared(ranges), "to long, part int, blob binary").repartition(ranges, "to")
    by_node = per_node.select(F.expr(f"pmod(node, {ranges})").alias("to"), "node", "n", "slack").repartition(ranges, "to")
    sets = save(by_node.groupBy("to").cogroup(shared.groupBy("to")).applyInArrow(_prefixed, "node long, n long, slack long, prefix long, tokens binary, classes binary"), "sets")
    del dealt, shared
    release(spark)

    index = save(sets.mapInArrow(_signed(RARE, PAIRED), "sig long, node long, n long, shared long, central long, near boolean, whole boolean"), "index")
    lists = index.groupBy("sig").agg(F.max(F.struct("central", "node", F.col("n").alias("m"), F.col("shared").alias("held"), F.col("near").alias("close"))).alias("pivot"), F.count("*").alias("rows"), F.max("whole").alias("whole")).where("whole and rows > 1").select("sig", F.col("pivot.node").alias("b"), F.col("pivot.m").alias("m"), F.col("pivot.held").alias("held"), F.col("pivot.close").alias("close"))
    tried = save(index.join(lists, "sig").where("node <> b").where(FITS).selectExpr(*PAIR).distinct(), "pairs")
    links = save(_verify(tried, sets), "links")
    joined = connected_components(links)

    open_rows = _open(index, joined)
    heads = open_rows.where("component = most").groupBy("sig").agg(F.max(F.struct("central", "node", F.col("n").alias("m"), F.col("shared").alias("held"), F.col("near").alias("close"))).alias("pivot")).select("sig", F.col("pivot.node").alias("b"), F.col("pivot.m").alias("m"), F.col("pivot.held").alias("held"), F.col("pivot.close").alias("close"))
    toward = save(open_rows.where("component <> most").join(heads, "sig").where(FITS).selectExpr(*PAIR).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    tried = tried.unionByName(toward)
    more = save(_verify(toward, sets), "links")
    joined = _joined(joined, more)

    open_rows = save(_open(index, joined), "open")
    fewer = open_rows.where("component <> most").select("sig", F.col("node").alias("b"), F.col("n").alias("m"), F.col("shared").alias("held"), F.col("near").alias("close"), F.col("component").alias("other"))
    across = open_rows.join(fewer, "sig").where("component <> other and (component = most or node < b)").where(FITS).selectExpr(*PAIR).distinct()
    second = save(_verify(across.join(tried, ["a", "b"], "left_anti"), sets), "links")
    every = _joined(joined, second)

    roots = per_node.join(every, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = save(roots.join(named, "root").select("node", "component_id"), "components")
    delete(spark, sets, index, tried, open_rows, links, more, second)
    release(spark)
    out = sized.join(of_node, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
