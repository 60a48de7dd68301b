"""Repair of conversations by weighted interval parsing.

A conversation should read ``(s?(ua)+)?``, an optional system row and then pairs of user and
assistant. Edits cost: keep (K) 0, another role (R) 1, delete (D) 2, insert an empty user or assistant
row (I) 5; a truncated row that stays adds 5, and blank and repeated rows must go.

The repair grammar is in Chomsky normal form. Its nonterminals N(p, q) stand for rows that lead
from state p of the pattern to state q: N(p, q) -> N(p, r) N(r, q), or one row under an edit. Insertions
need no row, so their closure is taken before and after each row. A cell of a span holds for each N(p, q) the least
(cost, audit). Rows of a span leave the pattern in some state at any place between, so
every split of a span gives the same cells and one is enough: spans of one row are combined to spans of
2, 4, 8 and so on, first in blocks of ``BLOCK`` rows, then over ``TOGETHER`` blocks at a time. A cost is a function of
a span and its audit, so of two audits of one span and cost none starts the other, and the least audits
of parts make the least audit of the whole.

A conversation may have any number of rows: its rows are put in order in ranges, blocks are parsed
apart, and the repaired text is read as a sorted stream. Rows of one turn are in order of role and text. Null
roles and texts count as one space, and a role without a known initial can't be kept; a null conv_id is a
conversation of its own, and its part of the damage's key is one space too, as a null turn's. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ranked, save

BLOCK, TOGETHER = 128, 64
KEEP, ROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the pattern: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
SPAN = "struct<first:string,last:string,illegal:long,costs:array<long>,audits:array<string>>"

Cell = tuple[tuple[int, str] | None, ...]


def combined(left: Cell, right: Cell) -> Cell:
    """Cells of two neighbouring spans as those of one."""
    out = []
    for p in range(4):
        for q in range(4):
            best = None
            for r in range(4):
                a, b = left[4 * p + r], right[4 * r + q]
                if a and b and (best is None or a[0] + b[0] <= best[0]):
                    found = (a[0] + b[0], a[1] + b[1])
                    best = found if best is None else min(best, found)
            out.append(best)
    return tuple(out)


def _cell(edges: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(edges.get((p, q)) for p in range(4) for q in range(4))


def insertions() -> Cell:
    """What inserted rows alone can do, at least cost."""
    known = {(p, p): (0, "") for p in range(4)}
    grown = True
    while grown:
        steps = {(p, NEXT[q, x]): (c + INSERT, a + "I") for (p, q), (c, a) in known.items() for x in "ua" if (q, x) in NEXT}
        better = {k: v for k, v in steps.items() if k not in known or v < known[k]}
        known |= better
        grown = bool(better)
    return _cell(known)


def row_cell(kind: str) -> Cell:
    """A row by its kind: ``x`` must go, else its initial (``o``: none of s, u, a), a capital if truncated."""
    edges = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        for (p, x), q in NEXT.items():
            ways = [(KEEP + more, "K")] if x == kind.lower() else []
            ways += [(ROLE + more, "R")] if x in "ua" else []
            if ways:
                edges[p, q] = min(ways)
    around = insertions()
    return combined(combined(around, _cell(edges)), around)


def _halves(kinds: str) -> Cell:
    if len(kinds) == 1:
        return row_cell(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combined(cells(kinds[:half]), cells(kinds[half:]))


_short = lru_cache(1 << 15)(_halves)


def cells(kinds: str) -> Cell:
    """Cells of a span of rows, from those of its largest part of 2 ** k rows and of the rest; short spans are remembered."""
    return _short(kinds) if len(kinds) <= 4 else _halves(kinds)


def whole(costs: list[int], audits: list[str]) -> tuple[int, str]:
    """The least cost and audit of a conversation."""
    return min((costs[4 * START + q], audits[4 * START + q]) for q in ENDS if costs[4 * START + q] >= 0)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _spanned(first: str, last: str, illegal: int, cell: Cell) -> dict:
    return {"first": first, "last": last, "illegal": illegal, "costs": [x[0] if x else -1 for x in cell], "audits": [x[1] if x else None for x in cell]}


def _block(initials: pa.Array, kinds: pa.Array) -> pa.Array:
    out = []
    for i, k in zip(initials.to_pylist(), kinds.to_pylist(), strict=True):
        out.append(_spanned(i[0], i[-1], sum(not _legal(a, b) for a, b in zip(i, i[1:], strict=False)), cells(k)))
    return pa.array(out, _span_type())


def _joined(spans: pa.Array) -> pa.Array:
    """Neighbouring spans, in twos, fours and so on."""
    out = []
    for row in spans.to_pylist():
        parts = [(x["first"], x["last"], x["illegal"], tuple((c, a) if c >= 0 else None for c, a in zip(x["costs"], x["audits"], strict=True))) for x in row]
        while len(parts) > 1:
            pairs = [(a[0], b[1], a[2] + b[2] + (not _legal(a[1], b[0])), combined(a[3], b[3])) for a, b in zip(parts[::2], parts[1::2], strict=False)]
            parts = pairs + parts[len(parts) & ~1 :]
        out.append(_spanned(*parts[0]))
    return pa.array(out, _span_type())


def _span_type() -> pa.DataType:
    return pa.struct([("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _least(costs: pa.Array, audits: pa.Array) -> pa.Array:
    found = [whole(c, a) for c, a in zip(costs.to_pylist(), audits.to_pylist(), strict=True)]
    return pa.array([{"cost": c, "audit": a} for c, a in found], pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


class Repair:
    """Applies an audit to the rows of a conversation in turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> list[tuple[str, str, str]]:
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            out.append(("I", *self._as("ua"[self.state == USER]), ""))
            self.at += 1
        return out

    def _as(self, initial: str) -> tuple[str]:
        self.state = NEXT[self.state, initial]
        return (ROLES[self.state],)

    def row(self, role: str, text: str) -> list[tuple[str, str, str]]:
        """(edit, role, text) of rows inserted before this one and of what becomes of it."""
        out = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state, role[0]]
            out.append((edit, role, text))
        elif edit == "R":
            out.append((edit, *self._as("ua"[self.state == USER]), text))
        return out


def _applied(batches):
    """Repaired rows; the rows of a conversation follow its audit, which comes as a text without a role at place -1."""
    place, now, conv = 0, None, None
    for batch in batches:
        out, kind = [], batch.column(0).type

        def more(rows):
            nonlocal place
            for edit, role, text in rows:
                out.append((conv, place, edit, role, text))
                place += 1

        for c, pos, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if pos < 0:
                more(now.inserted() if now else [])
                conv, place, now = c, 0, Repair(text)
            else:
                more(now.row(role, text))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "edit", "role", "text"])
    if now and (rows := now.inserted()):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((conv, place + i, *r) for i, r in enumerate(rows)), strict=True), (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "edit", "role", "text"])


def _hashed(batches):
    """SHA-256 of each conversation's repaired rows, ``role:text`` joined by newlines, as they stream by."""
    now, conv, digest, first = None, None, None, True

    def take(rows):
        nonlocal first
        for _, role, text in rows:
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False

    for batch in batches:
        ended, kind = [], batch.column(0).type
        for c, pos, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if pos >= 0:
                take(now.row(role, text))
                continue
            if now:
                take(now.inserted())
                ended.append((conv, digest.hexdigest()))
            conv, now, digest, first = c, Repair(text), hashlib.sha256(), True
        if ended:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*ended, strict=True), (kind, pa.string()), strict=True)], names=["conv_id", "repaired_sha256"])
    if now:
        take(now.inserted())
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults, chosen by crc32 of ``conv_id:turn`` modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("hit")
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), hit).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


class Parsed:
    """Conversations in order, their faults, and the least audit of each."""

    def __init__(self, turns: DataFrame):
        self.kind = turns.schema["conv_id"].dataType.simpleString()
        space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        rows = turns.select("conv_id", "turn", space("role"), space("text"))
        #: (conv_id, turn, role, text, pos, n)
        self.rows = save(ranked(rows, "conv_id", ["turn", "role", "text"]), "turns")
        initial = F.substring("role", 1, 1)
        mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
        narrow = self.rows.select("conv_id", "turn", "pos", "n", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z").alias("open"), mark.alias("mark"))
        seen = narrow.groupBy("conv_id", "mark").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("new"))
        joined = narrow.alias("r").join(seen.alias("s"), F.expr("r.conv_id <=> s.conv_id and r.pos = s.pos"), "left")
        fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("none")
        #: (conv_id, turn, pos, n, initial, fault)
        self.faults = save(joined.select("r.conv_id", "r.turn", "r.pos", "r.n", "r.initial", fault.alias("fault")), "faults")

    def spans(self) -> DataFrame:
        """(conv_id, span), one for each conversation."""
        kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
        ordered = F.array_sort(F.collect_list(F.struct("pos", "initial", kind.alias("kind"))))
        letters = lambda c: F.array_join(F.transform(ordered, lambda x: x[c]), "")
        blocks = self.faults.groupBy("conv_id", F.expr(f"pos div {BLOCK}").alias("block"), "n").agg(letters("initial").alias("initials"), letters("kind").alias("kinds"))
        spans = save(blocks.select("conv_id", "block", "n", F.arrow_udf(_block, SPAN)("initials", "kinds").alias("span")), "spans")
        most, size = spans.agg(F.max("n")).first()[0] or 0, BLOCK
        done = spans.where(f"n <= {size}").select("conv_id", "span")
        while most > size:
            rest = spans.where(f"n > {size}").groupBy("conv_id", F.expr(f"block div {TOGETHER}").alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("block", "span"))).alias("spans"))
            size *= TOGETHER
            spans = save(rest.select("conv_id", "block", "n", F.arrow_udf(_joined, SPAN)(F.transform("spans", lambda x: x["span"])).alias("span")), "spans")
            done = done.unionByName(spans.where(f"n <= {size}").select("conv_id", "span"))
        return done

    def least(self) -> DataFrame:
        """(conv_id, cost, audit, illegal)"""
        found = self.spans().withColumn("least", F.arrow_udf(_least, "struct<cost:long,audit:string>")("span.costs", "span.audits"))
        return save(found.select("conv_id", "least.cost", "least.audit", "span.illegal"), "audits")

    def stream(self, least: DataFrame) -> DataFrame:
        """Each conversation's audit and rows, in order."""
        first = least.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
        return self.rows.select("conv_id", "pos", "role", "text").unionByName(first).repartition(partitions(self.rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos")

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated) of conversations with rows."""
        turns = self.faults.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
        counts = self.faults.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")))
        return counts.alias("c").join(turns.alias("t"), F.expr("c.conv_id <=> t.conv_id"), "left").select("c.*", F.coalesce("t.gaps", F.lit(0)).cast("long").alias("gaps"))


def repair(turns: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, place, edit, role, text) of all conversations of rows (conv_id, turn, role, text); edit is K, R or I."""
    parsed = Parsed(turns)
    return parsed.stream(parsed.least()).mapInArrow(_applied, f"conv_id {parsed.kind}, place long, edit string, role string, text string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults, least cost, audit and digest of each conversation after ``damaged``; zeros and an empty audit for those that lost all rows."""
    parsed = Parsed(damaged(conversations))
    least = parsed.least()
    hashes = parsed.stream(least).mapInArrow(_hashed, f"conv_id {parsed.kind}, repaired_sha256 string")
    on = lambda b: F.expr(f"a.conv_id <=> {b}.conv_id")
    all_ids = conversations.select("conv_id").distinct()
    joined = all_ids.alias("a").join(parsed.summary().alias("s"), on("s"), "left").join(least.alias("l"), on("l"), "left").join(hashes.alias("h"), on("h"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c.split(".")[1]) for c in ("s.gaps", "s.blank", "s.duplicate", "s.truncated", "l.illegal", "l.cost")]
    return joined.select("a.conv_id", *counts, F.coalesce("l.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE
bits AS (SELECT [list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) % 20 AS h
  FROM conversations, bits),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, LATERAL (SELECT unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END)) WHERE h <> 0),
placed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS ini FROM rows_),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
    ini || lead(ini) OVER (PARTITION BY k ORDER BY pos) AS pair FROM placed),
-- The states 0 start, 1 system, 2 user, 3 assistant; what edits and insertions do.
moves (p, ini, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
names (q, name) AS (VALUES (2, 'user'), (3, 'assistant')),
added (p, q, cost, letters, made) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
edits AS (
  SELECT f.k, f.pos, s.p, s.p AS q, 2 AS cost, 'D' AS letter, CAST([] AS VARCHAR[]) AS made FROM faulty f, (VALUES (0), (1), (2), (3)) s(p)
  UNION ALL
  SELECT f.k, f.pos, m.p, m.q, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM faulty f JOIN moves m ON m.ini = f.ini WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT f.k, f.pos, m.p, m.q, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', [n.name || ':' || f.text] FROM faulty f, moves m JOIN names n ON n.q = m.q WHERE fault NOT IN ('blank', 'duplicate')),
ways AS (
  SELECT e.k, e.pos, e.p, a.q, e.cost + a.cost AS cost, e.letter || a.letters AS letters, e.made || a.made AS made FROM edits e JOIN added a ON a.p = e.q),
best AS (
  SELECT k, CAST(0 AS BIGINT) AS pos, a.q, {'cost': a.cost, 'audit': a.letters, 'made': a.made} AS b FROM (SELECT DISTINCT k FROM placed) JOIN added a ON a.p = 0
  UNION ALL
  SELECT w.k, w.pos, w.q, min({'cost': x.b.cost + w.cost, 'audit': x.b.audit || w.letters, 'made': x.b.made || w.made}) FROM best x JOIN ways w ON w.k = x.k AND w.pos = x.pos + 1 AND w.p = x.q GROUP BY w.k, w.pos, w.q),
counted AS (
  SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY k),
ends AS (SELECT c.*, e.b FROM counted c JOIN (SELECT k, pos, min(b) AS b FROM best WHERE q IN (0, 3) GROUP BY k, pos) e ON e.k = c.k AND e.pos = c.n)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON e.k = coalesce(CAST(o.conv_id AS VARCHAR), ' ')
"""
