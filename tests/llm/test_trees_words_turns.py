"""Conversation repair, the Merkle manifest and the table of distinct words against plain versions, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest

from transit_tables.llm import merkle, repair, word_table

ROWS = "conv_id long, turn long, role string, text string, pos int, n int, fault string, block int, kinds string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversations


def all_scripts(kinds):
    """The least (cost, audit) over all edits with at most two insertions between rows."""
    gaps = [("", "", 0)] + [("I" * n, "".join(x), 5 * n) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    rows = []
    for k in kinds:
        ways = [("D", "", 2)]
        if k != "x":
            more = 5 if k.isupper() else 0
            ways += [("K", k.lower(), more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        rows.append(ways)
    parts = [gaps]
    for ways in rows:
        parts += [ways, gaps]
    return min((sum(x[2] for x in s), "".join(x[0] for x in s)) for s in itertools.product(*parts) if re.fullmatch("(s?(ua)+)?", "".join(x[1] for x in s)))


def forward(kinds):
    """The least (cost, audit) from left to right."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def insert(known):
        for _ in range(3):
            for (p, x), q in moves.items():
                if x != "s" and p in known:
                    known[q] = min(known.get(q, (10**9, "")), (known[p][0] + 5, known[p][1] + "I"))
        return known

    known = insert({0: (0, "")})
    for k in kinds:
        after = {p: (c + 2, a + "D") for p, (c, a) in known.items()}
        for (p, x), q in moves.items():
            if p in known and k != "x":
                more = 5 if k.isupper() else 0
                for edit, cost in [("K", 0)] * (x == k.lower()) + [("R", 1)] * (x != "s"):
                    after[q] = min(after.get(q, (10**9, "")), (known[p][0] + cost + more, known[p][1] + edit))
        known = insert(after)
    return min(known[q] for q in (0, 3) if q in known)


def least(kinds):
    found = repair.cells(kinds)
    return min(found[q] for q in (0, 3) if found[q])


def test_cells_against_all_scripts():
    rng = random.Random(2)
    for kinds in [*"xsuaoSUAO", *("".join(rng.choices("xsuaoSUAO", k=n)) for n in (2, 2, 2, 3, 3, 3) for _ in range(4))]:
        assert least(kinds) == all_scripts(kinds), kinds


def test_cells_against_a_forward_pass_and_any_split():
    rng = random.Random(3)
    for n in (5, 8, 9, 31, 200):
        for _ in range(6):
            kinds = "".join(rng.choices("xsuaoSUAO", (1, 1, 8, 8, 1, 1, 1, 1, 1), k=n))
            assert least(kinds) == forward(kinds)
            cut = rng.randrange(1, n)
            assert repair.combined(repair.cells(kinds[:cut]), repair.cells(kinds[cut:])) == repair.cells(kinds)


def plain_report(rows):
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, hash), and repaired rows."""
    key = lambda x: (x is not None, x if x is not None else 0)
    found = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        found[c] += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    out, repaired = {}, {}
    for c, turns in found.items():
        turns.sort(key=lambda t: (key(t[0]), t[1].encode(), t[2].encode()))
        seen, faults, kinds = set(), [], ""
        for _, role, text in turns:
            words = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = forward(kinds)
        row, made = iter(turns), []
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(row)
            if edit != "D":
                made.append((edit, role if edit == "K" else "assistant" if made and made[-1][1][0] == "u" else "user", text))
        known = {t for t, *_ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        firsts = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts))
        repaired[c] = made
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for _, r, t in made)))
    return out, repaired


def conversations():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "Why?", "open end", " \t\n", "", None, "so.\x0b", "a ", "Ein Satz.", "x" * 20_000 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, None, "user", "Hi."), (None, 3, None, None), (50, None, "user", "a."), (50, None, "assistant", "b."), (50, 7, "user", "c."), (50, 7, "user", "c."), (51, -5, "s", "x.")]
    return rows + [(60, t // 2, ("user", "assistant", "system")[t % 5 % 3], rng.choice(texts) if t % 3 else f"{t}.") for t in range(700)]


@pytest.mark.parametrize("block,together", [(128, 64), (4, 2)])
def test_repair_report(spark, monkeypatch, block, together):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "TOGETHER", together)
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, 2, "x", 3, "y") for r in rows], ROWS)
    want, _ = plain_report(rows)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(table).collect()}
    assert got == want


def test_repaired_rows(spark):
    rows = [(i, t, r, x) for i, (t, r, x) in enumerate([(0, "assistant", "A."), (0, "user", "B."), (1, "system", "C."), (2, "user", "D")])]
    rows += [(9, 0, "system", "S."), (9, 1, "user", "Q?"), (9, 2, "user", "R."), (9, 3, "assistant", "open")]
    got = {}
    for r in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert got == {9: [("K", "system", "S."), ("K", "user", "Q?"), ("R", "assistant", "R.")]}  # D costs 2, so lone rows go


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repair_report(empty).count() == repair.repair(empty).count() == 0
    hits = {zlib.crc32(f"c{i}:1".encode()) % 20: f"c{i}" for i in range(200)}
    lost = spark.createDataFrame([(hits[0], 1, "user", "Gone.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in repair.repair_report(lost).collect()] == [(hits[0], 0, 0, 0, 0, 0, 0, "", sha(""))]


# Merkle manifest


def joined(parts):
    return sha("".join(parts))


def tree(leaves):
    """Levels from the leaves up."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, pos):
    """(left, right) of each level."""
    out = []
    for level in levels[:-1]:
        start = pos // 8 * 8
        out.append(("".join(level[start:pos]), "".join(level[pos + 1 : start + 8])))
        pos //= 8
    return out


def leaf(row, lower=False):
    doc_id, source, lang, n_chars, text = row
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return joined("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    order = {x: sorted(by[x], key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in order[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(order[x]):
            proof = path(trees[x], i) + path(top, k)
            digest = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for a, b in proof:
                digest = joined((a, digest, b))
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], joined(a + b for a, b in proof), digest, digest == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, n int, digest string, at int, carried string, level int"


def manifest(spark, rows):
    table = spark.createDataFrame([(*r, "t", 1, 2, "d", 3, "c", 4) for r in rows], DOCS)
    return sorted((tuple(r) for r in merkle.manifest_report(table).collect()), key=str)


def test_manifest(spark):
    rng = random.Random(6)
    langs = ["en"] * 6 + ["de", None, "", "é", "Z"]
    rows = [(i, f"s{i % 3}" if i % 7 else None, rng.choice(langs), i if i % 5 else None, rng.choice(["Some Text", "ÄÖ x", "", None, "lower"]) ) for i in range(1100)]
    rows += [(5000, "s", "one", 4, "Only"), *[(None, None, "en", None, None)] * 12, *[(7, "s", "en", 1, "Same")] * 30, (6000, "s", "de", 900_000, "Long Text " * 90_000)]
    rows += [(7000 + i, "s", f"lang{i}", 1, "A") for i in range(20)]
    assert manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert manifest(spark, []) == []
    for rows in ([(1, "s", "en", 1, "A")], [(1, "s", "en", 1, "A"), (2, "s", "en", 1, "a")], [(i, "s", str(i), 1, "A") for i in range(9)]):
        assert manifest(spark, rows) == plain_manifest(rows)


def test_queue_orders_labels_both_ways():
    up, down = merkle.Queue(), merkle.Queue(-1)
    for q in (up, down):
        for last, level in [(7, 2), (7, 1), (3, 1), (7, 1)]:
            q.send(last, level, (last, level))
    assert up.next_label() == (3, 1) and down.next_label() == (7, 2)
    assert up.receive(7, 1) == [] and up.receive(3, 1) == [(3, 1)] and len(up.receive(7, 1)) == 2


# The table of distinct words


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(word_table.TOKENIZER))


def texts():
    rng = random.Random(8)
    own = [None, "", " \n\t ", "Hello,  wörld's 12 <|endoftext|> x<|startoftext|>y", "don't CAN'T ''s 's", "á ́x é", " a b c", "ΣΑΣ ΟΔΟΣ", "İ ß ẞ ǅ", "日本語テキスト 😀😀", "\x00\x1c\x85z", "<| a|> <|end", "x" * 3000, "word " * 5000 + "word"]
    chars = [*map(chr, range(0x20, 0x250)), *"̧̀́‍﻿　٣一가", "\U0001f600"]
    return own + ["".join(rng.choices(chars, k=rng.randrange(1, 60))) for _ in range(400)]


def test_words_equal_the_library(spark):
    library, want = tokenizer(), {}
    rows = [(f"d{i}", t, 1, "b", 2) for i, t in enumerate(texts())]
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    docs = spark.createDataFrame(rows, "doc_id string, text string, block int, word string, number int").repartition(3)
    found = word_table.encode(docs)
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in found.collect()} == want
    back = word_table.decode(found.select("doc_id", "ids").withColumnRenamed("doc_id", "token"), out_col="text")
    assert {r.token: r.text for r in back.collect()} == {i: w[2] for i, w in want.items()}


def test_words_of_null_and_repeated_ids_and_of_nothing(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (1, None), (None, "")]
    got = sorted((tuple(r) for r in word_table.digests(spark.createDataFrame(rows, "doc_id int, text string")).collect()), key=str)
    library = tokenizer()
    ids = library.encode("a b", add_special_tokens=False).ids
    ab, none = (2, sha(" ".join(map(str, ids))), sha("a</w> b</w>")), (0, sha(""), sha(""))
    assert got == sorted([(None, *ab), (1, *ab), (1, *ab), (1, *none), (None, *none)], key=str)
    assert word_table.digests(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [99_999_999])], "doc_id int, ids array<int>")
    assert [(r.doc_id, r.decoded) for r in word_table.decode(nulls).orderBy("doc_id").collect()] == [(1, None), (2, ""), (3, "")]


def test_words_refuse_a_tokenizer_with_a_decoder(spark):
    with pytest.raises(ValueError):
        word_table.piece_table(spark, public_tokenizers.path("byte_bpe_50k.json"))


def test_whole_texts_as_words_for_another_kind_of_tokenizer(spark, tmp_path):
    import json

    file = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    file["decoder"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file))
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(str(other)), [(0, "Two  words\nand a line"), (1, "Two  words\nand a line"), (2, ""), (3, None)]
    got = {r.doc_id: (r.ids, r.decoded) for r in word_table.encode(spark.createDataFrame(rows, "doc_id int, text string"), path=str(other)).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False))
