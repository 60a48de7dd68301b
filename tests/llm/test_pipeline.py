"""The pipeline against a version of plain loops, stage by stage, and rows with repeated ids and columns of any name."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_corpus_operators import components, library, shingle_set

import corpus_pipeline
from transit_tables.llm import mixing, quality, secrets

KIND = "doc_id long, text string, lang string, source string, n_chars long, _score double, score string, row_key string, row_copies int, text_key long, _copies array<int>, size long"
OWN = ("en", 0.25, "s", "k", 3, 7, [1, 2], 9)


def row(i, text, source="a"):
    lang, score, s, key, copies, text_key, many, size = OWN
    return (i, text, lang, source, len(text or ""), score, s, key, copies, text_key, many, size)


def naive_features(text):
    """The features of each passage, character by character and word by word."""
    data = (text or "").encode()
    words, passages, pairs = data.split(), [], defaultdict(Counter)
    if not words:
        return [[0.0] * quality.WIDTH]
    kind = lambda b: quality.N_CLASSES - 1 if b > 127 else next((i for i, c in enumerate(quality.CLASSES) if chr(b) in c), quality.N_CLASSES - 2)
    begun, before = 0, True
    for i, b in enumerate(data):
        space = kind(b) in (3, 4)
        begun += before and not space
        before = space
        if i:
            pairs[max(begun - 1, 0) // quality.PASSAGE][kind(data[i - 1]), kind(b)] += 1
    for p in range(0, len(words), quality.PASSAGE):
        own = words[p : p + quality.PASSAGE]
        counts = pairs[p // quality.PASSAGE]
        total = max(sum(counts.values()), 1)
        first = [math.sqrt(counts[a, b] / total) for a in range(quality.N_CLASSES) for b in range(quality.N_CLASSES)]
        same = sum(words[k] == words[k - 1] for k in range(p, p + len(own)) if k)
        n = len(own)
        passages.append([*first, same / n, len(set(own)) / n, math.log1p(sum(map(len, own)) / n), math.log1p(sum(len(w) > 20 for w in own) / n), n / quality.PASSAGE, 1.0])
    return passages


def naive_score(model, text):
    """One document's score by loops over its passages."""
    p = model.p
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    hidden = [np.tanh(np.array(x) @ p["E"]) for x in naive_features(text)]
    gates = [float((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]) for h in hidden]
    weights = np.exp(gates) / np.exp(gates).sum()
    return float(sigmoid(sum(w * h for w, h in zip(weights, hidden, strict=True)) @ p["c"] + p["b"][0]))


def naive_mix(rows):
    """Copies of (id, source, size) rows by walking along each source once."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while left > 1e-9 and free:
        unit, left = left / sum(weight[s] for s in free), 0.0
        for s in sorted(free, key=str):
            target[s] += unit * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    out = {}
    for s in sizes:
        share = target[s] / sizes[s] if sizes[s] else 1.0
        at = int(hashlib.md5((mixing.SEED + (s or "")).encode()).hexdigest()[:8], 16) / 2**32
        key = lambda r: (r[2], hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest())
        for k, r in enumerate(sorted((r for r in rows if r[1] == s), key=key)):
            out.setdefault(r, []).append(math.floor((k + 1) * share + at) - math.floor(k * share + at))
    return out


def corpus():
    rng = random.Random(12)
    words = [f"wort{i}" for i in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(rng.choice([30, 70, 150]))) + "." for _ in range(110)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(90)) for _ in range(50)]
    rows = [row(i, t, rng.choice(["a", "b", None])) for i, t in enumerate([*good, *bad])]
    key = "".join(rng.choice(secrets.ALPHABETS[8]) for _ in range(48))
    more = [good[0], good[1] + " mehr", "password = hunter2000 " + " ".join(rng.choices(words, k=70)) + ".", f"mein {key} " + " ".join(rng.choices(words, k=80)) + ".", good[4].replace("wort", "Wort")]
    return rows + [row(200 + i, t, "b") for i, t in enumerate(more)]


def test_every_stage_by_plain_loops(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 110), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def ran(name):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == columns
        assert all(tuple(r)[5:] == row(0, "")[5:] for r in out.collect())
        return out

    model = quality.train(docs, labels.where(~quality.held_out()))
    want = [r for r in rows if naive_score(model, r[1]) >= quality.ACCEPT]
    docs = ran("quality classifier")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((r[0], r[1]) for r in want) and 100 < len(want) < 130

    sets = [shingle_set(r[1]) for r in want]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    group = components(len(want), linked)
    want = [r for i, r in enumerate(want) if r[0] == min(s[0] for j, s in enumerate(want) if group[i] == group[j])]
    docs = ran("n-gram Jaccard join")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((r[0], r[1]) for r in want) and linked

    found = {}
    for r in want:
        spans = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(r[1]) if len(m[2]) >= 6]
        spans += [(m.start(), m.end(), "random") for m in secrets.TOKEN.finditer(r[1]) if secrets.battery(m[0]) > 8]
        text = r[1]
        for s, e, kind in sorted(spans, reverse=True):
            text = text[:s] + f"[{kind}]" + text[e:]
        found[r[0]] = text
    docs = ran("secret scans")
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in found.items()}
    assert sum("[random]" in t for t in found.values()) == sum("[assign]" in t for t in found.values()) == 1

    copies = naive_mix([(r[0], r[3], len(found[r[0]].split())) for r in want])
    docs = ran("mixing sources")
    assert Counter(r.doc_id for r in docs.collect()) == Counter({k[0]: sum(n) for k, n in copies.items() if sum(n)})

    last = stages["byte-level BPE"](spark, docs, str(tmp_path)).collect()
    enc = library()
    for r in last:
        ids = enc.encode_ordinary(found[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(found[r.doc_id].encode()).hexdigest()
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, last))


def test_rows_are_chosen_by_group_of_texts(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(30)) for w in ("one", "two", "three"))
    data = [(1, a, "x"), (1, b, "x"), (2, a + "more", "x"), (None, b, "x"), (None, c, "x"), (None, c, "x"), (3, "", "x"), (4, "", "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = {(1, a, "x"), (1, b, "x"), (None, c, "x"), (3, "", "x"), (4, "", "y")}
    for rows in (docs, docs.orderBy("text", ascending=False)):
        got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, rows, "").collect()]
        assert len(got) == len(want) and set(got) == want


def test_mixed_rows_of_one_id_and_of_no_id(spark):
    data = [(None, "a b", "s")] * 50 + [(1, "a b", "s")] * 3 + [(1, "b a", "s"), (2, None, None), (None, None, "t")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = Counter(tuple(r) for r in mixing.mixed(docs).collect())
    want = mixing.copies(docs).groupBy("doc_id", "source", "size").sum("copies").collect()
    for r in want:
        assert r[3] == sum(n for (i, t, s), n in got.items() if (i, s, len((t or "").split())) == tuple(r)[:3])
    assert (got[1, "b a", "s"], got[1, "a b", "s"], got[None, "a b", "s"]) == (2, 4, 75)


def test_mixed_rows_are_the_same_in_every_layout(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice(["a b", "b a", "a a", "x y z"]), rng.choice("st"), i % 9) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n int")
    one, two, three = (Counter(tuple(r) for r in mixing.mixed(d).collect()) for d in (docs, docs.orderBy("text", "n", ascending=False), docs.repartition(7, "n")))
    assert one == two == three and sum(one.values()) > 400


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATED", 7)
    docs = spark.createDataFrame([(None, "a", "s")] * 100 + [(1, "a b c", "t")], "doc_id long, text string, source string")
    got = Counter(tuple(r) for r in mixing.mixed(docs).collect())
    want = {(r.doc_id, r.source): r["sum(copies)"] for r in mixing.copies(docs).groupBy("doc_id", "source").sum("copies").collect()}
    assert {(i, s): n for (i, _, s), n in got.items()} == {k: v for k, v in want.items() if v} and max(got.values()) > 49


def test_scores_are_those_of_plain_loops(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "eins", "A1!! ##", "é ü ß", *(" ".join(rng.choice(["wort", "Wort!", "12", "zwei,", "x" * 25, "wort"]) for _ in range(n)) for n in (63, 64, 65, 300))]
    model = quality.AttentionModel(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(naive_score(model, t), abs=1e-6), repr(t)


def test_training_is_bounded_whatever_repeats(spark):
    """Repeated ids and very long texts add nothing beyond the sample's bound, and rows in another order give the same model."""
    data = [(i, ("gut wort. " if i % 2 else "BAD!! ##") * (20 + i), 1) for i in range(60)]
    long = [(1, "gut wort. " * 30_000, 1), (1, "gut wort. " * 21, 1), (None, "x", 1)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(data + long * 3, "doc_id long, text string, n int")
    seen = []

    class Model(quality.AttentionModel):
        def fit(self, bags, y, **options):
            seen.append((sorted(map(len, bags)), sorted(y)))
            super().fit(bags, y, **options)

    kept, quality.AttentionModel = quality.AttentionModel, Model
    try:
        a, b = (quality.train(d, labels, each_label=25, each_document=9) for d in (docs, docs.orderBy("text", ascending=False)))
    finally:
        quality.AttentionModel = kept
    assert all(len(sizes) <= 50 and max(sizes) <= 9 and sum(y) <= 25 for sizes, y in seen) and seen[0] == seen[1]
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)
