"""The randomness battery against sums over all strings and simulation, and its control of false finds."""

import itertools
import math
import random
import re
import uuid

import numpy as np
import pytest

from transit_tables.llm import secrets

SIZES = (20, 32, 40, 64)


def keys(rng, n, sizes=SIZES, alphabet=8):
    return ["".join(rng.choice(secrets.ALPHABETS[alphabet]) for _ in range(rng.choice(sizes))) for _ in range(n)]


def names(rng, n):
    words = ["data", "Node", "value", "index", "Frame", "read", "open", "HTTP", "Request", "get", "User", "List", "v2", "max", "string"]
    return [rng.choice(["", "_", "-", "/"]).join(rng.choice(words) for _ in range(rng.choice([7, 9, 11]))) for _ in range(n)]


def other_tokens(rng, n):
    paths = ["/usr/" + "/".join(rng.choice(["share", "lib", "docs", "python", "main", "site"]) for _ in range(6)) for _ in range(n)]
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(n)]
    numbers = [str(rng.getrandbits(90)) for _ in range(n)]
    return [*paths, *ids, *numbers, "a" * 40, "ab" * 20, "abcdefghijklmnopqrstuvwxyz0123456789"]


@pytest.mark.parametrize("n,alphabet", [(3, "abcd"), (4, "ab01"), (3, "aB0")])
def test_moments_are_those_over_all_strings(n, alphabet):
    of = secrets.Encoding(alphabet)
    pairs, changes = [], []
    for t in itertools.product(alphabet, repeat=n):
        pairs.append(secrets.pairs_of_equals("".join(t)))
        groups = [of.group[c] for c in t]
        changes.append(sum(a != b for a, b in zip(groups, groups[1:], strict=False)))
    mean = n * (n - 1) / 2 / of.size
    assert np.mean(pairs) == pytest.approx(mean) and np.var(pairs) == pytest.approx(mean * (1 - 1 / of.size))
    q, m = of.turns, n - 1
    assert np.mean(changes) == pytest.approx(m * q) and np.var(changes) == pytest.approx(m * q * (1 - q) + 2 * (m - 1) * (of.turns2 - q * q))


def test_runs_are_an_exact_ratio():
    """Over all class sequences the ratio's mean in text is 1."""
    of = secrets.Encoding(secrets.ALPHABETS[8])
    kinds = {0: "a", 1: "A", 2: "0"}
    follows = {a: {b: secrets.FOLLOWS[a][b] / sum(secrets.FOLLOWS[a][x] for x in kinds) for b in kinds} for a in kinds}
    total = 0.0
    for t in itertools.product(kinds, repeat=6):
        chance = (1 / 3) * math.prod(follows[a][b] for a, b in zip(t, t[1:], strict=False))
        total += chance * math.exp(secrets.runs("".join(kinds[x] for x in t), of)[1])
    assert total == pytest.approx(1)


def test_chances_hold_for_random_tokens_and_evidence_for_text():
    rng = random.Random(5)
    failed = [secrets.evidence(k) == -math.inf for k in keys(rng, 3000)]
    assert np.mean(failed) < 0.03
    share = dict(zip(secrets.LOWER, secrets.LETTERS, strict=True))
    sides = [[c for c in share if (c in secrets.VOWELS) == v] for v in (False, True)]

    def word(n):  # the null hypothesis of an alphabet of one class
        side, out = rng.random() < 0.4, ""
        for _ in range(n):
            out += rng.choices(sides[side], [share[c] for c in sides[side]])[0]
            side ^= rng.random() < secrets.TURNS
        return out

    text = [secrets.evidence(word(n)) for n in SIZES for _ in range(500)]
    assert sum(x > 3 for x in text) / len(text) < math.exp(-3)
    assert max(secrets.battery(t) for t in names(rng, 2000) + other_tokens(rng, 300)) < 3


def control(tokens, share):
    """Weighed false-discovery control by trying every number of finds."""
    once = {t: (secrets.battery(t), secrets.weight(len(t))) for t in set(tokens)}
    total = sum(w for _, w in once.values())
    values = sorted((math.floor(100 * (x + math.log(w))) / 100 if x > -math.inf else -math.inf for x, w in once.values()), reverse=True)
    k = max((k for k in range(1, len(values) + 1) if values[k - 1] >= math.log(total / (k * share))), default=0)
    return values[k - 1] if k else math.inf, once


@pytest.mark.parametrize("n_keys,n_names", [(0, 60), (3, 400), (80, 80)])
def test_control_over_the_table(spark, n_keys, n_names):
    rng = random.Random(n_keys)
    tokens = [*keys(rng, n_keys), *names(rng, n_names), *other_tokens(rng, 5)]
    rows = [(i, f"see {t} and {t} ") for i, t in enumerate(tokens)] + [(None, None), (7, ""), (1, "see " + tokens[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    least, once = control(tokens, secrets.DISCOVERIES)
    found = [(r.doc_id, [tuple(s) for s in r.spans if s.kind == "random"]) for r in secrets.find_secrets(docs).collect()]
    text_of = {t: sum(1 for _ in re.finditer(re.escape(t), t)) for t in tokens}
    want = {t for t, (x, w) in once.items() if x > -math.inf and math.floor(100 * (x + math.log(w))) / 100 >= least and text_of[t]}
    seen = {tokens[i] for i, s in found if s and i is not None and i < len(tokens)}
    assert {t for t in seen if not secrets.base_spans(t)} == {t for t in want if not secrets.base_spans(t)}
    assert seen <= set(tokens[:n_keys])


@pytest.mark.parametrize("prefix", ["", "ghp_", "sk_live_", "key-"])
def test_planted_keys_are_found_with_and_without_prefix(spark, prefix):
    rng = random.Random(len(prefix))
    planted = [prefix + k for k in keys(rng, 300)]
    clean = [*names(rng, 300), *other_tokens(rng, 20)]
    docs = spark.createDataFrame([(i, f"uses {t} here") for i, t in enumerate([*planted, *clean])], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in secrets.find_secrets(docs).collect()}
    hit = [bool(got[i]) for i in range(300)]
    long = [h for h, t in zip(hit, planted, strict=True) if len(t) - len(prefix) >= 32]
    assert np.mean(hit) > 0.8 and np.mean(long) > 0.9
    assert all(got[i] == [(5, 5 + len(t))] for i, t in enumerate(planted) if got[i])
    assert sum(bool(got[i + 300]) for i in range(len(clean))) == 0
