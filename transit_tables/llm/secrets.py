"""Secret scans: fixed patterns, and a battery of randomness tests on other long tokens.

A token of 20 characters or more is read in the smallest encoding that holds it, as
it stands and without short leading parts such as ``ghp_``. Three tests look at its
symbols: chi-squared of their counts, runs of character classes, and the correlation
of neighbours. Each statistic has a distribution for symbols drawn at random and one for
text, which is the null hypothesis: letters as frequent as in words, in runs of one
class, or vowels and consonants that take turns in alphabets of one class. The ratio
of the two is the test's e-value. In text the choice within classes and their runs
are independent, so those two e-values are multiplied; the mean of that and of the
correlation's holds whatever their dependence. The token's e-value is 0 if a test
says that the symbols aren't random. It grows with the token's length.

All distinct tokens of the table then pass the e-value form of false-discovery
control, weighed by length: short tokens need the strongest evidence, and many
tokens need more than few. One number, the least evidence, comes of that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters that a token has at least.
LEAST = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Leading parts of a token that may be a fixed name.
PARTS = re.compile(r"(?:[A-Za-z0-9]{1,8}[_-])+")
WORDS = ("passw", "secret", "token", "api")
#: Encodings from small to large alphabets. Decimal numbers aren't tested.
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
ALPHABETS = (DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, LOWER.upper(), LOWER.upper() + "234567", DIGITS + LOWER, DIGITS + LOWER.upper(), LOWER.upper() + LOWER + DIGITS, LOWER.upper() + LOWER + DIGITS + "+/", LOWER.upper() + LOWER + DIGITS + "-_")
VOWELS = "aeiouAEIOU"
#: The null hypothesis: share of each letter from a to z in English text, in thousandths;
#: shares of lower case, capitals, digits and signs; for each of these, how often each follows it, in hundredths;
#: chance that a vowel follows a consonant or the other way round.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
CLASSES = (0.8, 0.1, 0.07, 0.03)
FOLLOWS = ((78, 14, 5, 3), (60, 34, 4, 2), (20, 15, 60, 5), (60, 20, 15, 5))
TURNS = 0.65
#: A token fails if the three tests together are so unlikely for random symbols.
FAILS = 0.01
#: Expected share of false ones among the tokens found.
DISCOVERIES = 0.05
#: Length from which a token's weight grows no more, steps of evidence for a factor of e, and steps beyond which more
#: evidence makes no difference (a factor of e to the 100th, while the control asks for less than that for any table).
WEIGHT, STEPS, ENOUGH = 64, 100, 10_000


def kind_of(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


class Encoding:
    """An alphabet with the moments of each statistic for random symbols and for text."""

    def __init__(self, alphabet: str):
        self.size, self.value = len(alphabet), {c: i for i, c in enumerate(alphabet)}
        self.kind = {c: kind_of(c) for c in alphabet}
        own = {k: [c for c in alphabet if self.kind[c] == k] for k in sorted(set(self.kind.values()))}
        share = {k: CLASSES[k] / sum(CLASSES[x] for x in own) for k in own}
        raw = {c: LETTERS[ord(c.lower()) - 97] / 1000 if k < 2 else 1.0 for c, k in self.kind.items()}
        within = {k: [raw[c] / sum(raw[x] for x in chars) for c in chars] for k, chars in own.items()}
        #: Of each class: its size, and the sums of squares and cubes of its characters' shares in text.
        self.classes = {k: (len(p), sum(x**2 for x in p), sum(x**3 for x in p)) for k, p in within.items()}
        single = len(own) == 1
        self.group = {c: c in VOWELS if single else k for c, k in self.kind.items()}
        part = {g: n / self.size for g, n in Counter(self.group.values()).items()}
        self.turns, self.turns2 = 1 - sum(x**2 for x in part.values()), sum(x * (1 - x) ** 2 for x in part.values())
        follows = {a: {b: TURNS if a != b else 1 - TURNS for b in part} if single else {b: FOLLOWS[a][b] for b in part} for a in part}
        #: Chance of a change in text, and for each pair of neighbours' groups the log of its odds, random to text.
        self.text_turns = sum(part[a] * (1 - x[a] / sum(x.values())) for a, x in follows.items())
        self.odds = {(a, b): math.log(part[b] * sum(x.values()) / x[b]) for a, x in follows.items() for b in part}
        self.mean, self.var = (self.size - 1) / 2, (self.size**2 - 1) / 12
        self.text_r = 0.0  # in an alphabet of one class, neighbours in text are taken as unrelated
        if not single:
            middle = {k: sum(self.value[c] * p for c, p in zip(own[k], within[k], strict=True)) for k in own}
            mean = sum(share[k] * middle[k] for k in own)
            between = sum(share[k] * (middle[k] - mean) ** 2 for k in own)
            lasting = max(0.0, 1 - self.text_turns / (1 - sum(x**2 for x in share.values())))
            self.text_r = ((mean - self.mean) ** 2 + lasting * between) / self.var


@cache
def encodings() -> tuple[Encoding, ...]:
    return tuple(map(Encoding, ALPHABETS))


def _log_normal(x: float, mean: float, var: float) -> float:
    return -((x - mean) ** 2) / (2 * var) - 0.5 * math.log(var)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def pairs_of_equals(token: str) -> int:
    return sum(x * (x - 1) // 2 for x in Counter(token).values())


def chi_squared(token: str, of: Encoding) -> tuple[float, float]:
    """(chance of counts so uneven if random, log e-value).

    Chi-squared is k / n * (n + 2c) - n for c pairs of equal symbols, so c serves for it.
    The chance is over the whole alphabet; the e-value is of the counts within each
    class, given how many characters the class has, so it is independent of the classes' runs.
    """
    n, k = len(token), of.size
    c = pairs_of_equals(token)
    mean = n * (n - 1) / 2 / k
    var = text_mean = text_var = even = 0.0
    for kind, m in Counter(map(of.kind.__getitem__, token)).items():
        size, two, three = of.classes[kind]
        pairs = m * (m - 1) / 2
        even, var = even + pairs / size, var + pairs / size * (1 - 1 / size)
        text_mean, text_var = text_mean + pairs * two, text_var + pairs * two * (1 - two) + m * (m - 1) * (m - 2) * (three - two * two)
    ratio = _log_normal(c, even, var) - _log_normal(c, text_mean, text_var) if var > 0 and text_var > 0 else 0.0
    return _tail((c - 0.5 - mean) / math.sqrt(mean * (1 - 1 / k))), ratio


def runs(token: str, of: Encoding) -> tuple[float, float]:
    """(chance of a number of runs of classes so near that of text if random, log e-value of the runs' classes and lengths)."""
    n = len(token) - 1
    groups = [of.group[c] for c in token]
    pairs = Counter(zip(groups, groups[1:], strict=False))
    changes = sum(k for (a, b), k in pairs.items() if a != b)
    q = of.turns
    var = n * q * (1 - q) + 2 * (n - 1) * (of.turns2 - q * q)
    return _tail(((n * q - changes) * (1 if of.text_turns < q else -1) - 0.5) / math.sqrt(var)), sum(k * of.odds[x] for x, k in pairs.items())


def serial(token: str, of: Encoding) -> tuple[float, float]:
    """(chance of a correlation of neighbours so strong if random, log e-value)."""
    n = len(token) - 1
    values = [of.value[c] - of.mean for c in token]
    r = sum(x * y for x, y in zip(values, values[1:], strict=False)) / of.var / n
    return _tail(r * math.sqrt(n)), _log_normal(r, 0, 1 / n) - _log_normal(r, of.text_r, 1 / n)


def evidence(token: str) -> float:
    """Log of the e-value of one reading of a token; minus infinity if it isn't random or no encoding holds it."""
    of = next((x for x in encodings() if all(c in x.value for c in token)), None)
    if of is None or len(token) < LEAST or of.size == len(DIGITS):
        return -math.inf
    (p, counts), (q, changes), (r, neighbours) = (test(token, of) for test in (chi_squared, runs, serial))
    if 3 * min(p, q, r) < FAILS:
        return -math.inf
    return _log_mean([counts + changes, neighbours])


def _log_mean(logs: list[float]) -> float:
    top = max(logs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in logs) / len(logs))


def battery(token: str) -> float:
    """Log of the token's e-value: the mean over its readings, whole and without leading short parts."""
    token = token.rstrip("=")
    start = PARTS.match(token)
    readings = [token] + ([token[start.end() :]] if start and len(token) - start.end() >= LEAST else [])
    return _log_mean([evidence(x) for x in readings])


def weight(size: int) -> int:
    return min(size, WEIGHT)


def step(log_e: float, size: int) -> int:
    """Weighed evidence in whole steps, rounded down, so that what it stands for is an e-value still."""
    return max(-ENOUGH, min(ENOUGH, math.floor(STEPS * (log_e + math.log(weight(size))))))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if any(w in (low := text.lower()) for w in WORDS[:3]) or "api" in low and "key" in low:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def free_tokens(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans of tokens that overlap no span of the fixed patterns."""
    taken = bytearray(len(text)) if base else b""
    for _, s, e in base:
        taken[s:e] = b"\1" * (e - s)
    return [m.span() for m in TOKEN.finditer(text) if not base or taken.find(1, *m.span()) < 0]


def scan(text: str | None, least: float = math.inf) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS; code points, end exclusive. ``least``: of ``least_evidence``."""
    text = text or ""
    found = base_spans(text)
    if least < math.inf:
        tested = ((s, e, battery(text[s:e])) for s, e in free_tokens(text, found))
        found += [("random", s, e) for s, e, x in tested if x > -math.inf and step(x, e - s) >= least]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _tested(batches):
    """A row (token, size, steps) for each token that is tested; steps is null if its e-value is 0."""
    for batch in batches:
        token, size, steps = [], [], []
        for text in batch.column(0).to_pylist():
            for s, e in free_tokens(text or "", base_spans(text or "")):
                x = battery(text[s:e])
                token.append(xxhash.xxh3_64_intdigest(text[s:e]) - (1 << 63))
                size.append(e - s)
                steps.append(step(x, e - s) if x > -math.inf else None)
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(size, pa.int64()), pa.array(steps, pa.int64())], names=["token", "size", "steps"])


def least_evidence(docs: DataFrame, text_col: str = "text", share: float = DISCOVERIES) -> float:
    """The weighed evidence in steps that a random token needs, so that an expected ``share`` of those found is false at most.

    Over all distinct tokens of the table: the most tokens k, each with an e-value times
    its weight of at least (sum of weights) / (k * share). Infinite if there are none.
    The driver gets a count for each step of evidence, at most twice ``ENOUGH`` rows, not the tokens.
    """
    tested = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_tested, "token long, size long, steps long")
    once = tested.groupBy("token").agg(F.max("size").alias("size"), F.max("steps").alias("steps"))
    counted = once.groupBy("steps").agg(F.count("*").alias("n"), F.sum(F.least("size", F.lit(WEIGHT))).alias("weights")).collect()
    total, k, least = sum(r.weights for r in counted), 0, math.inf
    for r in sorted((r for r in counted if r.steps is not None), key=lambda r: -r.steps):
        k += r.n
        if r.steps >= STEPS * math.log(total / (k * share)):
            least = r.steps
    return least


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = DISCOVERIES) -> DataFrame:
    """One row (id, spans) for each row; null and empty texts have no spans.

    Ids may be null or repeat; other columns are ignored. A random token never
    overlaps a span of the fixed patterns; those may overlap each other. Equal tokens
    count once in the control of false ones, and are found everywhere or nowhere.
    """
    least = least_evidence(docs, text_col, share)

    def over(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan(t, least)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(over, f"id {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def mask(text: str | None, least: float = math.inf) -> str | None:
    """The text with each secret replaced by its kind in brackets; of overlapping ones by the first's."""
    done, parts = 0, []
    for kind, s, e in scan(text, least):
        if e > done:
            parts += [text[done:s], f"[{kind}]"] if s >= done else []
            done = e
    return "".join(parts) + text[done:] if done else text


def redact(docs: DataFrame, text_col: str = "text", share: float = DISCOVERIES) -> DataFrame:
    """The rows with the secrets in their text masked; a null text stays null, and all other columns stay."""
    least = least_evidence(docs, text_col, share)

    def over(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            masked = pa.array([mask(t, least) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([masked if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(over, docs.schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    text = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
