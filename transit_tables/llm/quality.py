"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is counted into pairs of
neighbouring character classes and measures of repetition and word length, and
encoded by a learned layer. Gated attention weighs the passages; the weighted sum
gives the document's score. Only documents have labels; the weights are learned.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
#: Labelled documents of either label to learn from, at most: the training set's bound.
EACH_LABEL = 1500
#: Passages of a document to learn from, at most: longer ones give as many, evenly spaced. All passages are scored.
EACH_DOCUMENT = 64
ACCEPT = 0.7
#: Character classes: each string is one, other ASCII punctuation one, bytes from 128 one.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\f", "\n", ".,;:", "!?", "*", "#", "$", "%&", "|", "'\"()-")
N_CLASSES = len(CLASSES) + 2
PAIRS = N_CLASSES * N_CLASSES
WIDTH = PAIRS + 6
HIDDEN, GATE = 24, 16
CLASS_OF = np.full(256, N_CLASSES - 2, np.int64)
CLASS_OF[128:] = N_CLASSES - 1
for _i, _chars in enumerate(CLASSES):
    CLASS_OF[[ord(_c) for _c in _chars]] = _i


def features(text: str | None) -> np.ndarray:
    """A row for each passage; one row of zeros for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    n = -(-len(words) // PASSAGE)
    kind = CLASS_OF[np.frombuffer(data, np.uint8)]
    space = (kind == 3) | (kind == 4)
    begins = ~space & np.r_[True, space[:-1]]
    passage = np.maximum(np.cumsum(begins) - 1, 0) // PASSAGE
    pair = kind[:-1] * N_CLASSES + kind[1:]
    counts = np.bincount(passage[1:] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :PAIRS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    h = np.fromiter(map(hash, words), np.int64, len(words))
    size = np.fromiter(map(len, words), np.float64, len(words))
    own = np.arange(len(words)) // PASSAGE
    per = np.bincount(own, minlength=n)
    same = np.r_[False, h[1:] == h[:-1]]
    order = np.lexsort((h, own))
    h, o = h[order], own[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
    out[:, PAIRS] = np.bincount(own, same, n) / per
    out[:, PAIRS + 1] = np.bincount(o, first, n) / per
    out[:, PAIRS + 2] = np.log1p(np.bincount(own, size, n) / per)
    out[:, PAIRS + 3] = np.log1p(np.bincount(own, size > 20, n) / per)
    out[:, PAIRS + 4] = per / PASSAGE
    out[:, PAIRS + 5] = 1
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class AttentionModel:
    """Encoder E, gated attention (V, U, w) and classifier (c, b)."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        make = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": make(WIDTH, HIDDEN), "V": make(HIDDEN, GATE), "U": make(HIDDEN, GATE), "w": make(GATE, 1)[:, 0], "c": make(HIDDEN, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """x: passages of all bags; starts: where each bag begins."""
        p, sizes = self.p, np.diff(np.r_[starts, len(x)])
        bag = np.repeat(np.arange(len(starts)), sizes)
        h = np.tanh(x @ p["E"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}

    def gradient(self, x, starts, label) -> dict:
        p, f = self.p, self.forward(x, starts)
        d = (f["y"] - label) / len(label)
        dz = d[:, None] * p["c"]
        da = (dz[f["bag"]] * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01, seed: int = 1) -> None:
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                own = own[weight[own] > 0]
                x = np.concatenate([bags[k] for k in own]).astype(np.float64)
                starts = np.cumsum([0, *(len(bags[k]) for k in own[:-1])])
                step += 1
                for k, g in self.gradient(x, starts, labels[own]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (0.5 if epoch > epochs // 2 else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def _encoded(most: int):
    """Features of up to ``most`` passages of each text, evenly spaced."""

    def over(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            some = [x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(int)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in some], pa.binary())], names=["label", "passages"])

    return over


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each_label: int = EACH_LABEL, each_document: int = EACH_DOCUMENT):
    """A model learnt from up to ``each_label`` documents of either label, or the share of label 1 if only one occurs.

    The sample is taken by a hash of the id. Ids that are null or whose labels are
    null or contradict each other are left out. Of rows that repeat an id, one text is
    learnt from, that of the smallest hash. So the driver gets at most twice ``each_label``
    times ``each_document`` passages.
    """
    known = labels.where(f"`{id_col}` is not null").groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("top")).where("label = top and label in (0, 1)")
    sampled = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(each_label).select("id", "label") for y in (0, 1)]
    picked = sampled[0].unionByName(sampled[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    once = rows.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = once.select("label", "text").mapInArrow(_encoded(each_document), "label int, passages binary").collect()
    bags = [np.frombuffer(r.passages, np.float32).reshape(-1, WIDTH) for r in got]
    y = np.array([r.label for r in got], float)
    if len(set(y)) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    order = np.lexsort((np.array([b.sum() for b in bags]), y))  # collect() promises no order
    model = AttentionModel()
    model.fit([bags[i] for i in order], y[order])
    return model


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds a score from 0 to 1 to each row; all columns stay, but one named like ``out_col`` is replaced.

    Texts without words, empty or null, are scored as a single passage without characters.
    """
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[float] = []
            for i in range(0, len(texts), 256):
                bags = [features(t) for t in texts.iloc[i : i + 256]]
                starts = np.cumsum([0, *map(len, bags[:-1])])
                out += model.forward(np.concatenate(bags).astype(np.float64), starts)["y"].tolist()
            yield pd.Series(out, dtype="float64")

    if isinstance(model, float):
        return docs.withColumn(out_col, F.lit(model))
    return docs.withColumn(out_col, F.pandas_udf(scored, "double")(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; held_out is false for a null doc_id."""
    model = train(docs, labels.where(~held_out()))
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))
