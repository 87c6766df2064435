"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded
(shares of character classes and hashed byte pairs, then a learned ``tanh``
layer), gated attention learned from document labels weighs the passages, and
a logistic unit scores the weighted passage representation.

    h_k = tanh(x_k E)         a_k = softmax_k(w . (tanh(h_k V) * sigmoid(h_k U)))
    score = sigmoid(c . sum_k a_k h_k + b)

One scan of whole texts, no shuffle; the numpy model (about 20 000 weights,
whatever the input) travels in the task closure.  It is fitted by Adam on at
most ``train_docs`` labelled documents outside the held-out fold, on all passages
of each.

Defined results: null text = empty text, one passage of zeros; repeated rows are
scored each; null ids stay null; without both classes among the labels every
score is the label share (0.5 without any label); extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import fold, labelled_sample, mapped, texts

PASSAGE = 64
TRAIN_DOCS = 4000
THRESHOLD = 0.7
PAIRS = 256
HIDDEN, GATE = 32, 16

#: Classes of bytes whose shares a passage has as features (the rest is one more).
_CLASSES = (b"|", b"#*$%&<>", bytes(range(ord("A"), ord("Z") + 1)), bytes(range(ord("a"), ord("z") + 1)), b"!",
            b"0123456789", b".?", b",;:", b"/@=_", b" \t\x0b\x0c\r", b"\n", bytes(range(128, 256)))
_N_CLASSES = len(_CLASSES) + 1
_CODE = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CODE[list(_chars)] = _i
_SEP = np.zeros(256, bool)
_SEP[list(b" \t\n\x0b\x0c\r")] = True
N_FEATURES = _N_CLASSES + PAIRS + 3


def passages(text: bytes, size: int = PASSAGE) -> np.ndarray:
    """Features of every passage of ``size`` words, ``[passages, N_FEATURES]``."""
    raw = np.frombuffer(text, np.uint8)
    solid = ~_SEP[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros((1, N_FEATURES), np.float32)
    n = -(-len(starts) // size)
    cut = np.append(starts[::size], len(raw))
    cut[0] = 0
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(cut))
    classes = np.bincount(of * np.int32(_N_CLASSES) + _CODE[raw], minlength=n * _N_CLASSES).reshape(n, -1)
    pair = (raw[:-1].astype(np.uint32) * np.uint32(257) + raw[1:]) * np.uint32(2654435761) >> np.uint32(24)
    pairs = np.bincount(of[:-1] * np.int32(PAIRS) + pair.astype(np.int32), minlength=n * PAIRS).reshape(n, -1)
    words = np.diff(np.append(np.arange(0, len(starts), size), len(starts)))
    chars = np.diff(cut)
    distinct = (pairs > 0).sum(axis=1)
    extra = np.stack([chars / words / 10, words / size, distinct / np.minimum(chars, PAIRS)], axis=1)
    return np.concatenate([classes / chars[:, None], np.sqrt(pairs / chars[:, None]), extra], axis=1, dtype=np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    prior: float

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bags), self.prior)
        starts = np.cumsum([0] + [len(b) for b in bags])[:-1]
        x = ((np.concatenate(bags) - self.mean) * self.scale).astype(np.float32)
        return _forward(self.weights, x, starts)[0].astype(float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict, x: np.ndarray, starts: np.ndarray) -> tuple:
    lengths = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ w["E"])
    v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (v * u) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), lengths))
    a = e / np.repeat(np.add.reduceat(e, starts), lengths)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return _sigmoid(z @ w["c"] + w["b"]), h, v, u, a, z, lengths


def _gradients(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    p, h, v, u, a, z, lengths = _forward(w, x, starts)
    d = (p - y) / len(y)
    dz = np.repeat(d[:, None] * w["c"], lengths, axis=0)
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), lengths))
    dvu = de[:, None] * w["w"]
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    dh = a[:, None] * dz + dv @ w["V"].T + du @ w["U"].T
    return {"E": x.T @ (dh * (1 - h * h)), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": z.T @ d,
            "b": np.array([d.sum()])}


def fit_bags(bags: list[np.ndarray], labels: list[int], epochs: int = 12, batch: int = 64, rate: float = 3e-3,
             decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss of the bags; the order of ``bags`` and ``seed`` fix the result."""
    y = np.asarray(labels, float)
    prior = float(y.mean()) if len(y) else 0.5
    nothing = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, prior)
    if len(set(labels)) < 2:
        return nothing
    every = np.concatenate(bags)
    mean, spread = every.mean(axis=0), every.std(axis=0)
    scale = 1 / np.maximum(spread, 1e-2)
    bags = [((b - mean) * scale).astype(np.float32) for b in bags]
    rng = np.random.default_rng(seed)
    w = {"E": rng.normal(0, 0.05, (N_FEATURES, HIDDEN)), "V": rng.normal(0, 0.2, (HIDDEN, GATE)),
         "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE),
         "c": rng.normal(0, 0.2, HIDDEN), "b": np.array([np.log(prior / (1 - prior))])}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, s, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = [bags[k] for k in order[i:i + batch]]
            starts = np.cumsum([0] + [len(b) for b in own])[:-1]
            g = _gradients(w, np.concatenate(own), starts, y[order[i:i + batch]])
            step += 1
            for k in w:
                gk = g[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                s[k] = 0.999 * s[k] + 0.001 * gk * gk
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
                        ).astype(np.float32)
    return Model(mean, scale, w, prior)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, passage: int = PASSAGE) -> Model:
    """The model from a bounded sample of documents, all passages of each; passages
    are encoded on the executors (544 bytes a passage come back)."""
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [passages(t, passage).astype("<f2").tobytes() for t in texts(batch["text"])]
        return pa.record_batch([batch["doc_id"], batch["y"], pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, "quality", train_docs)
    got = mapped(sample, encode, "doc_id long, y int, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    return fit_bags([np.frombuffer(r.x, "<f2").reshape(-1, N_FEATURES).astype(np.float32) for r in got],
                    [r.y for r in got])


def score(docs: DataFrame, model: Model, passage: int = PASSAGE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted, n_passages``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = [passages(t, passage) for t in texts(batch["text"])]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), batch["held_out"],
                                pa.array(model.scores(bags), pa.float64()),
                                pa.array([len(b) for b in bags], pa.int64())],
                               ["doc_id", "held_out", "score", "n_passages"])

    rows = docs.select("doc_id", "text", (fold("doc_id") == 2).alias("held_out"))
    scored = mapped(rows, run, "doc_id long, held_out boolean, score double, n_passages long")
    return scored.select("doc_id", "held_out", "score",
                         (F.col("score") >= F.lit(threshold)).cast(T.IntegerType()).alias("predicted"), "n_passages")


def keep(docs: DataFrame, model: Model, passage: int = PASSAGE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of at least ``threshold``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores([passages(t, passage) for t in texts(batch["text"])])
        return batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return mapped(docs, run, docs.schema)
