"""Toxicity: non-negative positive-unlabelled learning (Kiryo et al., NeurIPS 2017).

The positives are confirmed toxic documents, the unlabelled ones any documents.
With class prior ``pi`` and logistic loss ``l`` the risk is

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

so the second part, whose true value cannot be negative, is never pushed below zero.
The prior is the share of toxic rows among the labelled rows outside the
held-out fold.

A text's features are its distinct words (lower case, outer punctuation off)
and their first 4, 5 and 6 characters, hashed to ``BUCKETS``.  A text's score is
a noisy-or over words: a long clean text does not drift towards toxic by the sum
of many small weights, one strong word suffices.

One scan of whole texts, no shuffle; the weights (1 MB) travel in the task
closure.  Fitted on at most ``positives`` and ``unlabelled`` documents.

Defined results: null text = empty text, whose score is the bias alone; repeated
rows are scored each; null ids stay null; without positives every score is 0, with
a single one the bias; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import fold, labelled_sample, mapped, sampled, texts

BUCKETS = 1 << 22
_MASK = BUCKETS - 1
N_KINDS = 4
POSITIVES, UNLABELLED = 1500, 4500
THRESHOLD = 0.3
#: Positives that hold a bucket of evidence: see ``support``.
LEAST, MOST_LEAST = 3, 6
#: Word shares below this do not add up, so that many words of a long text make no evidence; only
#: their mean counts, which orders texts that have nothing else.
FLOOR = 1e-3
_OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_buckets(word: str) -> tuple[int, int, int, int]:
    """Hash buckets of a word and of its first 4, 5 and 6 characters (the
    checksum's start value keeps the four kinds apart)."""
    return (crc32(word.encode(), 1) & _MASK, crc32(word[:4].encode(), 4) & _MASK,
            crc32(word[:5].encode(), 5) & _MASK, crc32(word[:6].encode(), 6) & _MASK)


def words(text: bytes) -> set[str]:
    """Distinct words: lower case, split on white space, outer punctuation off."""
    found = {w.strip(_OUTER) for w in set(text.decode("utf-8", "replace").lower().split())}
    found.discard("")
    return found


@dataclass(frozen=True)
class Model:
    """Weights by bucket (only buckets that enough positives hold), a word's and
    the text's bias; no text bias means that no positives were known."""
    weights: dict[int, float]
    word_bias: float
    text_bias: float | None

    def part(self, word: str) -> float:
        """A word's share of ``-log(1 - score)``; 0 for words without a known bucket."""
        a, b, c, d = word_buckets(word)
        w = self.weights
        if a in w or b in w or c in w or d in w:
            total = w.get(a, 0.0) + w.get(b, 0.0) + w.get(c, 0.0) + w.get(d, 0.0)
            return math.log1p(math.exp(min(30.0, self.word_bias + total)))
        return 0.0

    def scorer(self, remembered: int = 500_000):
        """``text -> score``, with a bounded memory of words."""
        memo: dict[str, tuple[str, float] | None] = {}
        base = None if self.text_bias is None else math.log1p(math.exp(self.text_bias))

        def score(text: bytes) -> float:
            if base is None:
                return 0.0
            raw = set(text.decode("utf-8", "replace").lower().split())
            if len(memo) + len(raw) > remembered:
                memo.clear()
            for token in [t for t in raw if t not in memo]:
                word = token.strip(_OUTER)
                part = self.part(word) if word else 0.0
                memo[token] = (word, part) if part else None
            parts = dict(filter(None, map(memo.__getitem__, raw))).values()
            small = [p for p in parts if p < FLOOR]
            return -math.expm1(-base - math.fsum(p for p in parts if p >= FLOOR) - math.fsum(small) / max(1, len(small)))
        return score


def _risk_gradients(bags: list[np.ndarray], w: np.ndarray, toxic: bool) -> tuple[float, np.ndarray]:
    """Mean loss of ``bags`` (bucket rows of words) under the label ``toxic`` and
    its gradients for the weights, the word bias (w[-2]) and the text bias (w[-1])."""
    starts = np.cumsum([0] + [len(b) for b in bags])
    rows = np.concatenate(bags)
    s = w[rows].sum(axis=1) + w[-2]
    up = np.logaddexp(0, s)
    total = np.concatenate([[0.0], np.cumsum(up)])
    q = total[starts[1:]] - total[starts[:-1]] + np.logaddexp(0, w[-1])  # -log(1 - score)
    if toxic:
        p = np.maximum(-np.expm1(-q), 1e-6)
        loss, d = -np.log(p), -(1 - p) / p
    else:
        loss, d = q, np.ones(len(bags))
    d = d / len(bags)
    each = np.repeat(d, np.diff(starts)) / (1 + np.exp(-s))
    g = np.bincount(rows.ravel(), np.repeat(each, rows.shape[1]), minlength=len(w))
    g[0] = 0.0  # bucket 0 of the compact numbering stands for "not known"
    g[-2], g[-1] = each.sum(), d.sum() / (1 + np.exp(-w[-1]))
    return float(loss.mean()), g


def support(positives: int) -> int:
    """How many of the sampled positives must hold a bucket before it counts: a
    twelfth of them, from ``LEAST`` to ``MOST_LEAST``; two where only two are known."""
    return max(2, min(positives, max(LEAST, min(MOST_LEAST, positives // 12))))


def fit_bags(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 150,
             rate: float = 0.15, decay: float = 0.04, least: int | None = None, batch: int = 750, seed: int = 11) -> Model:
    """Non-negative PU risk by Adam; ``positive``/``unlabelled`` hold a row of
    buckets per distinct word of a document.  A bucket counts when ``least``
    positive documents hold it (by default ``support`` of their number)."""
    if least is None:
        least = support(len(positive))
    known = np.zeros(BUCKETS, np.int32)
    for bag in positive:
        known[np.unique(bag)] += 1
    kept = known >= least
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model({}, 0.0, -4.0 if positive else None)
    number = np.zeros(BUCKETS, np.int32)
    number[kept] = np.arange(1, kept.sum() + 1)

    def compact(bag: np.ndarray) -> np.ndarray:
        rows = number[bag]
        return rows[rows.any(axis=1)]

    positive, unlabelled = [compact(b) for b in positive], [compact(b) for b in unlabelled]
    w = np.zeros(int(kept.sum()) + 3)
    w[-2], w[-1] = -8.0, -6.0
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(seed)
    batches = max(1, len(unlabelled) // batch)
    while step < steps:
        split = [np.array_split(rng.permutation(len(x)), batches) for x in (positive, unlabelled)]
        for ps, us in zip(*split, strict=True):
            if not len(ps) or not len(us):
                continue
            p, u = [positive[i] for i in ps], [unlabelled[i] for i in us]
            _, g_pp = _risk_gradients(p, w, True)
            r_pn, g_pn = _risk_gradients(p, w, False)
            r_un, g_un = _risk_gradients(u, w, False)
            # max(0, .): below zero the negative part has no gradient
            g = prior * g_pp + (g_un - prior * g_pn if r_un - prior * r_pn > 0 else 0)
            g[:-2] += decay / len(positive) * w[:-2]
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(dict(zip(np.flatnonzero(kept).tolist(), w[1:-2].tolist(), strict=True)), float(w[-2]), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        least: int | None = None) -> Model:
    """The model from bounded samples, in the order of a hash of the id; words
    are hashed on the executors. Buckets that fewer than ``least`` sampled positives
    hold (default: ``support``) are not known to the model."""
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.array([word_buckets(w) for w in sorted(words(t))], "<i4").tobytes() for t in texts(batch["text"])]
        return pa.record_batch([batch["doc_id"], pa.array(rows, pa.binary())], ["doc_id", "x"])

    def bags(sample: DataFrame) -> list[np.ndarray]:
        got = mapped(sample.select("doc_id", "text"), encode, "doc_id long, x binary").collect()
        got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
        return [np.frombuffer(r.x, "<i4").reshape(-1, N_KINDS) for r in got]

    toxic = labelled_sample(docs, labels, "toxic", positives, F.col("y") == 1)
    anyone = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    anyone = sampled(docs, anyone.orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled), unlabelled)
    share = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id") != 2))
             .agg(F.avg("toxic")).first()[0])
    return fit_bags(bags(toxic), bags(anyone), float(share or 0.0), least=least)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), batch["held_out"],
                                   pa.array([scorer(t) for t in texts(batch["text"])], pa.float64())],
                                  ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", "text", (fold("doc_id") == 2).alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score",
                         (F.col("score") >= F.lit(threshold)).cast(T.IntegerType()).alias("predicted"))
