"""Quality rules: a linear-chain conditional random field over the lines of a
document marks each line content or boilerplate; the share of words in content
lines decides whether the document stays.

Lines are the ``\\n``-split parts with a word; words are ``[^\\x20\\x09-\\x0D]+``.
One scan of whole texts, no shuffle: line features are counted with numpy over
the bytes of an Arrow batch, Viterbi decoding runs per document.

The field is fitted (numpy, exact gradients by forward-backward) from at most
``train_docs`` labelled documents outside the held-out fold, on all lines of
each. Only documents are labelled, so line labels are found by hard EM (``fit_chains``):
lines of good documents that recur in several documents start as boilerplate, then
Viterbi under the document's label as a constraint and fitting take turns.

Defined results: null text = empty text; a document without words has no line,
``content_share`` 0 and fails the base rule; rows repeat as given; null ids stay
null; without usable labels (none, or one class) the field falls back to fixed
weights (``FALLBACK``); extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratelens.llm.common import SEPARATORS, labelled_sample, mapped, texts, window_hashes, word_hashes

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
TRAIN_DOCS = 1500
KEEP_SHARE = 0.5
BOILERPLATE, CONTENT = 0, 1

#: Line features, in the order of the weight rows.
FEATURES = ("bias", "few_words", "long_words", "symbols", "bars", "upper", "exclamations", "digits",
            "stops", "commas", "repeated_line", "repeated_words", "urls")
N_FEATURES = len(FEATURES)
#: Different neighbours and words of a line of boilerplate; turns of the training; pulls tried towards a document's label.
RECURRING, RECUR_WORDS = 3, 4
TURNS = 4
PULLS = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)


@dataclass(frozen=True)
class Field:
    """``emission[f, label]`` and ``transition[from, to]`` weights."""
    emission: np.ndarray
    transition: np.ndarray


#: Used where there are no labels to learn from: symbols, bars, capitals,
#: exclamation marks and repeated lines speak for boilerplate.
_LEAN = np.array([-1.5, 0.5, 0.0, 30.0, 30.0, 4.0, 20.0, 2.0, 0.0, 0.0, 1.5, 2.0, 1.0])
FALLBACK = Field(np.stack([_LEAN, np.zeros(N_FEATURES)], axis=1), np.array([[0.5, -0.5], [-0.5, 0.5]]))


#: Classes of bytes; a byte is of one class, the last counts all others.
_CLASSES = (b" \t\n\x0b\x0c\r", b"|", b"#*$%&<>", bytes(range(ord("A"), ord("Z") + 1)), b"!", b"0123456789", b".?",
            b",;:", b"/@=_")
_OTHER = len(_CLASSES)
_CODE = np.full(256, _OTHER, np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CODE[list(_chars)] = _i


def line_table(text: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of one text (``hashes``: of its words): words per line with a word,
    features of those lines, symbols of the text, and lines equal to an earlier line."""
    if not len(hashes):
        symbols = _CODE[np.frombuffer(text, np.uint8)]
        return np.empty(0, np.int64), np.empty((0, N_FEATURES)), int(((symbols == 1) | (symbols == 2)).sum()), 0
    code = _CODE[np.frombuffer(text, np.uint8)]
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    line_of = np.repeat(np.arange(len(lines), dtype=np.int32), np.append(sizes[:-1] + 1, sizes[-1]))
    counts = np.bincount(line_of * np.int32(_OTHER + 1) + code,
                         minlength=len(lines) * (_OTHER + 1)).reshape(len(lines), -1)
    first = code != 0
    first[1:] &= code[:-1] == 0
    word_line = line_of[first]
    words = np.bincount(word_line, minlength=len(lines))
    has = words > 0
    twice = np.zeros(len(hashes))
    twice[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
    doubled = np.bincount(word_line, twice, minlength=len(lines))[has]
    n, counts = words[has], counts[has].astype(float)
    chars = counts[:, 1:].sum(axis=1)
    seen: set[bytes] = set()
    repeated = np.zeros(len(n))
    for i, k in enumerate(np.flatnonzero(has).tolist()):
        repeated[i] = lines[k] in seen
        seen.add(lines[k])
    _, bar, symbol, upper, exclaim, digit, stop, comma, url, _ = counts.T / chars
    features = np.stack([np.ones(len(n)), 1 / n, chars / n / 10, symbol, bar, upper, exclaim, digit, stop, comma,
                         repeated, doubled / n, url], axis=1)
    total = np.bincount(code, minlength=3)
    return n, features, int(total[1] + total[2]), len(n) - len(seen)


def repeat_words(hashes: np.ndarray, size: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``size`` words found at least twice."""
    found = window_hashes(hashes, size)
    order = np.argsort(found)
    same = found[order[1:]] == found[order[:-1]]
    if not same.any():
        return 0
    again = np.union1d(order[1:][same], order[:-1][same])
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def viterbi(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best label sequence of a two-label chain (``scores[line, label]``);
    ties go to boilerplate (label 0)."""
    n = len(scores)
    if not n:
        return np.empty(0, np.int64)
    (t00, t01), (t10, t11) = transition.tolist()
    best0, best1 = scores[0].tolist()
    back = []
    for e0, e1 in scores[1:].tolist():
        a, b, c, d = best0 + t00, best1 + t10, best0 + t01, best1 + t11
        back.append((b > a, d > c))
        best0, best1 = max(a, b) + e0, max(c, d) + e1
    out = np.empty(n, np.int64)
    out[-1] = label = int(best1 > best0)
    for i in range(n - 2, -1, -1):
        out[i] = label = int(back[i][label])
    return out


def fit_field(chains: list[tuple[np.ndarray, int | np.ndarray]], rounds: int = 120, rate: float = 0.2,
              decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood of ``chains`` (line features, and the label of all
    its lines or of each) by Adam on the exact gradient. Whole chains run side by side, line
    by line, the longest first; lines are laid out by their place, without padding."""
    chains = sorted((c for c in chains if len(c[0])), key=lambda c: -len(c[0]))
    marks = [np.broadcast_to(np.asarray(y, np.int64), len(x)) for x, y in chains]
    if len({int(y) for m in marks for y in np.unique(m)}) < 2:
        return FALLBACK
    lengths = np.array([len(x) for x, _ in chains])
    # a chain weighs by the label of most of its lines
    whole = np.array([int(2 * m.sum() >= len(m)) for m in marks])
    if len(set(whole.tolist())) < 2:
        whole = np.array([int(m.max()) for m in marks])
    longest = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(longest))  # chains with a line at that place
    start = np.append(0, np.cumsum(alive))
    own = np.concatenate([np.arange(k) for k in alive])
    place = np.repeat(np.arange(longest), alive)
    data = np.concatenate([x for x, _ in chains])[(np.cumsum(lengths) - lengths)[own] + place]
    later = np.arange(start[1], len(data))
    before = start[place[later] - 1] + own[later]
    last = start[lengths - 1] + np.arange(len(chains))
    # features of equal spread; the weights are scaled back at the end
    spread = data.std(axis=0)
    spread[spread < 1e-9] = 1.0
    data /= spread
    # the rarer kind of chain weighs as much as the other
    part = min(max(whole.mean(), 1e-9), 1 - 1e-9)
    weight = np.where(whole == 1, 0.5 / part, 0.5 / (1 - part))[own]
    label = np.concatenate(marks)[(np.cumsum(lengths) - lengths)[own] + place]
    total = float(weight.sum())
    emission, transition = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emission, transition)]
    gold = np.eye(2)[label]
    hit = np.bincount(label[before] * 2 + label[later], weight[later], minlength=4).reshape(2, 2)
    for step in range(1, rounds + 1):
        s = data @ emission
        alpha = s.copy()
        beta = np.zeros_like(s)
        for t in range(1, longest):
            a = alpha[start[t - 1]:start[t - 1] + alive[t]]
            alpha[start[t]:start[t + 1]] += np.logaddexp(a[:, :1] + transition[0], a[:, 1:] + transition[1])
        for t in range(longest - 2, -1, -1):
            b = s[start[t + 1]:start[t + 2]] + beta[start[t + 1]:start[t + 2]]
            beta[start[t]:start[t] + alive[t + 1]] = np.logaddexp(b[:, :1] + transition[:, 0], b[:, 1:] + transition[:, 1])
        log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])[own][:, None]
        node = np.exp(alpha + beta - log_z)
        pair = np.exp(alpha[before][:, :, None] + transition + (s + beta - log_z)[later][:, None, :])
        g_emission = data.T @ ((gold - node) * weight[:, None]) / total
        g_transition = (hit - np.einsum("nij,n->ij", pair, weight[later])) / total
        for p, g, m in ((emission, g_emission, state[0]), (transition, g_transition, state[1])):
            g = g - decay * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p += rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)
    return Field(emission / spread[:, None], transition)


@dataclass(frozen=True)
class Chain:
    """A training document: its lines' features, words and hashes, and its own label."""
    x: np.ndarray
    words: np.ndarray
    lines: np.ndarray
    label: int


def constrained(chain: Chain, field: Field, keep_share: float = KEEP_SHARE) -> np.ndarray:
    """The best line labels under which the document is judged as its label says: Viterbi with
    the least pull (from ``PULLS``) towards the label that suffices."""
    scores = chain.x @ field.emission
    for pull in PULLS:
        moved = scores.copy()
        moved[:, chain.label] += pull
        marks = viterbi(moved, field.transition)
        share = chain.words[marks == CONTENT].sum() / max(1, chain.words.sum())
        # with a margin: half way to the whole document
        if share >= (1 + keep_share) / 2 if chain.label else share <= keep_share / 2:
            return marks
    return np.full(len(chain.x), chain.label)


def first_marks(chains: list[Chain], recurring: int = RECURRING) -> list[np.ndarray]:
    """Line labels to start from: the document's label, but lines of good documents that recur
    among ``recurring`` different neighbours (copies of a document repeat the neighbours, too;
    lines below ``RECUR_WORDS`` words recur by chance) are boilerplate where the rest still keeps the document."""
    before: dict[int, set[int]] = {}
    after: dict[int, set[int]] = {}
    for c in chains:
        lines = c.lines.tolist()
        for h, p, n in zip(lines, [0, *lines], [*lines[1:], 0]):
            before.setdefault(h, set()).add(p)
            after.setdefault(h, set()).add(n)
    out = []
    for c in chains:
        marks = np.full(len(c.x), c.label)
        if c.label == CONTENT:
            often = np.array([max(len(before[h]), len(after[h])) >= recurring for h in c.lines.tolist()], bool) & (c.words >= RECUR_WORDS)
            if c.words[~often].sum() >= KEEP_SHARE * c.words.sum():
                marks[often] = BOILERPLATE
        out.append(marks)
    return out


def fit_chains(chains: list[Chain], turns: int = TURNS) -> Field:
    """Hard EM: the field is fitted to line labels, and the lines are labelled again by Viterbi
    under their document's label as a constraint, ``turns`` times or until no label changes. So
    chains change label inside, and transitions are learned from such changes."""
    chains = [c for c in chains if len(c.x)]
    if len({c.label for c in chains}) < 2:
        return FALLBACK
    marks = first_marks(chains)
    field = fit_field([(c.x, m) for c, m in zip(chains, marks, strict=True)])
    for _ in range(turns):
        new = [constrained(c, field) for c in chains]
        if all((a == b).all() for a, b in zip(marks, new, strict=True)):
            break
        marks = new
        field = fit_field([(c.x, m) for c, m in zip(chains, marks, strict=True)])
    return field


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """The field from a bounded sample of labelled documents, all their lines
    (features are made on the executors; 64 bytes a line come back)."""
    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in texts(batch["text"]):
            n, x, _, _ = line_table(t, word_hashes(t.split()))
            lines = word_hashes([line for line in t.split(b"\n") if line.strip(SEPARATORS)])
            rows.append((x.astype("<f4").tobytes(), n.astype("<i4").tobytes(), lines.astype("<u8").tobytes()))
        return pa.record_batch([batch["doc_id"], batch["y"], *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))],
                               ["doc_id", "y", "x", "n", "h"])

    sample = labelled_sample(docs, labels, "quality", train_docs)
    got = mapped(sample, features, "doc_id long, y int, x binary, n binary, h binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    return fit_chains([Chain(np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES).astype(float), np.frombuffer(r.n, "<i4"),
                             np.frombuffer(r.h, "<u8"), r.y) for r in got])


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double")


def judge_text(text: bytes, field: Field, keep_share: float = KEEP_SHARE) -> tuple:
    words = text.split()
    n = len(words)
    hashes = word_hashes(words)
    per_line, x, symbols, dup_lines = line_table(text, hashes)
    repeats = repeat_words(hashes)
    chars = sum(map(len, words))
    raw = np.frombuffer(text, np.uint8)
    chars -= int(((raw & 0xC0) == 0x80).sum())  # UTF-8 continuation bytes are no code points
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    marks = viterbi(x @ field.emission, field.transition)
    share = float(per_line[marks == CONTENT].sum() / n) if n else 0.0
    return (n, chars, symbols, dup_lines, repeats, failed, not failed and share >= keep_share,
            len(marks), int((marks == CONTENT).sum()), share)


def judge(docs: DataFrame, field: Field, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Per row of ``docs``: the base counts, the chain's verdict and ``kept``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge_text(t, field, keep_share) for t in texts(batch["text"])]
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), *columns],
                               [c.split()[0] for c in SCHEMA.split(", ")])

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)


def keep(docs: DataFrame, field: Field, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep (one scan, no join)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([judge_text(t, field, keep_share)[6] for t in texts(batch["text"])], pa.bool_()))

    return mapped(docs, run, docs.schema)
