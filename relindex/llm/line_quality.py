"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. Its features are those of the
line itself and of the lines before and after it (byte classes, words, doubled
signs, repeated words, lines seen before); transitions tie neighbours together. A document's
quality is the mean of its lines' forward-backward marginals, weighted by their
length, through a logistic curve fitted on the same training rows.

Labels are given for documents only. All lines of a good document are good; the
lines of a bad one start as bad and are then decided anew by the field itself,
where the worst line of a bad document always stays bad (multiple-instance
learning).

The field is trained on at most ``SAMPLE_ROWS`` labelled documents of each label
(the least by the hash of their id, texts up to ``SAMPLE_BYTES`` bytes); their
features are computed on the executors. Scoring reads every text whole in one
narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, texts

#: Documents of each label that the field is trained on at most, and the longest text among them.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 20_000
#: Training: gradient steps in each round, rounds of labelling, ridge.
STEPS, ROUNDS, RIDGE = 150, 3, 1e-3

# classes of bytes
_LOWER, _UPPER, _DIGIT, _BLANK, _STOP, _SIGN, _HIGH = range(7)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[ord("a"):ord("z") + 1] = _LOWER
_CLASS[ord("A"):ord("Z") + 1] = _UPPER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _BLANK
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_CLASS[0x80:] = _HIGH
#: Features of one line, and with both neighbours, the place and the bias.
OWN = 18
WIDTH = 3 * OWN + 4


def line_features(rows: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, one after the other; bytes of each line; lines of each text). A text has at least one line, which may be empty."""
    raw = [(t or "").encode("utf-8") for t in rows]
    lines = np.array([r.count(b"\n") + 1 for r in raw], dtype=np.int64)
    a = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    end = np.flatnonzero(a == 0x0A)
    start = np.concatenate([[0], end[:-1] + 1])
    size = (end - start).astype(np.float64)
    kind = _CLASS[a]

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), start).astype(np.float64)  # the line feed itself is a blank

    blank = kind == _BLANK
    sign = (kind == _SIGN) | (kind == _STOP)
    before = np.concatenate([[True], blank[:-1]])
    word = per_line(~blank & before)
    doubled = sign.copy()
    doubled[1:] &= sign[:-1]
    doubled[0] = False
    after_sign = blank & np.concatenate([[False], (kind == _SIGN)[:-1]])  # a word that ends in a sign
    lone = (kind == _SIGN) & before & np.concatenate([blank[1:], [True]])  # a sign that stands alone
    count = [per_line(kind == k) for k in (_LOWER, _UPPER, _DIGIT, _STOP, _SIGN, _HIGH)]
    n, w = np.maximum(size, 1.0), np.maximum(word, 1.0)
    seen, twice, same = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
    j = 0
    for r in raw:
        had: set[bytes] = set()
        for line in r.split(b"\n"):
            if line in had:
                seen[j] = 1.0
            had.add(line)
            words = line.split()
            twice[j] = sum(map(eq, words, words[1:]))
            same[j] = len(words) - len(set(words))
            j += 1
    f = np.stack([
        *(c / n for c in count), per_line(doubled) / w, per_line(after_sign) / w, per_line(lone) / w,
        np.log1p(size) / 4, np.log1p(word) / 4, np.minimum(n / w, 30) / 10, seen, twice / w, same / w,
        (count[1] > 0.4 * n).astype(float), (size == 0).astype(float), (word == 1).astype(float)], axis=1)
    first = np.zeros(len(size), dtype=bool)
    first[np.cumsum(lines)[:-1]] = True
    first[0] = True
    last = np.append(first[1:], True)
    up, down = np.roll(f, 1, axis=0), np.roll(f, -1, axis=0)
    up[first], down[last] = 0.0, 0.0
    return np.column_stack([f, up, down, first, last, first & last, np.ones(len(size))]), size, lines


class Chains:
    """Lines of many documents, taken step by step over all documents at once, longest first."""

    def __init__(self, lines: np.ndarray):
        ends = np.cumsum(lines)
        order = np.argsort(-lines, kind="stable")
        begin, size = (ends - lines)[order], lines[order]
        top = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(top), side="left")  # documents with more than k lines
        self.steps = [begin[:m] + k for k, m in enumerate(live.tolist())]

    def marginals(self, score: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(bad) of every line, the summed probabilities of all neighbouring pairs of labels, and of the first labels.

        ``score``: log odds of bad of every line; ``trans[a, b]``, ``start[a]``: weights of labels (0 good, 1 bad).
        """
        e = np.column_stack([np.zeros(len(score)), score])
        a, b = np.empty_like(e), np.zeros_like(e)
        for k, rows in enumerate(self.steps):
            if k == 0:
                x = start + e[rows]
            else:
                p = a[self.steps[k - 1][:len(rows)]]
                x = np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1]) + e[rows]
            a[rows] = x - x.max(1, keepdims=True)
        pairs = np.zeros((2, 2))
        for k in range(len(self.steps) - 1, 0, -1):
            rows = self.steps[k]
            above = self.steps[k - 1][:len(rows)]
            nxt = e[rows] + b[rows]
            y = np.stack([np.logaddexp(trans[i, 0] + nxt[:, 0], trans[i, 1] + nxt[:, 1]) for i in (0, 1)], axis=1)
            b[above] = y - y.max(1, keepdims=True)
            j = a[above][:, :, None] + trans + nxt[:, None, :]
            j = np.exp(j - j.max((1, 2), keepdims=True))
            pairs += (j / j.sum((1, 2), keepdims=True)).sum(0)
        s = a + b
        p = 1.0 / (1.0 + np.exp(np.clip(s[:, 0] - s[:, 1], -700, 700)))
        first = p[self.steps[0]].sum() if self.steps else 0.0
        return p, pairs, np.array([len(self.steps[0]) - first if self.steps else 0.0, first])

    def pairs_of(self, labels: np.ndarray) -> np.ndarray:
        out = np.zeros((2, 2))
        for k in range(1, len(self.steps)):
            rows = self.steps[k]
            np.add.at(out, (labels[self.steps[k - 1][:len(rows)]], labels[rows]), 1)
        return out


class Field:
    """Weights of the field, scaling of the features, and the curve from mean marginals to quality."""

    def __init__(self, shift, scale, w, trans, start, curve):
        self.shift, self.scale, self.w, self.trans, self.start, self.curve = shift, scale, w, trans, start, curve

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.shift) / self.scale, -6, 6)

    def bad_lines(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """P(bad) of every line, by forward-backward."""
        return Chains(lines).marginals(self.scaled(x) @ self.w, self.trans, self.start)[0]

    def quality(self, bad: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """P(good) of every document: the length-weighted mean of its lines, through the curve."""
        a, b = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(a * _logit(_mean_good(bad, size, lines)) + b, -700, 700)))


def _mean_good(bad, size, lines):
    weight, at = np.maximum(size, 1.0), np.concatenate([[0], np.cumsum(lines)[:-1]])
    return np.add.reduceat((1.0 - bad) * weight, at) / np.add.reduceat(weight, at)


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _curve(x: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by Newton's method with a little ridge."""
    t = np.array([1.0, 0.0])
    m = np.column_stack([x, np.ones(len(x))])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(m @ t, -30, 30)))
        g = m.T @ (mass * (y - p)) - 1e-2 * (t - [1.0, 0.0])
        h = (m * (mass * p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        t = t + np.clip(step, -1, 1)
        t[0] = max(t[0], 0.05)
    return float(t[0]), float(t[1])


def train_field(x: np.ndarray, size: np.ndarray, lines: np.ndarray, good: np.ndarray, mass: np.ndarray) -> Field:
    """The field of documents with ``lines`` lines each (features ``x``, bytes ``size``) that are ``good``
    (1) or not (0); ``mass`` weighs documents for the curve. Deterministic."""
    scale = x.std(0)
    f = Field(x.mean(0), np.where(scale > 1e-9, scale, 1.0), np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(2), (1.0, 0.0))
    f.shift[-1], f.scale[-1] = 0.0, 1.0
    chains, z = Chains(lines), f.scaled(x)
    owner = np.repeat(np.arange(len(lines)), lines)
    bad_doc = good[owner] == 0
    labels = bad_doc.astype(np.int64)
    # both kinds of documents count alike, whatever their share of the lines is
    n = len(z)
    for _ in range(ROUNDS):
        goal, first = chains.pairs_of(labels), np.bincount(labels[chains.steps[0]], minlength=2)
        m1, m2 = [np.zeros_like(v) for v in (f.w, f.trans, f.start)], [np.zeros_like(v) for v in (f.w, f.trans, f.start)]
        for k in range(1, STEPS + 1):  # Adam
            p, pairs, begin = chains.marginals(z @ f.w, f.trans, f.start)
            grads = [z.T @ (labels - p) / n - RIDGE * f.w, (goal - pairs) / n - RIDGE * f.trans, (first - begin) / n - RIDGE * f.start]
            for v, g, a, b in zip((f.w, f.trans, f.start), grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                v += 0.1 * (a / (1 - 0.9 ** k)) / (np.sqrt(b / (1 - 0.99 ** k)) + 1e-8)
        p = chains.marginals(z @ f.w, f.trans, f.start)[0]
        labels = (bad_doc & (p >= 0.5)).astype(np.int64)
        worst = np.lexsort((p, owner))[np.cumsum(lines) - 1]
        labels[worst[good == 0]] = 1
    f.curve = _curve(_logit(_mean_good(p, size, lines)), good.astype(float), mass)
    return f


def sample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS,
           max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(good, text): at most ``rows`` labelled documents of each label. Ids whose labels differ are left out."""
    one = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
           .agg(F.min(label).alias("good"), F.max(label).alias("most")).where("good = most").select("k", "good"))
    small = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length(F.coalesce("t", F.lit(""))) <= max_bytes)
    out = None
    for g in (0, 1):
        ids = one.where(F.col("good") == g).orderBy(F.xxhash64("k"), "k").limit(rows)  # 2 numbers a row
        got = small.join(F.broadcast(ids), "k").orderBy(F.xxhash64("k"), "k", F.xxhash64("t")).limit(rows).select("good", F.col("t").alias("text"))
        out = got if out is None else out.unionByName(got)
    return out


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Field | None:
    """The field learnt from ``labels`` (``key``, ``label`` 0 or 1); None where nothing is labelled.

    Null or other labels and null ids are not looked at. The curve gives both labels the weight of their number in ``labels``.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows_ in texts(batches):
            x, size, lines = line_features(rows_)
            ends = np.cumsum(lines)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[e - n:e].astype(np.float32).tobytes() for e, n in zip(ends, lines, strict=True)], pa.binary()),
                 pa.array([size[e - n:e].astype(np.float32).tobytes() for e, n in zip(ends, lines, strict=True)], pa.binary())],
                names=["good", "x", "size"])

    got = (sample(docs, labels, key=key, text=text, label=label, rows=rows)
           .select(F.col("good").cast("int").alias("good"), "text").mapInArrow(run, "good int, x binary, size binary").collect())
    if not got:
        return None
    got.sort(key=lambda r: (r["good"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in got), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)
    size = np.frombuffer(b"".join(r["size"] for r in got), dtype=np.float32).astype(np.float64)
    lines = np.array([len(r["size"]) // 4 for r in got])
    good = np.array([r["good"] for r in got])
    total = {r[0]: r[1] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    every = sum(total.values())
    mass = np.array([total[g] / every * len(good) / (good == g).sum() for g in good])
    return train_field(x, size, lines, good, mass)


def assess(docs: DataFrame, field: Field | None, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns of ``carry``, ``score`` (0 to 1, higher: better), ``n_lines`` and ``n_bad`` (lines whose P(bad) is 0.5 or more).

    Null texts count as empty; an empty text is one empty line. Repeated rows and null keys are answered row
    by row; without a field (nothing labelled) the score is 0.5; other columns are not looked at; an empty
    table gives an empty result. Long texts are read whole: a line more is a step more of the recursion.
    """
    short_batches(docs.sparkSession)
    d = docs.select(F.col(text).alias("__text"), F.col(key), *carry)
    out = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in (key, *carry))
    parts = None if field is None else (field.shift, field.scale, field.w, field.trans, field.start, field.curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if parts is None else Field(*parts)
        for b, rows in texts(batches, "__text"):
            x, size, lines = line_features(rows)
            bad = np.full(len(size), 0.5) if model is None else model.bad_lines(x, lines)
            score = np.full(len(lines), 0.5) if model is None else model.quality(bad, size, lines)
            n_bad = np.add.reduceat((bad >= 0.5).astype(np.int64), np.concatenate([[0], np.cumsum(lines)[:-1]]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score), pa.array(lines), pa.array(n_bad)],
                                             names=[key, *carry, "score", "n_lines", "n_bad"])

    return d.mapInArrow(run, f"{out}, score double, n_lines long, n_bad long")
