"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1. An n-gram binds its letters' vectors
after rotating each by its place (elementwise product), a text bundles its
n-grams (sum), a language bundles all its training texts, and a text is given
to the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, texts

#: Components of a vector and letters of an n-gram.
DIM, GRAM = 512, 3
SEED = 20_011
UNDETERMINED = "und"
_BITS = np.uint64(21)


def _folding() -> np.ndarray:
    """For each code point of the first plane: its small letter, or a blank where it is no letter."""
    out = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Letters:
    """Random vectors of letters, the same in every process; made as letters turn up."""

    def __init__(self, dim: int, gram: int):
        self.dim, self.gram, self.fold = dim, gram, _folding()
        self.known: dict[int, int] = {}
        self.rows = [np.zeros((256, dim), dtype=np.int8) for _ in range(gram)]

    def _row(self, c: int) -> int:
        k = self.known.get(c)
        if k is None:
            k = self.known[c] = len(self.known)
            if k == len(self.rows[0]):
                self.rows = [np.concatenate([r, np.zeros_like(r)]) for r in self.rows]
            v = np.random.default_rng([SEED, c]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
            for place in range(self.gram):
                self.rows[place][k] = np.roll(v, self.gram - 1 - place)
        return k

    def codes(self, text: str) -> np.ndarray:
        """Small letters with single blanks around and between words; empty if there is no letter."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        far = c > 0xFFFF
        out = self.fold[np.where(far, 32, c)]
        if far.any():
            own, at = np.unique(c[far], return_inverse=True)
            out[far] = np.array([ord(chr(x).lower()) if chr(x).isalpha() else 32 for x in own], dtype=np.uint32)[at]
        blank = out == 32
        if blank.all():
            return out[:0]
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        out = np.concatenate([[32], out[keep], [32]]).astype(np.uint64)
        return out[:-1] if out[-2] == 32 else out

    def grams(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, packed into one number, and their counts."""
        n = max(1, len(codes) - self.gram + 1)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(self.gram):
            key = (key << _BITS) | codes[k:k + n]
        return np.unique(key, return_counts=True)

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """The bound vector of each packed n-gram."""
        out = None
        for place in range(self.gram):
            c = (keys >> (_BITS * np.uint64(self.gram - 1 - place))) & ((np.uint64(1) << _BITS) - np.uint64(1))
            own, at = np.unique(c, return_inverse=True)
            rows = [self._row(int(x)) for x in own]  # may grow the tables
            v = self.rows[place][rows]
            out = v[at] if out is None else out * v[at]
        return out.astype(np.float32)


def _bundles(letters: Letters, rows: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of the texts (zero without letters), and whether they have letters."""
    out = np.zeros((len(rows), letters.dim), dtype=np.float32)
    some = np.zeros(len(rows), dtype=bool)
    parts = []
    for r, t in enumerate(rows):
        c = letters.codes(t) if t else ()
        if len(c):
            parts.append((r, *letters.grams(c)))
            some[r] = True
    if parts:
        own, at = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
        v, lo = letters.bound(own), 0
        for r, k, n in parts:
            out[r] = n.astype(np.float32) @ v[at[lo:lo + len(k)]]
            lo += len(k)
    return out, some


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", dim: int = DIM, gram: int = GRAM) -> DataFrame:
    """Prototypes: ``lang``, ``place``, ``value``, one row for each language and component.

    Every text with a non-null language counts whole; texts without letters add nothing. Tasks bundle
    their own rows, so the shuffle holds ``dim`` numbers for each task and language.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dim, gram), {}
        for batch, rows in texts(batches):
            langs = batch.column(1).to_pylist()
            for name in set(langs):
                found = [letters.grams(c) for t, x in zip(rows, langs, strict=True) if x == name and t and len(c := letters.codes(t))]
                if found:
                    own, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([n for _, n in found]))
                    v = n.astype(np.float32) @ letters.bound(own)
                    sums[name] = sums.get(name, 0) + np.rint(v).astype(np.int64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(range(dim), pa.int32()), pa.array(v, pa.int64())],
                                             names=["lang", "place", "value"])

    d = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    return d.mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))


def identify(docs: DataFrame, prototypes: DataFrame, *, key: str = "doc_id", text: str = "text",
             dim: int = DIM, gram: int = GRAM, carry: tuple[str, ...] = (), unlearnt: str | None = UNDETERMINED) -> DataFrame:
    """``key``, ``carry``, ``lang_pred``, ``score`` (cosine, 0 to 1) for each row.

    ``und`` with score 0 where the text is null or empty or has no letter; ``unlearnt`` (``und`` too if not
    given) with score 0 for texts with letters where nothing was learnt. Equal
    cosines go to the first language in code point order. Repeated rows are answered row by row.
    The prototypes (languages x ``dim`` numbers; the set of languages is small) go with the tasks.
    """
    short_batches(docs.sparkSession)
    table: dict[str, np.ndarray] = {}
    for name, place, value in prototypes.collect():
        table.setdefault(name, np.zeros(dim))[place] = value
    names = sorted(n for n, v in table.items() if v.any())
    matrix = np.stack([table[n] / np.linalg.norm(table[n]) for n in names]).astype(np.float32) if names else None
    shared = docs.sparkSession.sparkContext.broadcast((names or [unlearnt], matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, (names, matrix) = Letters(dim, gram), shared.value
        for batch, rows in texts(batches, "__text"):
            v, some = _bundles(letters, rows)
            if matrix is None:
                best, score = np.zeros(len(rows), int), np.zeros(len(rows))
            else:
                cos = (v @ matrix.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                best = cos.argmax(1)
                score = np.clip(cos[np.arange(len(rows)), best], 0.0, 1.0).astype(float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([names[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)], pa.string()),
                 pa.array(np.where(some, score, 0.0), pa.float64())], names=[key, *carry, "lang_pred", "score"])

    d = docs.select(F.col(text).alias("__text"), F.col(key), *carry)
    out = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return d.mapInArrow(run, f"{out}, lang_pred string, score double")
