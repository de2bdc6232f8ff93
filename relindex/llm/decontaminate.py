"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. All patterns of one
length ``m`` share a shift table keyed by blocks of two words: a block that
ends no pattern lets the scan jump up to ``m - 1`` words. A block with shift 0
selects a bucket of patterns by their suffix, and a direct comparison of all
``m`` words confirms the occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, texts

#: Benchmark text one broadcast slice may hold; more text is searched in several slices.
SLICE_BYTES = 16 << 20

#: A-Z become a-z, other ASCII characters but digits and a-z part words, all else stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))

SCHEMA = "row_key string, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"


def fold_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


class WuManber:
    """Shift table and buckets for patterns (tuples of words) of equal length."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.m, self.b = m, min(2, m)
        self.shift: dict = {}
        self.bucket: dict = defaultdict(dict)
        for p, owners in patterns.items():
            for end in range(self.b, m + 1):
                block = p[end - self.b:end]
                self.shift[block] = min(self.shift.get(block, m), m - end)
            self.bucket[p[m - self.b:]][p] = owners

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, owners) of each occurrence, from left to right."""
        m, b, n, jump, shift = self.m, self.b, len(words), self.m - self.b + 1, self.shift.get
        at = m - 1
        while at < n:
            block = (words[at - 1], words[at]) if b == 2 else (words[at],)
            step = shift(block, jump)
            if step:
                at += step
                continue
            start = at - m + 1
            owners = self.bucket[block].get(tuple(words[start:at + 1]))
            if owners is not None:
                yield start, owners
            at += 1


def compile_items(items: list[tuple[str | None, str | None]], window: int) -> tuple[list[WuManber], list[str | None]]:
    """One searcher for each pattern length; short items are one pattern as a whole."""
    ids: list[str | None] = sorted({i for i, _ in items if i is not None})
    number = {i: k for k, i in enumerate(ids)}
    ids.append(None)
    by_len: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words, k = fold_words(text), number.get(item, len(ids) - 1)
        m = min(window, len(words))
        for s in range(len(words) - m + 1 if m else 0):
            by_len[m][tuple(words[s:s + m])].add(k)
    return [WuManber(m, p) for m, p in sorted(by_len.items())], ids


def scan(words: list[bytes], searchers: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Maximal hit spans [lo, hi) and the items that occur."""
    found, owners = [], set()
    for w in searchers:
        for start, who in w.search(words):
            owners |= who
            if found and found[-1][0] <= start <= found[-1][1] and found[-1][1] <= start + w.m:
                found[-1] = (found[-1][0], start + w.m)
            else:
                found.append((start, start + w.m))
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    return spans, owners


def _search_slice(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, ids = compile_items(shared.value, window)
        for batch, rows in texts(batches):
            n, spans, named = [], [], []
            for t in rows:
                words = fold_words(t)
                s, who = scan(words, searchers)
                n.append(len(words))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in s])
                named.append(sorted(ids[k] for k in who if ids[k] is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                 pa.array(named, pa.list_(pa.string()))],
                names=["row_key", "n_words", "spans", "items"])

    return docs.mapInArrow(run, SCHEMA.replace("row_key string", f"row_key {docs.schema['row_key'].dataType.simpleString()}"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = 10,
                  slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Word spans of ``docs`` that occur in ``benchmark`` items.

    Returns, for each row of ``docs``: ``key``, ``n_words``, ``spans`` (maximal
    runs of hit words, [lo, hi) by word number) and ``items`` (sorted item keys
    as strings). Null and empty texts have no words; items without words match
    nothing; a null item key marks words but is not listed; repeated rows are
    answered row by row; an empty benchmark hits nothing. Other columns are not
    looked at.

    The benchmark is broadcast in slices of ``slice_bytes`` at most (measured
    first); the documents are read once for each slice, whose hits are merged.
    """
    spark = docs.sparkSession
    short_batches(spark)
    d = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    b = benchmark.select(F.col(item_key).cast("string").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    size = b.agg(F.sum(F.octet_length("t") + 40)).first()[0] or 0
    n = -(-size // slice_bytes) or 1
    if n == 1:
        out = _search_slice(d, [tuple(r) for r in b.collect()], window)
    else:
        d = d.withColumn("row_key", F.struct("row_key", F.xxhash64("text").alias("h")))
        parts = [_search_slice(d, [tuple(r) for r in b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()],
                               window) for k in range(n)]
        every = parts[0].withColumn("k", F.lit(0))
        for k, p in enumerate(parts[1:], 1):
            every = every.unionByName(p.withColumn("k", F.lit(k)))
        # repeated rows count once for each slice; they come out again as often as they came in
        out = (every.groupBy("row_key").agg(
            F.max("n_words").alias("n_words"), F.sum(F.when(F.col("k") == 0, 1)).alias("times"),
            F.array_distinct(F.flatten(F.collect_set("spans"))).alias("all_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
            .withColumn("spans", _merge_spans(F.col("all_spans")))
            .withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
            .select(F.col("row_key.row_key").alias("row_key"), "n_words", "spans", "items"))
    return out.withColumnRenamed("row_key", key)


def _merge_spans(spans):
    """Union of [lo, hi) intervals, natively; the list of one document's hit spans is short."""
    empty = F.lit(None).cast("array<struct<lo:int,hi:int>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["lo"] <= last["hi"], joined).otherwise(
            F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.coalesce(empty, F.array().cast("array<struct<lo:int,hi:int>>")), add)


def hits(spans):
    """Number of hit words of a span list."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
