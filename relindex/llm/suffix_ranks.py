"""Removal of repeated byte strings by prefix doubling over content-picked positions.

A position's rank at length L is its class among equal strings of L bytes. As
in prefix doubling, the rank of a longer string is the pair of the ranks of
its two (overlapping) parts at a growing offset; Spark groups the pairs to
rank them anew, and what is unique is dropped before the next length:

1. 200 bytes. Each window of 400 bytes picks the position (its *anchor*) of the
   smallest hash among its first 201 positions. Equal windows pick equal places,
   so a window repeats only if its anchor's rank at 200 bytes repeats.
2. 360 and 440 bytes. The starts that share an anchor form blocks of 40 by their
   distance from it. What all windows of a block share (360 bytes) must repeat for
   any of them to repeat; if what they cover together (440) repeats, all do.
3. 392 and 408 bytes, in the same way, for blocks of 8 inside blocks still open.
4. 400 bytes. In blocks that are open even now each start is ranked by itself.

So whole interiors of repeated passages are settled by a row for each block,
and single positions are ranked only at the passages' edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_filter, identified, key_of, passes, short_batches, stored, texts
from .wordhash import BYTE_CODE, distinct, powers, sliding_min

#: Bytes of a repeated string, and those of the first rank.
LENGTH = 400
#: Starts of a block, by distance from the anchor, in each round; the smaller divide the larger.
BLOCKS = (40, 8)
#: Bytes that are hashed to pick anchors, and bytes of text handled at once.
PICK, PIECE = 8, 1 << 20
#: Classes of anchors with more positions than this are counted with partial aggregates and joined back; a class
#: below is a window group of one task (some 20 MB of rows at most).
HOT = 500_000

_PLACE = np.uint64((1 << 21) - 1)


class Ranks:
    """Names (64-bit hashes) of all substrings of a buffer, from one prefix sum."""

    def __init__(self, buf: bytes):
        up, self.down = powers(PIECE + 4096)
        b = np.frombuffer(buf, dtype=np.uint8)
        self.n = len(b)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[b] * up[:self.n], out=self.sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        x = (self.sums[at + length] - self.sums[at]) * self.down[at]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def every(self, length: int) -> np.ndarray:
        """Names of all substrings of one length."""
        x = self.sums[length:] - self.sums[:-length]
        x *= self.down[:len(x)]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x


def runs(raw: list[bytes], length: int = LENGTH):
    """For each piece of text: its ranks, and the runs of window starts that share an anchor.

    Yields (ranks, row, shift, low, high, anchor, first, last): per run the row it belongs to, what to
    subtract from buffer places to get places in the text, the text's bounds in the buffer, the
    anchor and the first and last start (buffer places). A run is never split between pieces.
    """
    half = length // 2
    parts: list[tuple[int, bytes, int, int, int]] = []  # row, bytes, offset of the bytes in the text, owned starts [lo, hi)
    size = 0
    for row, t in enumerate(raw):
        if len(t) < length:
            continue
        if len(t) > PIECE:
            if parts:
                yield from _piece(parts, length, half)
                parts, size = [], 0
            lo = 0
            while lo + length <= len(t):
                cut = max(0, lo - half)
                body = t[cut:lo + PIECE // 2 + 4 * length]
                done = yield from _piece([(row, body, cut, lo - cut, lo - cut + PIECE // 2)], length, half)
                lo = cut + done
        else:
            if size + len(t) > PIECE:
                yield from _piece(parts, length, half)
                parts, size = [], 0
            parts.append((row, t, 0, 0, len(t)))
            size += len(t)
    if parts:
        yield from _piece(parts, length, half)


def _piece(parts, length: int, half: int):
    ranks = Ranks(b"".join(p[1] for p in parts))
    sizes = np.array([len(p[1]) for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    pick = ranks.every(PICK)
    pick &= ~_PLACE
    pick |= np.arange(len(pick), dtype=np.uint64)
    best = sliding_min(pick, half + 1)
    stop = begin + sizes - length + 1  # of the starts of each text
    bounds = distinct(np.concatenate([np.flatnonzero(best[1:] != best[:-1]) + 1, begin, stop]))
    own = np.searchsorted(begin, bounds, side="right") - 1
    first, last = bounds, np.concatenate([bounds[1:], [len(best)]]) - 1
    lo, hi = np.array([p[3] for p in parts])[own] + begin[own], np.array([p[4] for p in parts])[own] + begin[own]
    keep = (first < stop[own]) & (first >= lo) & (first < hi)
    own, first, last = own[keep], first[keep], last[keep]
    shift = begin[own] - np.array([p[2] for p in parts])[own]
    yield (ranks, np.array([p[0] for p in parts])[own], shift, begin[own], begin[own] + sizes[own],
           (best[first] & _PLACE).astype(np.int64), first, last)
    return int(last[-1]) + 1  # of a long text's only part: where the next piece begins


def _bytes(rows: list[str | None]) -> list[bytes]:
    return [t.encode() if t else b"" for t in rows]


def anchors_of(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in texts(batches):
            for ranks, _, _, _, _, anchor, _, _ in runs(_bytes(rows), length):
                yield pa.RecordBatch.from_arrays([pa.array(ranks.of(anchor, length // 2).view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(run, "h long")


def _blocks(piece, length: int, repeated, hot, want_hot: bool, open_: tuple):
    """Blocks of the runs whose anchor's rank repeats, as small as ``open_`` (the filters of open blocks of the
    rounds before) says: run number, core and cover ranks (cover valid?), first and last start."""
    ranks, _, _, low, high, anchor, first, last = piece
    h = ranks.of(anchor, length // 2)
    r = np.flatnonzero(passes(repeated, h) & (passes(hot, h) == want_hot))
    lo, hi = first[r], last[r]
    for k in range(len(open_) + 1):
        block = BLOCKS[k]
        top = (length // 2) // block - (k == 0)  # in the first round the last block takes the one distance left
        a = anchor[r]
        j0, j1 = np.minimum((a - hi) // block, top), np.minimum((a - lo) // block, top)
        times = j1 - j0 + 1
        j = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(j0, times)
        r, lo, hi, a = (np.repeat(x, times) for x in (r, lo, hi, a))
        near = j * block
        far = np.minimum(near + block - 1, length // 2) if k else np.where(j == top, length // 2, near + block - 1)
        mix = (j.astype(np.uint64) + np.uint64(1 + 1000 * k)) * np.uint64(0x94D049BB133111EB)
        core = ranks.of(a - near, length - (far - near)) ^ mix
        lo, hi = np.maximum(a - far, lo), np.minimum(a - near, hi)
        if k < len(open_):
            keep = passes(open_[k], core)
            r, lo, hi = r[keep], lo[keep], hi[keep]
    whole = (a - far >= low[r]) & (a - near + length <= high[r])
    cover = ranks.of(np.where(whole, a - far, low[r]), np.where(whole, length + far - near, 1)) ^ mix
    return r, core, cover, whole, lo, hi


def blocks_of(docs: DataFrame, length: int, repeated, hot, want_hot: bool, open_: tuple) -> DataFrame:
    """(c, u, doc, lo, hi): core and cover rank of each block (u null where the text ends before), its first and last start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in texts(batches):
            for piece in runs(_bytes(rows), length):
                r, core, cover, whole, lo, hi = _blocks(piece, length, repeated.value, hot.value, want_hot, tuple(o.value for o in open_))
                if len(r):
                    shift = piece[2][r]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core.view(np.int64)), pa.array(cover.view(np.int64), mask=~whole), batch.column(0).take(pa.array(piece[1][r])),
                         pa.array((lo - shift).astype(np.int32)), pa.array((hi - shift).astype(np.int32))], names=["c", "u", "doc", "lo", "hi"])

    return docs.select("doc", "text").mapInArrow(run, f"c long, u long, doc {_kind(docs)}, lo int, hi int")


def starts_of(docs: DataFrame, length: int, repeated, hot, want_hot: bool, open_: tuple) -> DataFrame:
    """(w, doc, lo): rank of every start in the blocks that are open to the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in texts(batches):
            for piece in runs(_bytes(rows), length):
                filters = tuple(o.value for o in open_)
                r, core, _, _, lo, hi = _blocks(piece, length, repeated.value, hot.value, want_hot, filters[:-1])
                keep = passes(filters[-1], core)
                if keep.any():
                    r, lo, times = r[keep], lo[keep], (hi - lo + 1)[keep]
                    own = np.repeat(r, times)
                    at = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(piece[0].of(at, length).view(np.int64)), batch.column(0).take(pa.array(piece[1][own])),
                         pa.array((at - piece[2][own]).astype(np.int32))], names=["w", "doc", "lo"])

    return docs.select("doc", "text").mapInArrow(run, f"w long, doc {_kind(docs)}, lo int")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc"].dataType.simpleString()


def _ranked_blocks(docs: DataFrame, length: int, repeated, hot, some_hot: bool, open_: tuple) -> DataFrame:
    """(doc, lo, hi, c): settled blocks (c null) and open ones (c: their core rank)."""
    core, cover = Window.partitionBy("c"), Window.partitionBy("c", "u")
    out = (blocks_of(docs, length, repeated, hot, False, open_)
           .withColumn("n_u", F.when(F.col("u").isNotNull(), F.count("*").over(cover)).otherwise(1))
           .withColumn("n_c", F.count("*").over(core)).where("n_c > 1")
           .select("doc", "lo", "hi", F.when(F.col("n_u") == 1, F.col("c")).alias("c")))
    if some_hot:  # else passes over nothing
        much = blocks_of(docs, length, repeated, hot, True, open_)
        pairs = stored(much.groupBy("c", "u").agg(F.count("*").alias("n")), "pairs")
        settled = much.join(pairs.where("n > 1 AND u IS NOT NULL"), ["c", "u"]).select("doc", "lo", "hi", F.lit(None).cast("long").alias("c"))
        single = (pairs.groupBy("c").agg(F.sum("n").alias("n"), F.min(F.when(F.col("u").isNotNull(), F.col("n")).otherwise(1)).alias("least"))
                  .where("n > 1 AND least = 1"))
        none = F.lit(None)
        out = out.unionByName(settled).unionByName(single.select(
            none.cast(_kind(docs)).alias("doc"), none.cast("int").alias("lo"), none.cast("int").alias("hi"), "c"))
    return stored(out, "blocks")


def repeated_starts(docs: DataFrame, *, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc, lo, hi): ranges of starts of strings of ``length`` bytes that also start elsewhere."""
    sc = docs.sparkSession.sparkContext
    ranked = stored(anchors_of(docs, length).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "ranks")
    much = ranked.where(F.col("n") > hot)
    repeated, hot_ones, some_hot = sc.broadcast(hash_filter(ranked)), sc.broadcast(hash_filter(much)), much.limit(1).count() > 0
    open_, found = (), []
    for _ in BLOCKS:
        blocks = _ranked_blocks(docs, length, repeated, hot_ones, some_hot, open_)
        found.append(blocks.where("c IS NULL").select("doc", "lo", "hi"))
        still = stored(blocks.where("c IS NOT NULL").select(F.col("c").alias("h")).distinct(), "open")
        open_ = (*open_, sc.broadcast(hash_filter(still)))
    one = starts_of(docs, length, repeated, hot_ones, False, open_).withColumn(
        "n", F.count("*").over(Window.partitionBy("w"))).where("n > 1").select("doc", "lo")
    if some_hot:
        hot_starts = starts_of(docs, length, repeated, hot_ones, True, open_)
        one = one.unionByName(hot_starts.join(hot_starts.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w"), "w").select("doc", "lo"))
    out = one.select("doc", "lo", F.col("lo").alias("hi"))
    for f in found:
        out = out.unionByName(f)
    return out


def _union(ranges: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes [lo, hi) that strings starting in the ranges cover, as maximal runs."""
    ranges = np.sort(ranges)
    lo = ranges >> 10
    hi = np.maximum.accumulate(lo + (ranges & 1023) + length)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[new].tolist(), hi[np.concatenate([new[1:] - 1, [len(hi) - 1]])].tolist(), strict=True))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``removed`` (maximal runs [lo, hi) of removed bytes) and ``kept``
    (binary: the remaining bytes) for each document.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, the same document
    included. Null texts count as empty, texts below ``length`` bytes stay whole; null keys are documents
    of their own; equal rows (key and text) are one document, judged and returned once; an empty table
    gives an empty result. Other columns are not looked at.
    """
    if length % (2 * BLOCKS[0]):
        raise ValueError(f"length must be a multiple of {2 * BLOCKS[0]}")
    short_batches(docs.sparkSession)
    d = identified(docs, key, text)
    # a range of starts is one number: a list of them is half as large as a list of structs, and read by numpy
    by_doc = repeated_starts(d, length=length, hot=hot).groupBy("doc").agg(
        F.collect_list(F.shiftleft(F.col("lo").cast("long"), 10).bitwiseOR(F.col("hi") - F.col("lo"))).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch, rows in texts(batches):
            raw, total, gone, cut, kept = _bytes(rows), [], [], [], []
            for t, starts in zip(raw, batch.column(2), strict=True):
                spans = _union(starts.values.to_numpy(), length) if starts.is_valid else []
                total.append(len(t))
                gone.append(sum(hi - lo for lo, hi in spans))
                cut.append([{"lo": lo, "hi": hi} for lo, hi in spans])
                edges = [0, *(x for s in spans for x in s), len(t)]
                kept.append(b"".join(t[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(cut, span), pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "n_removed", "removed", "kept"])

    joined = d.join(by_doc.withColumnRenamed("doc", "doc2"), F.col("doc").eqNullSafe(F.col("doc2")), "left")
    out = joined.select("doc", "text", "starts").mapInArrow(
        run, f"doc {_kind(d)}, n_bytes long, n_removed long, removed array<struct<lo:int,hi:int>>, kept binary")
    return out.select(key_of(out).alias(key), "n_bytes", "n_removed", "removed", "kept")
