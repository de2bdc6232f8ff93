"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes, held as tables of
distinct n-grams: the longest contexts count occurrences, a shorter context
counts a symbol once for each longer one that had it (update exclusion), so an
order's table is an aggregate of the next higher order's; every text is
preceded by ``ORDER`` start marks. A symbol is coded in the longest context
where it was seen; each context before it that was seen costs an escape
(method D: half a count for each distinct symbol), and the symbols of that
context are excluded below.

Texts are packed into compressed rows, which are stored once and dealt into
chunks. A chunk's dictionary (its distinct n-grams and words) is what meets the corpus-wide tables in joins; the
answers go back to the chunk, whose texts are then scored with its own small
dictionary. So no table is broadcast, and no row is shuffled for each position
of a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import stored

#: Bytes of context; an n-gram (context and symbol) is packed into a long.
ORDER = 5
#: Marks that are no bytes of UTF-8: before the text, and the symbol that ends it.
START, END = 0xFE, 0xFF
#: Symbols of the lowest order: all byte values and the end.
ALPHABET = 257
#: Bytes of text in a chunk, about; its dictionary must fit in a Python worker.
CHUNK_BYTES = 16 << 20
#: Bytes of text of one compressed row (or one text, if that is longer); a task holds back no more.
PACK_BYTES = 256 << 10
#: Arrow batches are bounded by bytes here: rows of dictionaries are short, texts may be long.
BATCH = {"maxRecordsPerBatch": "20000", "maxBytesPerBatch": str(2 << 20)}
#: Positions of a text whose n-grams are looked at together.
PIECE = 1 << 20
#: Positions that pile up before their n-grams are merged.
MERGE = 1_000_000


def word_key(word: bytes) -> int:
    """A negative number of 63 hashed bits; n-grams are not negative. The end of a text has the key of
    a blank, which is no word."""
    return (xxh64_intdigest(word) >> 1) - (1 << 63)


def packs(docs: DataFrame, key: str, pack_bytes: int) -> DataFrame:
    """(keys, held_out, sizes, body): texts of neighbouring rows, compressed together."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, schema = 0, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([[k for k, _, _ in held]], pa.list_(schema)), pa.array([[h for _, h, _ in held]], pa.list_(pa.bool_())),
                 pa.array([[len(t) for _, _, t in held]], pa.list_(pa.int32())),
                 pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(t for _, _, t in held))], pa.binary())],
                names=["keys", "held_out", "sizes", "body"])

        for b in batches:
            schema = b.schema.field(0).type
            for k, t, h in zip(b.column(0), b.column(1), b.column(2), strict=True):
                t = (t.as_py() or "").encode()
                held.append((k.as_py(), h.as_py(), t))
                size += len(t)
                if size >= pack_bytes:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return docs.select(key, "text", "held_out").mapInArrow(run, f"keys array<{kind}>, held_out array<boolean>, sizes array<int>, body binary")


def unpacked(group: pa.Table):
    """(keys, held_out, texts) of each compressed row."""
    for i in range(group.num_rows):
        sizes, body = group.column("sizes")[i].as_py(), group.column("body")[i].as_py()
        raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(sizes)))
        ends = np.cumsum(sizes).tolist()
        yield group.column("keys")[i].values, group.column("held_out")[i].as_py(), [raw[e - n:e] for e, n in zip(ends, sizes, strict=True)]


def _windows(a: np.ndarray) -> np.ndarray:
    key = np.zeros(len(a) - ORDER, dtype=np.int64)
    for k in range(ORDER + 1):
        key = (key << 8) | a[k:k + len(key)]
    return key


def packed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Packed n-grams of all positions: (n-grams, texts they belong to, where each text's end). A long text comes in pieces."""
    pad, end = bytes([START]) * ORDER, bytes([END])
    short = [i for i, t in enumerate(texts) if len(t) < PIECE]
    if short:
        key = _windows(np.frombuffer(b"".join(x for i in short for x in (pad, texts[i], end)), dtype=np.uint8))
        keep = np.ones(len(key), dtype=bool)
        ends = np.cumsum([len(texts[i]) + 1 for i in short])
        for j in range(ORDER):  # windows whose last byte is a start mark of the next text
            keep[(ends + np.arange(len(short)) * ORDER + j)[:-1]] = False
        yield key[keep], np.array(short), ends
    for i, t in enumerate(texts):
        if len(t) >= PIECE:
            whole = b"".join((pad, t, end))
            for at in range(0, len(t) + 1, PIECE):
                key = _windows(np.frombuffer(whole[at:at + PIECE + ORDER], dtype=np.uint8))
                yield key, np.array([i]), np.array([len(key)])


class Grams:
    """Distinct n-grams (sorted) with counts; new ones pile up unsorted until there are ``MERGE`` positions."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open: dict[int, list[np.ndarray]] = {0: [], 1: []}
        self.size = 0

    def add(self, keys: np.ndarray, times: int) -> None:
        self.open[times].append(keys)
        self.size += len(keys)
        if self.size > MERGE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        for times, parts in self.open.items():
            if parts:
                u, n = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                at = np.searchsorted(self.keys, u)
                old = np.zeros(len(u), dtype=bool)
                inside = at < len(self.keys)
                old[inside] = self.keys[at[inside]] == u[inside]
                self.counts[at[old]] += n[old] * times
                self.counts = np.insert(self.counts, at[~old], n[~old] * times)
                self.keys = np.insert(self.keys, at[~old], u[~old])
        self.size = 0
        return self.keys, self.counts


def _dictionary(group: pa.Table) -> pa.Table:
    """The distinct n-grams and words of a chunk with their counts in training texts (0: held out only)."""
    chunk = group.column("chunk")[0].as_py()
    grams, words, ends = Grams(), Counter(), 0
    for _, held, raw in unpacked(group):
        for times in (1, 0):
            own = [t for t, h in zip(raw, held, strict=True) if h != bool(times)]
            if own:
                for keys, _, _ in packed(own):
                    grams.add(keys, times)
                if times:
                    ends += len(own)
                    for t in own:
                        words.update(t.lower().split())
                else:
                    for t in own:
                        words.update({w: 0 for w in t.lower().split() if w not in words})
    words[b" "] = ends
    g, n = grams.merge()
    w = np.fromiter(map(word_key, words), np.int64, len(words))
    return pa.Table.from_arrays([
        pa.array(np.full(len(g) + len(w), chunk), pa.int32()), pa.array(np.concatenate([g, w])),
        pa.array(np.concatenate([n, np.fromiter(words.values(), np.int64, len(words))]))], names=["chunk", "key", "n"])


def gram_scores(counts: DataFrame) -> DataFrame:
    """log10 probability of every n-gram: (key, c) -> (key, value).

    ``c`` is the training count; 0 asks for an n-gram that training did not have. Level by level the
    open n-grams meet the contexts that end them; every step is a join of tables of distinct n-grams.
    """
    ctx, cut = (lambda c: F.shiftright(c, 8)), (lambda c, k: F.col(c).bitwiseAND((1 << (8 * (k + 1))) - 1))
    seen, context = {ORDER: counts.where("c > 0").select(F.col("key").alias("g"), "c")}, {}
    for k in range(ORDER - 1, -1, -1):
        seen[k] = stored(seen[k + 1].groupBy(cut("g", k).alias("g")).agg(F.count("*").alias("c")), f"order{k}")
    for k in range(ORDER + 1):
        # t occurrences, d distinct symbols; xt is what these symbols weigh one order below, where they are excluded
        own = seen[k].withColumn("low", cut("g", k - 1)).join(
            seen[k - 1].select(F.col("g").alias("low"), F.col("c").alias("lc")), "low") if k else seen[k].withColumn("lc", F.lit(0))
        context[k] = stored(own.groupBy(ctx("g").alias("x")).agg(
            F.sum("c").alias("t"), F.count("*").alias("d"), F.sum("lc").alias("xt")), f"context{k}")
    found = counts.where("c > 0").withColumn("x", ctx("key")).join(context[ORDER], "x").select(
        "key", F.log10((2 * F.col("c") - 1) / (2 * F.col("t"))).alias("value"))
    # dx, xt: symbols excluded at the next level and their weight there (0 while no context was seen)
    none = F.lit(0).cast("long")
    open_ = (counts.where("c = 0").withColumn("x", ctx("key")).join(context[ORDER], "x", "left")
             .select("key", F.coalesce(F.log10(F.col("d") / (2 * F.col("t"))), F.lit(0.0)).alias("value"),
                     F.coalesce("d", none).alias("dx"), F.coalesce("xt", none).alias("xt")))
    done = [found]
    for k in range(ORDER - 1, -1, -1):
        j = (open_.withColumn("g", cut("key", k)).withColumn("x", ctx("g")).join(seen[k], "g", "left")
             .join(context[k].withColumnRenamed("xt", "xt2"), "x", "left"))
        d = F.col("d") - F.col("dx")
        rest = 2 * (F.col("t") - F.col("xt"))
        last = F.log10(F.lit(1.0) / (ALPHABET - F.coalesce("d", F.lit(0)))) if k == 0 else F.lit(0.0)
        step = (F.when(F.col("c").isNotNull(), F.log10((2 * F.col("c") - 1) / rest))
                .when(F.col("t").isNull() | (d <= 0), last).otherwise(F.log10(d / rest) + last))
        j = stored(j.select("key", (F.col("value") + step).alias("value"), F.coalesce("d", "dx").alias("dx"),
                            F.coalesce("xt2", none).alias("xt"), (F.col("c").isNotNull() | F.lit(k == 0)).alias("over")), f"open{k}")
        done.append(j.where("over").select("key", "value"))
        open_ = j.where("NOT over").drop("over")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


class _Table:
    """Values of 64-bit keys in an open-addressed table, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (3 * len(keys) // 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all in the table."""
        at = self._slot(keys)
        open_ = np.flatnonzero(self.keys[at] != keys)
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        return self.values[at]


class _Counts(dict):
    """Counts of words; the new words of a piece are hashed and looked up together."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        super().__init__()
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in set(words) if w not in self]
        at = np.searchsorted(self.keys, np.fromiter(map(word_key, new), np.int64, len(new)))
        self.update(zip(new, self.counts[at].tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def _scorer(key: str, tokens: int, vocabulary: int):
    def score(docs: pa.Table, entries: pa.Table) -> pa.Table:
        keys, values = entries.column("key").to_numpy(), entries.column("value").to_numpy()
        word = keys < 0
        counts, logs = _Counts(keys[word], values[word]), _Table(keys[~word], values[~word])
        del entries, keys, values, word
        names, held, base, known, n, total = [], [], [], [], [], []
        whole = np.log10(tokens + vocabulary + 1)
        for own, out, raw in unpacked(docs):
            own_total = np.zeros(len(raw))
            for at, which, ends in packed(raw):
                own_total[which] += np.add.reduceat(logs.of(at), np.concatenate([[0], ends[:-1]]))
            total.append(own_total)
            names.append(own)
            held += out
            words, sizes = [], []
            for t in raw:
                before = len(words)
                words += t.lower().split()
                words.append(b" ")
                sizes.append(len(words) - before)
            sizes, c = np.array(sizes), counts.of(words)
            begin = np.cumsum(sizes) - sizes
            n.append(sizes)
            known.append(np.add.reduceat((c > 0).astype(np.int64), begin))
            base.append(np.add.reduceat(np.log10(c + 1), begin) - sizes * whole)
        return pa.Table.from_arrays(
            [pa.chunked_array(names), pa.array(held, pa.bool_()), pa.array(np.concatenate(n)), pa.array(np.concatenate(known)),
             pa.array(np.full(len(held), tokens, dtype=np.int64)), pa.array(np.concatenate(base)), pa.array(np.concatenate(total))],
            names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score(docs: DataFrame, *, held_out, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores every row with a model trained on the rows where ``held_out`` (a boolean column) is false.

    Returns ``key``, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (tokens that training
    had), ``train_tokens``, ``base_score`` (add-one word model, log10), ``score`` (PPM, log10, the end
    of the text included). Null texts count as empty; a null ``held_out`` is false; repeated rows are
    trained on and scored row by row; without training rows the score is that of the uniform symbols;
    an empty table gives an empty result. Other columns are not looked at.

    Texts of any length are read in pieces of ``PIECE`` positions.

    Plan: the texts are packed and stored once; two shuffles of the packs (dictionary, scoring), one of the
    dictionaries by key (whose window gives the corpus counts), one of the answers by chunk. A key has one
    row in each chunk at most, so no key is hot; packs are dealt by their place, whatever rows they hold
    (null keys and repeated rows too), so chunks are alike in size; a longer text is a chunk by itself at worst.
    """
    for name, value in BATCH.items():
        docs.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", value)
    d = docs.select(F.col(key), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-size // chunk_bytes) or 1
    place = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    rows = stored(packs(d, key, min(PACK_BYTES, -(-chunk_bytes // 8))).withColumn("chunk", F.pmod(place, F.lit(chunks)).cast("int")), "packs")
    own = Window.partitionBy("key").orderBy("chunk")
    entries = stored(
        rows.groupBy("chunk").applyInArrow(_dictionary, "chunk int, key long, n long")
        .withColumn("c", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("first", F.row_number().over(own) == 1).select("key", "chunk", "c", "first"), "dictionary")
    words = entries.where("key < 0")
    tokens, vocabulary = words.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    grams = entries.where("key >= 0")
    values = gram_scores(grams.where("first").select("key", "c"))
    answers = (grams.select("key", "chunk").join(values, "key").select("chunk", "key", "value")
               .unionByName(words.select("chunk", "key", F.col("c").cast("double").alias("value"))))
    out = ", ".join(f"`{c}` {t}" for c, t in [(key, d.schema[key].dataType.simpleString()), ("held_out", "boolean"),
                                              ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"),
                                              ("base_score", "double"), ("score", "double")])
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scorer(key, tokens, vocabulary), out)
