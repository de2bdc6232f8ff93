"""Substring deduplication by compaction of a De Bruijn graph of word k-mers.

A k-mer of words is an edge from the node of its first ``k - 1`` words to that
of its last. Only edges of two documents matter, so windows whose anchor (a
small word gram that the window picks by its hash) occurs in one document only
are left out first. The other edges meet at their nodes, where the smallest
document of each edge becomes its source and branches show. Edges that follow
each other in a document and in the same source, without a branch between,
compact into one path: the source coordinates advance with the document's, so
a path is one verified repeated span. What a later document shares is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_filter, identified, key_of, passes, short_batches, stored, texts, words_of
from .wordhash import Runs, sliding_min, words

#: Words of a window, and of the anchor whose repetition makes a window a candidate.
K, ANCHOR = 13, 5
#: Edges whose anchor is in more documents than this are grouped with partial aggregates and joined back; the others
#: are a window group of one task (some 20 MB of rows at most).
HOT_DOCS = 500_000


def windows(rows: list[str | None], k: int, anchor: int):
    """For a batch of texts: the hashes of runs of words, and for each window of ``k`` words its text's
    number, place in the batch, place in the text and anchor (the smallest hash of ``anchor`` words in it, 40 bits)."""
    h, counts = words([t.encode() if t else b"" for t in rows])
    run = Runs(h)
    n = np.maximum(counts - (k - 1), 0)
    text = np.repeat(np.arange(len(rows)), n)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = pos + np.repeat(np.cumsum(counts) - counts, n)
    if not len(at):
        return run, text, at, pos, np.zeros(0, np.uint64)
    a = run.of(np.arange(len(h) - anchor + 1), anchor) >> np.uint64(24)
    return run, text, at, pos, sliding_min(a, k - anchor + 1)[at]


def anchors_of(docs: DataFrame, k: int, anchor: int) -> DataFrame:
    """(h): the distinct anchors that the windows of each document pick."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in texts(batches):
            _, text, _, _, a = windows(rows, k, anchor)
            if len(a):
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])])
                a, text = a[new], text[new]
                order = np.lexsort((a, text))
                a, text = a[order], text[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(a[new].astype(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(run, "h long")


def edges_of(docs: DataFrame, k: int, anchor: int, repeated, hot, want_hot: bool) -> DataFrame:
    """(l, r, doc, pos): edges whose anchor passes ``repeated``; hot anchors apart. An edge is named by 64-bit
    hashes of its left and its right node: any number of edges may leave one node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, much = repeated.value, hot.value
        for batch, rows in texts(batches):
            runs, text, at, pos, a = windows(rows, k, anchor)
            p = np.flatnonzero(passes(keep, a) & (passes(much, a) == want_hot))
            if len(p):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.of(at[p], k - 1).view(np.int64)), pa.array(runs.of(at[p] + 1, k - 1).view(np.int64)),
                     batch.column(0).take(pa.array(text[p])), pa.array(pos[p].astype(np.int32))], names=["l", "r", "doc", "pos"])

    return docs.select("doc", "text").mapInArrow(run, f"l long, r long, doc {docs.schema['doc'].dataType.simpleString()}, pos int")


def _later(edges: DataFrame) -> F.Column:
    """Whether an occurrence's document comes after its source (by key, not by text)."""
    return key_of(edges, "source") < key_of(edges)


def repeated_spans(docs: DataFrame, *, k: int = K, anchor: int = ANCHOR, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(doc, lo, hi, source, at): maximal runs of words [lo, hi) of ``doc`` along one path of ``source``,
    where they start at word ``at``. ``docs`` has (doc, text) as ``identified`` gives them."""
    sc = docs.sparkSession.sparkContext
    found = stored(anchors_of(docs, k, anchor).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    repeated, hot = sc.broadcast(hash_filter(found)), sc.broadcast(hash_filter(found.where(F.col("n") > hot_docs)))

    cold = edges_of(docs, k, anchor, repeated, hot, False)
    node, edge = Window.partitionBy("l"), Window.partitionBy("l", "r")
    cold = (cold.withColumn("branch", F.min("r").over(node) != F.max("r").over(node))
            .withColumn("first", F.min(F.struct("doc", "pos")).over(edge))
            .select("doc", "pos", "branch", F.col("first.doc").alias("source"), F.col("first.pos").alias("at")))

    marks = cold
    if found.where(F.col("n") > hot_docs).limit(1).count():  # else two passes over nothing
        much = edges_of(docs, k, anchor, repeated, hot, True)
        firsts = (much.groupBy("l", "r").agg(F.min("doc").alias("source"), F.min_by("pos", "doc").alias("at"), F.max("doc").alias("last"))
                  .where("source < last").drop("last").withColumn("branch", F.min("r").over(node) != F.max("r").over(node)))
        marks = marks.unionByName(much.join(firsts, ["l", "r"]).select("doc", "pos", "branch", "source", "at"))
    marks = marks.where(_later(marks))
    order = Window.partitionBy("doc").orderBy("pos")
    goes_on = ((F.lag("pos").over(order) == F.col("pos") - 1) & F.lag("source").over(order).eqNullSafe(F.col("source"))
               & (F.lag("at").over(order) == F.col("at") - 1) & ~F.col("branch"))
    runs = (marks.withColumn("new", F.when(goes_on, 0).otherwise(1))
            .withColumn("path", F.sum("new").over(order)))
    return runs.groupBy("doc", "path").agg(
        F.min("pos").alias("lo"), (F.max("pos") + k).alias("hi"), F.min("source").alias("source"), F.min("at").alias("at")).drop("path")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, anchor: int = ANCHOR,
                   hot_docs: int = HOT_DOCS) -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``kept`` (kept words joined by one space) for each document.

    A word goes if a window of ``k`` words over it also starts in a document with a smaller key;
    windows are judged on the input. Null and empty texts have no words; a null key is neither smaller
    nor larger than any, so such rows stay whole and remove nothing; of rows with equal key and text
    one is returned, rows with the same key and other texts are not compared with each other; an empty
    table gives an empty result. Other columns are not looked at.

    Plan: one shuffle of 40-bit anchors with partial counts, one of the edges left, one of the marked
    windows by document and one of the texts. Edges under hot anchors (``hot_docs``) take a path with
    partial aggregates and a join whose large side may be split, the others a window of few rows.
    """
    short_batches(docs.sparkSession)
    d = identified(docs, key, text)
    spans = repeated_spans(d.where(key_of(d).isNotNull()), k=k, anchor=anchor, hot_docs=hot_docs)
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in texts(batches):
            total, gone, kept = [], [], []
            for t, cuts in zip(rows, batch.column(2).to_pylist(), strict=True):
                words = words_of(t)
                stay = np.ones(len(words), dtype=bool)
                for s in cuts or ():
                    stay[s["lo"]:s["hi"]] = False
                total.append(len(words))
                gone.append(int(len(words) - stay.sum()))
                kept.append(b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s).decode() if gone[-1] else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc", "n_words", "n_removed", "kept"])

    out = d.join(by_doc, "doc", "left").select("doc", "text", "spans").mapInArrow(
        run, f"doc {d.schema['doc'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.select(key_of(out).alias(key), "n_words", "n_removed", "kept")
