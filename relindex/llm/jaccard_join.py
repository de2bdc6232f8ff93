"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two sets of shingles can reach the similarity only if their overlap reaches T,
a share of the larger set. With all shingles in one total order, a set's
``n - T + c`` first ones are its short lists: a similar pair shares at least
``c`` of them. The order is by hash, with frequent shingles last (which are
frequent is counted first), so short lists are short.

* Shingles of few sets: the lists are merged by a join of the index with itself
  and a count for each pair; pairs below ``c`` go.
* Shingles of many sets: a pair that shares no other short list must share one
  of the first ``n - T + 1`` shingles (the prefix filter). So a set joins the
  family of a frequent shingle only if that is among its own first ones; a text
  on a common template whose own words fill that prefix joins none.

Pairs and families connect into blocks of candidates. Inside a block (large
ones are dealt into parts, every two of which meet) DivideSkip finds all links:
a query's short lists are merged by counting, and its long lists are binary
probed for the candidates that are left, unless merging them is cheaper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_filter, identified, key_of, passes, short_batches, stored, texts
from .components import components
from .wordhash import Runs, distinct, scramble, words

#: Words of a shingle and percent of the union that two sets must share.
SHINGLE, PERCENT = 4, 85
#: Sets from which a shingle is frequent, and sets and shingles in one part of a block.
FREQUENT, PART_SETS, PART_SHINGLES = 20, 2048, 1 << 21
#: Which shingles are frequent is settled when those found last have at most this share of the postings; it decides
#: how much is compared, not what is found.
SETTLED = 0.2
#: Binary probes cost about as much as merging so many postings.
PROBE = 20

_LOW = np.uint64((1 << 40) - 1)


def required(n, percent: int):
    """Least overlap of a set of n shingles with any similar set."""
    return -(-percent * n // 100)


def surplus(n):
    """c: overlap required within the short lists."""
    return n // 10 + 1


def shingle_sets(rows: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased; fewer words than ``size`` are one shingle."""
    h, counts = words([t.encode().lower() if t else b"" for t in rows])
    run, out, at = Runs(h), [], 0
    for n in counts.tolist():
        m = min(size, n)
        out.append(distinct(run.of(np.arange(at, at + n - m + 1), m)) if n else np.zeros(0, np.uint64))
        at += n
    return out


def short_lists(s: np.ndarray, percent: int, frequent) -> np.ndarray:
    """The first shingles of a set in the total order (not frequent first, then by hash)."""
    n = len(s)
    m = min(n, n - required(n, percent) + surplus(n))
    if frequent is None:
        return s[:m]
    hot = passes(frequent, s & _LOW)
    first = s[~hot][:m]
    return first if len(first) == m else np.concatenate([first, s[hot][:m - len(first)]])


def _map(docs: DataFrame, columns: list[str], out: list[tuple[str, str]], size: int, each) -> DataFrame:
    """mapInArrow over (text, ``columns``); ``each(batch, sets)`` gives the columns of ``out`` (name, type), or None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in texts(batches):
            made = each(batch, shingle_sets(rows, size))
            if made is not None:
                yield pa.RecordBatch.from_arrays(made, names=[name for name, _ in out])

    return docs.select("text", *columns).mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in out))


def _class_ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([int(scramble(np.array([scramble(s).sum() + np.uint64(len(s))], np.uint64))[0]) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def classes_of(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, cls): size of each document's set and the id of its class of equal sets."""
    def each(batch, sets):
        return [batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(_class_ids(sets))]
    return _map(docs, ["doc"], [("doc", docs.schema["doc"].dataType.simpleString()), ("n", "long"), ("cls", "long")], size, each)


def _short_tokens(docs: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    def each(_, sets):
        out = [short_lists(s, percent, frequent and frequent.value) & _LOW for s in sets if len(s)]
        return [pa.array(np.concatenate(out).astype(np.int64))] if out else None
    return _map(docs, [], [("h", "long")], size, each).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")


def _index(docs: DataFrame, size: int, percent: int, frequent, repeated) -> DataFrame:
    """(token, cls, n, first): the postings of repeated shingles in the short lists, and whether they are in the prefix of n - T + 1."""
    def each(_, sets):
        ids = _class_ids(sets)
        tokens, owner, first = [], [], []
        for i, s in enumerate(sets):
            if len(s):
                t = short_lists(s, percent, frequent.value)
                at = np.flatnonzero(passes(repeated.value, t & _LOW))
                tokens.append(t[at])
                owner.append(np.full(len(at), i))
                first.append(at <= len(s) - required(len(s), percent))
        if not tokens:
            return None
        owner = np.concatenate(owner)
        n = np.array([len(s) for s in sets])
        return [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(ids[owner]), pa.array(n[owner]), pa.array(np.concatenate(first))]
    return _map(docs, [], [("token", "long"), ("cls", "long"), ("n", "long"), ("first", "boolean")], size, each).distinct()


def divide_skip(sets: list[np.ndarray], side: np.ndarray, across: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """All pairs of sets with 100 * overlap >= percent * union (of two sides, if ``across``), each once:
    (query, the smaller or equal sets that link with it) for every query with links."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    flat = np.concatenate([sets[i] for i in order])
    record = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(flat, return_inverse=True)
    by = np.argsort(token, kind="stable")
    posting = record[by]
    begin = np.concatenate([[0], np.cumsum(np.bincount(token))])
    starts = np.concatenate([[0], np.cumsum(size)])
    for q in range(1, len(sets)):
        n = int(size[q])
        lo = int(np.searchsorted(size, required(n, percent)))
        if lo >= q:
            continue
        lists = token[starts[q]:starts[q + 1]]
        lists = lists[np.argsort(begin[lists + 1] - begin[lists], kind="stable")]
        least = -(-percent * (n + int(size[lo])) // (100 + percent))
        short = min(n, n - least + surplus(n))
        count = np.bincount(np.concatenate([posting[begin[t]:begin[t + 1]] for t in lists[:short]]), minlength=len(sets))
        found = np.flatnonzero(count[lo:q] >= min(surplus(n), least)) + lo
        if across:
            found = found[side[found] != side[q]]
        if not len(found):
            continue
        overlap = count[found]
        rest = lists[short:]
        long = (begin[rest + 1] - begin[rest]) > PROBE * len(found)
        if not long.all():
            overlap = overlap + np.bincount(np.concatenate([posting[begin[t]:begin[t + 1]] for t in rest[~long]]), minlength=len(sets))[found]
        for t in rest[long]:
            p = posting[begin[t]:begin[t + 1]]
            at = np.searchsorted(p, found)
            overlap = overlap + (p[np.minimum(at, len(p) - 1)] == found)
        found = found[100 * overlap >= percent * (n + size[found] - overlap)]
        if len(found):
            yield int(order[q]), order[found]


def _links(group: pa.Table, percent: int) -> pa.Table:
    """Of one block: a forest that spans its links (a, b, 0), and for each class (cls, cls, documents linked)."""
    part, cls, copies = (group.column(c).to_numpy() for c in ("part", "cls", "copies"))
    sets = [x.values.to_numpy().view(np.uint64) for x in group.column("tokens")]
    linked, root, forest = np.zeros(len(sets), np.int64), list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q, found in divide_skip(sets, part, bool(group.column("across")[0].as_py()), percent):
        linked[q] += copies[found].sum()
        linked[found] += copies[q]
        for r in found.tolist():
            x, y = find(q), find(r)
            if x != y:
                root[x] = y
                forest.append((cls[q], cls[r], 0))
    forest += [(cls[i], cls[i], linked[i]) for i in np.flatnonzero(linked)]
    return pa.Table.from_arrays([pa.array([f[k] for f in forest], pa.int64()) for k in range(3)], names=["a", "b", "linked"])


def postings(docs: DataFrame, size: int, percent: int, frequent: int) -> DataFrame:
    """(token, cls, n, first, sets): the inverted index of the short lists, without shingles of a single class."""
    sc = docs.sparkSession.sparkContext
    often = F.col("n") >= frequent
    known = stored(_short_tokens(docs, size, percent, None).where(often).select("h"), "frequent")
    while True:
        hot = sc.broadcast(hash_filter(known))
        seen = stored(_short_tokens(docs, size, percent, hot), "repeated")
        # with these last, others may have come into the short lists that are frequent too
        new = stored(seen.where(often).join(known, "h", "left_anti"), "frequent")
        if (new.agg(F.sum("n")).first()[0] or 0) <= SETTLED * (seen.agg(F.sum("n")).first()[0] or 0):
            break
        known = stored(known.unionByName(new.select("h")), "frequent")
    repeated = sc.broadcast(hash_filter(seen))
    per_token = _index(docs, size, percent, hot, repeated)
    counts = per_token.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    return stored(per_token.join(counts, "token"), "index")


def families(index: DataFrame, percent: int, frequent: int) -> DataFrame:
    """(cls, family): classes that may link are in one family."""
    # A pair shares c short shingles at least. If a set has h frequent ones, c - h of the shared ones are not
    # frequent. Pairs that share none of these have c frequent ones each, one of them in both prefixes.
    often = F.col("sets") >= frequent
    h = index.where(often).groupBy("cls").agg(F.count("*").alias("h"))
    short = index.where(~often).select("token", "cls", "n").join(h, "cls", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    x, y = (short.select("token", F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("h").alias(f"h_{c}")) for c in "ab")
    least = F.least("n_a", "n_b")
    pairs = (x.join(y, "token").where((F.col("a") < F.col("b")) & (100 * least >= percent * F.greatest("n_a", "n_b")))
             .groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.floor(least / 10) + 1 - F.least("h_a", "h_b")).alias("c"))
             .where("shared >= c").select("a", "b"))
    fewest = F.floor(F.ceil(F.col("n") * percent / 100) / 10) + 1  # c of the smallest similar set
    many = index.where(often & F.col("first")).select("token", "cls", "n").join(h, "cls").where(F.col("h") >= fewest)
    heads = many.groupBy("token").agg(F.min("cls").alias("head"))
    stars = many.join(heads, "token").where(F.col("cls") != F.col("head")).select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
    return components(pairs.unionByName(stars)).select(F.col("node").alias("cls"), F.col("root").alias("family"))


def similar_classes(docs: DataFrame, members: DataFrame, *, size: int, percent: int, frequent: int) -> DataFrame:
    """Links among the classes of equal sets, as ``_links`` gives them: edges that connect what links
    connect (no pair of a group is written out), and the documents that each class links with in each
    block. ``members`` is ``classes_of`` the documents."""
    sc = docs.sparkSession.sparkContext
    family = families(postings(docs, size, percent, frequent), percent, frequent)

    n = members.groupBy("cls").agg(F.first("n").alias("n"), F.min("doc").alias("doc"), F.count("*").alias("copies"))
    candidates = stored(family.join(n, "cls").withColumn("at", F.xxhash64("doc")), "candidates")
    parts = candidates.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    wanted = sc.broadcast(hash_filter(candidates.select(F.col("at").alias("h"))))

    def each(batch, sets):
        keep = np.flatnonzero(passes(wanted.value, batch.column(1).to_numpy().view(np.uint64)))
        if not len(keep):
            return None
        ids = _class_ids([sets[i] for i in keep])
        return [pa.array(ids), batch.column(1).take(pa.array(keep)), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))]

    sets = _map(docs.withColumn("at", F.xxhash64("doc")), ["at"], [("cls", "long"), ("at", "long"), ("tokens", "array<long>")], size, each)
    dealt = (candidates.join(parts, "family").select("cls", "at", "family", "parts", "copies").join(sets, ["cls", "at"])
             .withColumn("part", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cls", "copies", "tokens", "part", "family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                     (F.col("part") != F.col("other")).alias("across")))
    return dealt.groupBy("family", "i", "j").applyInArrow(lambda t: _links(t, percent), "a long, b long, linked long")


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT,
                 frequent: int = FREQUENT) -> DataFrame:
    """``key``, ``n_shingles``, ``component`` (least key reachable by links), ``n_links`` (documents it links with).

    Null and blank texts have no shingles and link with nothing; equal sets link with each other; rows
    with null keys, equal keys or both are documents of their own (equal rows are one), a component of
    null keys only is null; an empty table gives an empty result. Other columns are not looked at.

    Plan: three passes emit the short lists (two to count which shingles are frequent and which repeat,
    40 bits each, one to index the repeated ones); only sets in a block of candidates are shuffled.
    A group of n similar sets costs n postings for each list and, in its block, the DivideSkip search;
    parts of ``PART_SETS`` sets bound what one task holds.
    """
    short_batches(docs.sparkSession)
    d = identified(docs, key, text)
    members = stored(classes_of(d, size), "classes")
    some = members.where("n > 0")
    links = stored(similar_classes(d, some, size=size, percent=percent, frequent=frequent), "links")
    copies = some.groupBy("cls").agg(F.count("*").alias("copies"), F.min(key_of(some)).alias("least"))
    degree = links.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("linked").alias("linked"))
    root = components(links.where("a <> b").select("a", "b")).select(F.col("node").alias("cls"), "root")
    per_class = copies.join(root, "cls", "left").join(degree, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = per_class.groupBy("root").agg(F.min("least").alias("component"))
    per_class = per_class.join(named, "root").select("cls", "component", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = members.join(per_class, "cls", "left")
    alone = F.col("n") == 0
    return out.select(key_of(out).alias(key), F.col("n").alias("n_shingles"),
                      F.when(alone, key_of(out)).otherwise(F.col("component")).alias("component"),
                      F.when(alone, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"))
