"""Prefix trie of conversations as a z-fast trie, built in batches of Spark joins.

A conversation is a sequence of turns; a prefix is named by its depth and a
128-bit fingerprint, the running exclusive-or of the hashes of (position, turn).
The trie is a table of *compacted* nodes: a node stands for the prefixes that
are deeper than its parent (``name``) and not deeper than itself (``depth``). It
is hashed under its *handle*, the prefix whose depth is the two-fattest number
in that range (the one divisible by the largest power of two).

A batch of conversations finds its places by fat binary search: of the depths
that are still possible the two-fattest is looked up among the handles, a hit
raises the lower end to the node's depth, a miss lowers the upper end below the
probe. So a conversation costs one probe (one row of a join) for each halving of
its length. The node found last, or its child that begins with the next turn, is
the exit node; the edge tells how far the two agree. Then the batch is inserted:
edges are split where conversations leave them or end, and of what lies below,
prefixes that branch or end become nodes.

At the end the edges are expanded again: one row for each distinct prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words_expr

#: Batches by hash of the conversation: shares of seven, each about the size of all before it.
BATCHES = ((0,), (1, 2), (3, 4, 5, 6))
#: A prefix is hot if it is in more rows than one in HOT_SHARE (so there are HOT_SHARE hot ones at most) and HOT_ROWS; its rows are dealt over SALTS keys.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 2000, 32
#: Turns of a conversation that meet a per-conversation value in one key.
BLOCK = 4096
#: Members whose ids are joined to one text before they are hashed.
ENDS_ROWS = 4096
ID = ["d", "a", "b"]
_NODE = "struct<d:bigint,a:bigint,b:bigint,name:bigint,rep:bigint>"


def two_fattest(lo: str, hi: str):
    """The number in (lo, hi] that the largest power of two divides."""
    return F.expr(f"{hi} & shiftleft(-1L, cast(floor(log2({lo} ^ {hi})) AS int))")


# --- turns in order ------------------------------------------------------------------------------

def _dealt(rows: DataFrame, *order, name: str) -> DataFrame:
    """Rows sorted by ``c`` and ``order``, in partitions (``part``) that may cut a conversation, with their place (``at``)."""
    keys = [F.col("c"), *order]
    tie = F.col("__tie")
    return stored(rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
                  .drop("__tie").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)


def _running(rows: DataFrame, **values) -> DataFrame:
    """Running results along each conversation: ``name=(kind, expression)``, kind ``sum`` or ``xor``.

    Windows see one partition's piece of a conversation; what the pieces before it add is one row for
    each conversation that a partition boundary cuts, so at most as many as there are partitions.
    """
    agg = {"sum": F.sum, "xor": F.bit_xor}
    own = Window.partitionBy("part", "c").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = rows.groupBy("part", "c").agg(*[agg[k](v).alias(n) for n, (k, v) in values.items()])
    cut = pieces.groupBy("c").count().where("count > 1").select("c")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lead = pieces.join(F.broadcast(cut), "c").select("part", "c", *[agg[k](n).over(before).alias(f"__{n}") for n, (k, _) in values.items()])
    j = rows.join(F.broadcast(lead), ["part", "c"], "left")
    join = {"sum": lambda x, y: x + y, "xor": lambda x, y: x.bitwiseXOR(y)}
    return j.select(*rows.columns, *[join[k](agg[k](v).over(own), F.coalesce(f"__{n}", F.lit(0).cast("long"))).alias(n)
                                     for n, (k, v) in values.items()])


def own_turns(conversations: DataFrame, *, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, x, y, words): turns in order (by turn, null first, then by content), as two hashes and their number of words."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256)
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).alias("c"), F.col(turn).alias("turn"), digest.alias("digest"), F.size(words_expr(t)).cast("long").alias("words"))
    rows = _running(_dealt(rows, F.col("turn").asc_nulls_first(), F.col("digest"), name="turns"), pos=("sum", F.lit(1).cast("long")))
    half = lambda i: F.conv(F.substring("digest", i, 16), 16, -10).cast("long")
    return rows.select("c", "pos", half(1).alias("x"), half(17).alias("y"), "words")


def rebuilt(turns: DataFrame, every: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations and all conversations: the first h turns of conversation c - c % ``every`` (h = crc32(c) %
    ``shared``), then c's own after its first h."""
    h = F.crc32(F.col("c").cast("string")) % shared
    convs = turns.select("c").distinct()
    heads = turns.where((F.col("pos") < shared) & (F.col("c") % every == 0)).withColumnRenamed("c", "base")
    first = convs.withColumn("base", F.col("c") - F.col("c") % every).withColumn("h", h).join(heads, "base").where("pos <= h")
    rows = first.select("c", F.lit(0).alias("own"), "pos", "x", "y", "words").unionByName(
        turns.where(F.col("pos") > h).select("c", F.lit(1).alias("own"), "pos", "x", "y", "words"))
    return rows, convs


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, a, b, u, v, words, before, salt): every prefix of every conversation, with the fingerprint of its parent (u, v) and the words before it."""
    order = _running(_dealt(rows, F.col("own"), F.col("pos"), name="rebuilt"), d=("sum", F.lit(1).cast("long")))
    order = stored(order.select("c", "d", F.xxhash64("d", "x", "y").alias("p"), F.xxhash64("y", "x", "d").alias("q"), "words", "part", "at"), "depths")
    run = _running(order, a=("xor", F.col("p")), b=("xor", F.col("q")), after=("sum", F.col("words")))
    run = stored(run.select("c", "d", "a", "b", F.col("a").bitwiseXOR(F.col("p")).alias("u"), F.col("b").bitwiseXOR(F.col("q")).alias("v"),
                            "words", (F.col("after") - F.col("words")).alias("before")), "prefixes")
    least = max(HOT_ROWS, run.count() // HOT_SHARE)
    hot = run.groupBy(*ID).count().where(F.col("count") > least).select(*ID, F.lit(True).alias("hot"))  # HOT_SHARE rows at most
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("c"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return stored(run.join(F.broadcast(hot), ID, "left").withColumn("salt", salt).withColumn("hot", F.col("hot").isNotNull()), "salted")


class Trie:
    """The table of compacted nodes (without the root) over the prefixes ``p``.

    Columns: d, a, b (the node), name (its parent's depth), rep (a conversation through it), f, fa, fb (its
    handle), sa, sb (its first prefix), pa, pb (its parent).
    """

    def __init__(self, p: DataFrame, lengths: DataFrame):
        self.p, self.lengths, self.nodes = p, lengths, None
        self.hot = p.where("hot").select(*ID).distinct()

    # prefixes of a table of (conversation, depth)
    def _at(self, df: DataFrame, conv: str, depth: str, how: str = "inner", **names) -> DataFrame:
        side = self.p.select(F.col("c").alias("__c"), F.col("d").alias("__d"), *[F.col(v).alias(k) for k, v in names.items()])
        return df.join(side, (F.col(conv) == F.col("__c")) & (F.col(depth) == F.col("__d")), how).drop("__c", "__d")

    def _spread(self, nodes: DataFrame) -> DataFrame:
        """Nodes with a salt: hot prefixes once for each salt."""
        mark = F.broadcast(self.hot.withColumn("__hot", F.lit(True)))
        salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return nodes.join(mark, ID, "left").withColumn("salt", F.explode(salts)).drop("__hot")

    def insert(self, batch: DataFrame, rows: DataFrame) -> None:
        """Insert the conversations of ``batch`` (c, len), whose prefixes are ``rows``."""
        exits = self._exits(batch, rows)
        blocks = exits.select("c", "p", F.explode(F.expr(f"sequence(0L, len div {BLOCK})")).alias("block"), F.col("len").alias("own_len"))
        below = stored(rows.withColumn("block", F.expr(f"d div {BLOCK}")).join(blocks, ["c", "block"]).where("d > p").drop("block"), "below")
        new = below.groupBy(*ID).agg(F.min("c").alias("rep"), F.min(F.struct("u", "v")).alias("up"), F.max(F.col("d") == F.col("own_len")).alias("ends"))
        kids = new.groupBy((F.col("d") - 1).alias("d"), F.col("up.u").alias("a"), F.col("up.v").alias("b")).agg(F.count("*").alias("kids"))
        fresh = stored(new.join(kids, ID, "left").where("ends OR kids > 1").select(*ID, "rep"), "fresh")
        path = Window.partitionBy("c").orderBy("d")
        named = (below.select("c", "p", "salt", *ID).join(self._spread(fresh), [*ID, "salt"])
                 .withColumn("name", F.coalesce(F.lag("d").over(path), F.col("p"))).where("c = rep").select("d", "name", "rep"))
        if self.nodes is None:
            nodes = named
        else:
            cuts = exits.where("p > edge_name AND p < edge_d").select(
                F.struct(*[F.col(f"edge_{x}").alias(x) for x in ID]).alias("edge"), F.col("edge_name").alias("old"), F.col("edge_rep").alias("rep"), F.col("p").alias("d")).distinct()
            cuts = stored(cuts, "cuts")
            along = Window.partitionBy("edge").orderBy("d")
            split = cuts.withColumn("name", F.coalesce(F.lag("d").over(along), F.col("old"))).select("d", "name", "rep")
            moved = cuts.groupBy("edge.d", "edge.a", "edge.b").agg(F.max("d").alias("moved"))
            kept = self.nodes.join(moved, ID, "left").select("d", F.coalesce("moved", "name").alias("name"), "rep")
            nodes = kept.unionByName(split).unionByName(named)
        nodes = nodes.withColumn("f", two_fattest("name", "d")).withColumn("s", F.col("name") + 1)
        nodes = self._at(nodes, "rep", "d", a="a", b="b")
        nodes = self._at(nodes, "rep", "f", fa="a", fb="b")
        self.nodes = stored(self._at(nodes, "rep", "s", sa="a", sb="b", pa="u", pb="v"), "nodes")

    def _exits(self, batch: DataFrame, rows: DataFrame) -> DataFrame:
        """(c, len, p, edge_d, edge_a, edge_b, edge_name, edge_rep): how deep each conversation follows the
        trie, and the edge on which it leaves it or ends (null: at a node)."""
        if self.nodes is None:
            return batch.select("c", "len", F.lit(0).cast("long").alias("p"))
        zero = F.lit(0).cast("long")
        # lo, hi: depths that are still possible; node: the deepest one found so far; at: the depth of its handle
        state = batch.select("c", "len", zero.alias("lo"), F.col("len").alias("hi"), F.lit(None).cast(_NODE).alias("node"), zero.alias("at"))
        handles = stored(self._handles(), "handles")
        mine = rows.select("c", F.col("d").alias("f"), F.col("a").alias("fa"), F.col("b").alias("fb"), "salt")
        last = None
        while True:
            probe = state.where("lo < hi").withColumn("f", two_fattest("lo", "hi"))
            hit = probe.join(mine, ["c", "f"]).join(handles, ["f", "fa", "fb", "salt"], "left")
            found = F.col("hit").isNotNull()
            closed = state.where("lo >= hi")
            last = closed if last is None else last.unionByName(closed)
            state = stored(hit.select("c", "len", F.when(found, F.col("hit.d")).otherwise(F.col("lo")).alias("lo"),
                                      F.when(found, F.col("hi")).otherwise(F.col("f") - 1).alias("hi"), F.coalesce("hit", "node").alias("node"),
                                      F.when(found, F.col("f")).otherwise(F.col("at")).alias("at")), "search")
            if state.where("lo < hi").isEmpty():
                break
        last = last.unionByName(state).withColumn("e", F.coalesce("node.d", zero))
        # does the conversation hold all of the node found last?
        last = self._rows_at(last, rows, "e", xa="a", xb="b").withColumn(
            "whole", F.col("node").isNull() | F.coalesce((F.col("xa") == F.col("node.a")) & (F.col("xb") == F.col("node.b")), F.lit(False)))
        # if so, the edge is that of its child which begins with the next turn (if any), else its own
        last = self._rows_at(last.withColumn("s", F.col("e") + 1), rows, "s", sa="a", sb="b", salt="salt")
        starts = self.nodes.select(F.col("s").alias("d"), F.col("sa").alias("a"), F.col("sb").alias("b"), F.struct(*ID, "name", "rep").alias("child"))
        starts = self._spread(starts).select(F.col("d").alias("s"), F.col("a").alias("sa"), F.col("b").alias("sb"), "salt", "child")
        last = last.join(starts, ["s", "sa", "sb", "salt"], "left")
        last = stored(last.select(
            "c", "len", F.when(F.col("whole"), F.col("child")).otherwise(F.col("node")).alias("edge"),
            F.when(~F.col("whole"), F.col("at")).when(F.col("child").isNotNull(), F.col("s")).otherwise(F.col("e")).alias("from")), "edges")
        # how far the conversation and the edge agree
        edges = last.where("edge IS NOT NULL").select("edge.*").distinct()
        line = self._at(edges.select("rep", F.explode(F.sequence(F.col("name") + 1, F.col("d"))).alias("at")), "rep", "at", a="a", b="b")
        line = self._spread(line.select(F.col("at").alias("d"), "a", "b").distinct())
        spans = last.where("edge IS NOT NULL").select("c", "from", F.least("len", "edge.d").alias("to"))
        spans = spans.where(F.col("to") > F.col("from")).withColumn("block", F.explode(F.expr(f"sequence(`from` div {BLOCK}, `to` div {BLOCK})")))
        reach = (rows.withColumn("block", F.expr(f"d div {BLOCK}")).join(spans, ["c", "block"]).where("d > `from` AND d <= `to`")
                 .join(line, [*ID, "salt"], "left_semi").groupBy("c").agg(F.max("d").alias("deep")))
        return stored(last.join(reach, "c", "left").select(
            "c", "len", F.greatest(F.col("from"), F.coalesce("deep", F.lit(0).cast("long"))).alias("p"),
            *[F.col(f"edge.{x}").alias(f"edge_{x}") for x in (*ID, "name", "rep")]), "exits")

    def _rows_at(self, df: DataFrame, rows: DataFrame, depth: str, **names) -> DataFrame:
        side = rows.select("c", F.col("d").alias(depth), *[F.col(v).alias(k) for k, v in names.items()])
        return df.join(side, ["c", depth], "left")

    def _handles(self) -> DataFrame:
        h = self.nodes.select(F.col("f").alias("d"), F.col("fa").alias("a"), F.col("fb").alias("b"), F.struct(*ID, "name", "rep").alias("hit"))
        return self._spread(h).select(F.col("d").alias("f"), F.col("a").alias("fa"), F.col("b").alias("fb"), "salt", "hit")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(d, a, b, hash): SHA-256 of the decimal ids of each node's members, ascending and comma-joined.

    Ids are joined to texts of ``ENDS_ROWS`` in range-sorted partitions; the task that hashes a node reads these, one after the other.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out, k = None, [], [], 0
        for b in batches:
            for part, d, a, x, c in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if node is not None and (node != (part, d, a, x) or len(ids) >= ENDS_ROWS):
                    out.append((*node, k, ",".join(ids)))
                    ids, k = [], k + 1
                node = (part, d, a, x)
                ids.append(str(c))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "d", "a", "b", "k", "ids"), r, strict=True)) for r in out], schema)
                out = []
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "d", "a", "b", "k", "ids"), (*node, k, ",".join(ids)), strict=True))], schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            out = []
            for d, a, x, _, _, ids in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if node != (d, a, x):
                    if node is not None:
                        out.append((*node, h.hexdigest()))
                    node, h = (d, a, x), sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "a", "b", "hash"), r, strict=True)) for r in out], told)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "a", "b", "hash"), (*node, h.hexdigest()), strict=True))], told)

    long = pa.int64()
    schema = pa.schema([("part", long), ("d", long), ("a", long), ("b", long), ("k", long), ("ids", pa.string())])
    told = pa.schema([("d", long), ("a", long), ("b", long), ("hash", pa.string())])
    sorted_ = ends.select(*ID, "c").repartitionByRange(*ID, "c").sortWithinPartitions(*ID, "c")
    parts = stored(sorted_.select(F.spark_partition_id().cast("long").alias("part"), *ID, "c").mapInArrow(chunks, "part long, d long, a long, b long, k long, ids string"), "ends")
    return parts.repartition(*ID).sortWithinPartitions(*ID, "part", "k").select(*ID, "part", "k", "ids").mapInArrow(hashes, "d long, a long, b long, hash string")


def conversation_trie(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      every: int = 20, shared: int = 4) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Turns are ordered by ``turn`` (null first), equal ones
    by content; repeated rows are turns of their own; null roles and texts are empty; rows with a null
    ``key`` belong to no conversation and are left out; an empty table gives an empty result. Texts of any
    length count by their hash and number of words. ``key`` must be an integer. Other columns are not looked at.

    Equality of prefixes is that of 128-bit fingerprints. Plan: two range sorts of the turns; each batch
    makes one join row for each conversation and halving of its length; nothing of a conversation or node is
    gathered in one row, and hot prefixes are salted.
    """
    spark = conversations.sparkSession
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    rows, convs = rebuilt(stored(own_turns(conversations, key=key, turn=turn, role=role, text=text), "own"), every, shared)
    convs = stored(convs.select(F.col("c").cast("long").alias("c")), "convs")
    total = convs.agg(F.count("*").alias("n"), F.min("c").alias("c")).first()
    if not total["n"]:
        return spark.createDataFrame([], out)
    p = prefixes(rows.withColumn("c", F.col("c").cast("long")))
    lengths = stored(p.groupBy("c").agg(F.max("d").alias("len")), "lengths")
    trie = Trie(p, lengths)
    turn_of = F.pmod(F.xxhash64("c"), F.lit(sum(map(len, BATCHES))))
    for share in BATCHES:
        own = lengths.where(turn_of.isin(*share))
        if not own.isEmpty():
            trie.insert(own, p.where(turn_of.isin(*share)))
    turnless = convs.join(lengths, "c", "left_anti").select(*[F.lit(0).cast("long").alias(x) for x in ID], "c")
    if trie.nodes is None:
        nodes = None
        ends = turnless
        root = (1, 0, 0)
    else:
        nodes, ends, root = _expanded(trie, turnless)
    hashes = _end_hashes(ends)
    top = spark.createDataFrame([(0, 0, 0, total["c"], None, total["n"], root[1], root[0], root[2])],
                                "d long, a long, b long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    every_node = top if nodes is None else top.unionByName(nodes)
    return every_node.join(hashes, ID, "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("hash", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _expanded(trie: Trie, turnless: DataFrame) -> tuple[DataFrame, DataFrame, tuple[int, int, int]]:
    """(a row for each prefix but the empty one, (d, a, b, c) of all ends, the root's leaves, children and saved tokens)."""
    member = stored(trie.p.select("c", "salt", *ID).join(trie._spread(trie.nodes.select(*ID)), [*ID, "salt"]).drop("salt"), "members")
    ends = member.join(trie.lengths, "c").where("d = len").select(*ID, "c")
    stats = member.groupBy(*ID).agg(F.count("*").alias("n"), F.min("c").alias("owner"))
    kids = trie.nodes.groupBy(F.col("name").alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"))
    n = trie.nodes.select(*ID, "name", "s", "pa", "pb").join(stats, ID).join(kids, ID, "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long")))
    n = trie._at(trie._at(n, "owner", "s", begin="before"), "owner", "d", last="before", words="words")
    n = stored(n.withColumn("own", (F.col("n") - 1) * (F.col("last") + F.col("words") - F.col("begin"))).drop("last", "words"), "counted")
    # what lies below a node: each node's worth is its owner's, summed along the owner's path from the end, then over the members
    worth = n.select(F.col("owner").alias("c"), "d", "own", (F.col("kids") == 0).cast("long").alias("leaf"))
    up = Window.partitionBy("c").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    sums = member.join(worth, ["c", "d"], "left").select(*ID, F.sum(F.coalesce("own", zero)).over(up).alias("own"), F.sum(F.coalesce("leaf", zero)).over(up).alias("leaf"))
    below = sums.groupBy(*ID).agg(F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"))
    parents = n.select(F.col("d").alias("name"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("up"))
    least = trie.lengths.agg(F.min("c")).first()[0]
    none = turnless.agg(F.min("c")).first()[0]
    first = least if none is None else min(least, none)
    full = n.drop("own").join(below, ID).join(parents, ["name", "pa", "pb"], "left").withColumn("up", F.coalesce("up", F.lit(first)))
    full = stored(full, "compacted")
    edge = full.withColumn("at", F.explode(F.sequence("s", "d")))
    edge = trie._at(edge, "owner", "at", here="before", ha="a", hb="b")
    nodes = edge.select(
        F.col("at").alias("d"), F.col("ha").alias("a"), F.col("hb").alias("b"), F.col("owner").alias("conv_id"),
        F.when(F.col("at") == F.col("s"), F.col("up")).otherwise(F.col("owner")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("at") == F.col("d"), F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("here") - F.col("begin"))).alias("saved_tokens"))
    tops = full.where("name = 0").agg(F.sum("leaves"), F.count("*"), F.sum("saved")).first()
    return nodes, ends.unionByName(turnless), (tops[0], tops[1], tops[2])
