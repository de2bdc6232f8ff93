"""Releases as keyed state (K4) without repeated message ids (K3).

The stream of headers is parsed by the native projection and dealt by (title, shard of the message id) to a
state processor, so a title with a third of all headers is as many small states. Each state holds

* ``total``: count and size of the segments, the epoch (the time at which this state began), for each group the fold
  of its headers (first attributes, sizes, tags, least date, as E1 makes it), and the ids while they are few;
* ``pages``: the ids of a state with more than ``PAGE`` of them, dealt by their hash over pages of about that many.

Ids are the (message id, group) pairs that came (a header that comes again is dropped, in the same batch or any later
one) and the segment ids that count, whatever group they came in (the first one stays). A call to the state costs far
more than a row, so a batch reads and writes ``total`` once for each state, and a page once however many of its ids
come; pages split one at a time as they fill, so no value grows with the title.

A state that grows emits its totals; nothing is emitted for repeats. States expire after ``ttl_ms`` without
growth: a later header of the title begins a new epoch, whose totals are added to those of the old one; ids are
known as repeats for at least that long after they came. 0 keeps them for ever. A store made before the pages has
another state and must be made anew.

The emitted rows go to a bucketed table (title, shard, epoch), in which a row replaces its forerunner; a replayed
batch is skipped. ``releases`` adds the partial rows up with the functions of the batch job, so what it returns does not
depend on files, batches or order (but for a message id that comes with different sizes: the first one to come stays).

The state lies in RocksDB, in the checkpoint of the store; a lost executor's states are read from there.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ingest
from ..session import drop_batch_shuffles
from ..sources.buckets import BucketStore
from ..sources.headers import HEADER_SCHEMA

# the processor goes to the executors by value: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
         "spark.sql.streaming.noDataMicroBatches.enabled": "false"}

#: What the fold keeps of a group's headers: the attributes of the first, then the sums.
_FIRST = ("category", "category_id", "language", "extension", "source_group")
_CAND = ("category string, category_id int, language string, extension string, source_group string, tags array<string>, "
         "size_sum long, n_headers long, posted_micros long, article_number long, message_id string, bytes long")
_FOLDS = f"array<struct<grp:string,{_CAND.replace(' ', ':').replace(',:', ',')}>>"
EMITTED = f"title string, shard int, epoch long, seg_count long, seg_total long, candidates {_FOLDS}"


def _order(*values):
    """Nulls first, as Spark orders them."""
    return tuple((v is not None, v) for v in values)


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def folded(a: tuple | None, b: tuple) -> tuple:
    """Two folds of one group's headers as one (values in the order of ``_CAND``)."""
    if a is None:
        return b
    first = min(a, b, key=lambda c: _order(*c[9:12]))
    size = a[6] if b[6] is None else b[6] if a[6] is None else a[6] + b[6]
    tags = sorted({t for c in (a, b) for t in c[5] or () if t is not None})
    return (*first[:5], tags, size, a[7] + b[7], _least(a[8], b[8]), *first[9:12])


#: Ids that one value of the state holds, about.
PAGE = 256

_IDS = "seen array<struct<message_id:string,grp:string>>, segs array<string>"


def page_of(key: str, pages: int) -> int:
    """The page of an id among ``pages`` (linear hashing: with one page more, the ids of a single page are dealt anew)."""
    half = 1 << (pages.bit_length() - 1)
    n = zlib.crc32(key.encode()) % (2 * half)
    return n if n < pages else n - half


class Ids:
    """Message ids with their groups, and the segment ids that count."""

    def __init__(self, seen=None, segs=None):
        self.seen, self.segs = {tuple(x) for x in seen or ()}, set(segs or ())

    def row(self) -> tuple:
        return sorted(self.seen, key=lambda x: _order(*x)), sorted(self.segs)

    def deal(self, pages: int) -> dict[int, Ids]:
        """The same ids by page; a segment lies on the page of the message id it was read from."""
        out: dict[int, Ids] = {}
        for m, g in self.seen:
            out.setdefault(page_of(_page_key(m), pages), Ids()).seen.add((m, g))
        for x in self.segs:
            out.setdefault(page_of(x, pages), Ids()).segs.add(x)
        return out


def _page_key(message_id: str) -> str:
    """What a message id and its segment id have in common."""
    return message_id.strip("<>")


class ReleaseState(StatefulProcessor):
    def __init__(self, ttl_ms: int = 0):
        self.ttl = ttl_ms or None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", f"n long, size long, epoch long, ids long, n_pages int, folds {_FOLDS}, {_IDS}", self.ttl)
        self.pages = handle.getMapState("pages", "page int", _IDS, self.ttl)

    def _page(self, page: int) -> Ids:
        got = self.pages.getValue((page,)) if self.pages.containsKey((page,)) else None
        return Ids(*got) if got is not None else Ids()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[tuple, Row] = {}
        for r in rows:
            if r["keep"]:
                k, at = (r["message_id"], r["grp"]), (r["article_number"], r["bytes"])
                if k not in new or _order(*at) < _order(new[k]["article_number"], new[k]["bytes"]):
                    new[k] = r
        if not new:
            return
        n, size, epoch, ids, pages, had, *inline = self.total.get() or (
            0, 0, timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0, 0, 0, [], [], [])
        parts: dict[int, list] = {}  # one page after the other, so that few are held at a time
        for k in new:
            parts.setdefault(page_of(_page_key(k[0]), pages) if pages else 0, []).append(k)
        grown: dict[tuple, Row] = {}
        here = Ids(*inline)
        for page, keys in parts.items():
            known = self._page(page) if pages else here
            fresh = [k for k in keys if k not in known.seen]
            for k in sorted(fresh, key=lambda k: _turn(new[k])):
                r = new[k]
                known.seen.add(k)
                if r["seg_id"] is not None and r["seg_id"] not in known.segs:
                    known.segs.add(r["seg_id"])
                    n, size = n + 1, size + (r["size"] or 0)
                grown[k] = r
            if pages and fresh:
                self.pages.updateValue((page,), known.row())
        if not grown:
            return
        folds = {f[0]: tuple(f[1:]) for f in had}
        batch: dict[str, tuple] = {}
        for r in sorted(grown.values(), key=_turn):
            one = (*(r[c] for c in _FIRST), r["tags"], r["size"], 1, r["posted_micros"], r["article_number"], r["message_id"], r["bytes"])
            batch[r["grp"]] = folded(batch.get(r["grp"]), one)
        for grp, f in batch.items():
            folds[grp] = folded(folds.get(grp), f)
        ids += len(grown)
        pages, here = self._split(ids, pages, here)
        told = [(grp, *f) for grp, f in folds.items()]
        self.total.update((n, size, epoch, ids, pages, told, *here.row()))
        names = ["grp", *(c.split()[0] for c in _CAND.split(", "))]
        yield Row(title=key[0], shard=key[1], epoch=epoch, seg_count=n, seg_total=size,
                  candidates=[Row(**dict(zip(names, f, strict=True))) for f in told])

    def _split(self, ids: int, pages: int, here: Ids) -> tuple[int, Ids]:
        """Pages for ``ids`` ids: those of a small state go to their first pages, then full ones are split in turn."""
        if ids <= PAGE:
            return pages, here
        if not pages:
            pages = -(-ids // PAGE)
            for page, part in here.deal(pages).items():
                self.pages.updateValue((page,), part.row())
            here = Ids()
        while ids > pages * PAGE:
            page, pages = pages - (1 << (pages.bit_length() - 1)), pages + 1
            parts = self._page(page).deal(pages)
            for to in (page, pages - 1):
                self.pages.updateValue((to,), parts.get(to, Ids()).row())
        return pages, here

    def close(self) -> None:
        pass


def _turn(r: Row):
    return _order(r["grp"], r["article_number"], r["message_id"], r["bytes"])


def partial_store(spark: SparkSession, root: str, buckets: int = 64) -> BucketStore:
    return BucketStore(spark, f"{root.rstrip('/')}/partials", {"partials": "title"}, buckets)


def _store_batch(store: BucketStore, batch: DataFrame, batch_id: int) -> None:
    apply_emitted(store, batch, batch_id)
    drop_batch_shuffles(batch)


def apply_emitted(store: BucketStore, batch: DataFrame, batch_id: int) -> None:
    """Emitted rows replace those of the same (title, shard, epoch); only buckets of their titles are written."""
    done = store.batch_id()
    if done is not None and done >= batch_id:
        return
    new = ingest.materialize(batch, "stream_emitted")
    touched = store.touched(new, "title")
    if not touched:
        ingest.drop_table(new)
        return
    old, rows = store.read("partials", touched), new
    if old is not None:
        rows = old.join(new.select("title", "shard", "epoch"), ["title", "shard", "epoch"], "left_anti").unionByName(new)
    store.commit(batch_id, {"partials": touched}, partials=rows)
    ingest.drop_table(new)


def keyed_ingest(spark: SparkSession, source_dir: str, root: str, files_per_trigger: int = 1, buckets: int = 64,
                 shards: int = 16, ttl_ms: int = 0):
    """K3 + K4: start the stream, or go on with it; returns the ``StreamingQuery``. ``shards`` must not change for a root."""
    root = root.rstrip("/")
    store = partial_store(spark, root, buckets)
    src = (spark.readStream.schema(HEADER_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .option("recursiveFileLookup", "true").parquet(source_dir))
    shard = F.pmod(F.xxhash64(F.coalesce("seg_id", "message_id")), F.lit(shards)).cast("int")
    # a batch of few files is dealt out before its parse
    rows = ingest.parse_headers(src.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))).select(
        F.col("dedupe_key").alias("title"), shard.alias("shard"), "keep", "grp", "message_id", "seg_id", "size", "bytes",
        "article_number", F.unix_micros("posted_at").alias("posted_micros"), "tags", *_FIRST)
    out = rows.groupBy("title", "shard").transformWithState(ReleaseState(ttl_ms), EMITTED, "Update", "ProcessingTime" if ttl_ms else "None")
    # a query takes the settings of its start with it; without the second one, expiry makes empty batches for ever
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        return (out.writeStream.outputMode("update").foreachBatch(lambda df, bid: _store_batch(store, df, bid))
                .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def candidates(partials: DataFrame) -> DataFrame:
    """One candidate per (grp, title), as ``ingest.fold_releases`` gives it."""
    c = partials.select("title", F.explode("candidates").alias("c")).select("title", "c.*")
    return ingest.merge_candidates(c.select(
        "grp", F.col("title").alias("dedupe_key"), *_FIRST, "tags", "size_sum", "n_headers", F.timestamp_micros("posted_micros").alias("posted_at"),
        F.struct(*ingest.ORDER_COLS).alias("first_ord")))


def releases(spark: SparkSession, root: str) -> DataFrame | None:
    """The release table (ungated) from the emitted totals; None before the first batch."""
    p = partial_store(spark, root).read("partials")
    if p is None:
        return None
    tot = (p.groupBy(F.col("title").alias("norm_title")).agg(F.sum("seg_total").alias("seg_total"), F.sum("seg_count").alias("seg_count"))
           .where("seg_count > 0"))
    return ingest.releases_from(candidates(p), tot)
