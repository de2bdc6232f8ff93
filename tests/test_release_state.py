"""Keyed release state against the batch table: repeats, restarts, expiry."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from relindex.operators import ingest
from relindex.streaming import release_state as RS
from tests.conftest import headers_df
from tests.test_streaming import made, wanted


def kept(spark, root):
    return sorted(tuple(r) for r in RS.releases(spark, root).select("norm_title", "category_id", "size_bytes", "part_count", "tags").collect())


def add(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_equals_batch_with_repeats_and_restart(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    headers = made(spark, 0, 60).unionByName(made(spark, 60, 75, "Other").withColumn("subject", F.lit("[tv] One.title.mkv (1/7) yEnc")))
    add(headers.where("article_number < 40").unionByName(headers.where("article_number < 10")), src)  # repeats inside a batch
    RS.keyed_ingest(spark, src, root, buckets=4, shards=3).awaitTermination()
    assert kept(spark, root) == wanted(spark, headers.where("article_number < 40"))
    add(headers.where("article_number BETWEEN 20 AND 39"), src)  # nothing but repeats
    before = RS.partial_store(spark, root).read("partials").collect()
    RS.keyed_ingest(spark, src, root, buckets=4, shards=3).awaitTermination()
    assert sorted(RS.partial_store(spark, root).read("partials").collect(), key=str) == sorted(before, key=str)
    add(headers.where("article_number BETWEEN 30 AND 64"), src)
    add(headers.where("article_number > 64"), src)
    RS.keyed_ingest(spark, src, root, files_per_trigger=1, buckets=4, shards=3).awaitTermination()
    assert kept(spark, root) == wanted(spark, headers)


def test_replayed_batch_is_skipped_and_nothing_kept_emits_nothing(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    add(headers_df(spark, [("alt.binaries.tv", 1, "<a@x>", "[tv] Show.a.mkv (1/2) yEnc", 0, None), (None, None, None, None, None, None)]), src)
    RS.keyed_ingest(spark, src, root, buckets=2, shards=2).awaitTermination()
    assert RS.releases(spark, root) is None  # no header has a size
    add(made(spark, 0, 12), src)
    RS.keyed_ingest(spark, src, root, buckets=2, shards=2).awaitTermination()
    store = RS.partial_store(spark, root)
    rows = store.read("partials")
    at = store.batch_id()
    RS.apply_emitted(store, rows.withColumn("seg_total", F.lit(0).cast("long")), at)
    assert store.batch_id() == at and kept(spark, root) == wanted(spark, made(spark, 0, 12))


def test_expired_states_begin_a_new_epoch(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    add(made(spark, 0, 20), src)
    RS.keyed_ingest(spark, src, root, buckets=2, shards=1, ttl_ms=1).awaitTermination()
    add(made(spark, 20, 40), src)
    RS.keyed_ingest(spark, src, root, buckets=2, shards=1, ttl_ms=1).awaitTermination()
    p = RS.partial_store(spark, root).read("partials")
    assert p.select("epoch").distinct().count() == 2
    assert kept(spark, root) == wanted(spark, made(spark, 0, 40))


def test_fold_of_folds():
    a = ("c", 1, "en", "mkv", "g", ["b", "a"], 5, 1, None, 7, "m", 3)
    b = ("d", 2, "de", None, "h", None, None, 1, None, None, "n", 3)
    assert RS.folded(None, a) == a
    assert RS.folded(a, b) == ("d", 2, "de", None, "h", ["a", "b"], 5, 2, None, None, "n", 3)


class _Value:
    def __init__(self, calls):
        self.at, self.calls = None, calls

    def get(self):
        self.calls.append("get")
        return self.at

    def exists(self):
        self.calls.append("exists")
        return self.at is not None

    def update(self, value):
        self.calls.append("update")
        self.at = value


class _Map:
    def __init__(self, calls):
        self.at, self.calls, self.largest = {}, calls, 0

    def containsKey(self, key):
        self.calls.append("contains")
        return key in self.at

    def getValue(self, key):
        self.calls.append("get")
        return self.at[key]

    def updateValue(self, key, value):
        self.calls.append("update")
        self.at[key] = value
        self.largest = max(self.largest, len(value[0]) if isinstance(value[0], list) else 1)

    def iterator(self):
        self.calls.append("iterator")
        return iter(self.at.items())


class _Handle:
    def __init__(self):
        self.calls, self.states = [], {}

    def getValueState(self, name, schema, ttl=None):
        return self.states.setdefault(name, _Value(self.calls))

    def getMapState(self, name, key, value, ttl=None):
        return self.states.setdefault(name, _Map(self.calls))


def _header(i, grp="g", size=10):
    return Row(keep=True, grp=grp, message_id=f"<{i}@x>", seg_id=f"{i}@x", size=size, bytes=size, article_number=i, posted_micros=i, tags=["b", f"t{i % 3}"],
               category="c", category_id=1, language="en", extension=None, source_group=grp)


def _fed(batches, grp_of=lambda i: "g"):
    handle, state = _Handle(), RS.ReleaseState()
    state.init(handle)
    last = None
    for ids in batches:
        for row in state.handleInputRows(("t", 0), iter([_header(i, grp_of(i)) for i in ids]), None):
            last = row
    return last, handle


def test_state_calls_do_not_follow_the_headers():
    _, handle = _fed([range(200), range(100, 250)])
    assert len(handle.calls) <= 8  # two batches of one state; four calls for each header were 1000
    _, handle = _fed([range(k, 20_000, 4) for k in range(4)])
    assert len(handle.calls) < 20_000 / 10


def test_pages_split_and_keep_every_id():
    rnd = random.Random(3)
    batches = [[rnd.randrange(9000) for _ in range(n)] for n in (10, 100, 240, 30, 3000, 1, 700, 2500, 4000)]
    last, handle = _fed(batches, lambda i: f"g{i % 2}")
    every = {i for b in batches for i in b}
    pages = handle.states["pages"]
    assert last["seg_count"] == len(every) and last["seg_total"] == 10 * len(every)
    assert sorted((c["grp"], c["n_headers"], c["posted_micros"]) for c in last["candidates"]) == [
        (f"g{k}", sum(i % 2 == k for i in every), min(i for i in every if i % 2 == k)) for k in (0, 1)]
    assert {m for seen, _ in pages.at.values() for m, _ in seen} == {f"<{i}@x>" for i in every}
    assert sum(len(seen) for seen, _ in pages.at.values()) == len(every) and len(pages.at) > 16
    # a batch may overfill a page before it is split, but no value holds a fixed share of the title
    assert max(len(seen) for seen, _ in pages.at.values()) < 4 * RS.PAGE
    assert next(iter(RS.ReleaseState.handleInputRows(_again(handle), ("t", 0), iter([_header(i, f"g{i % 2}") for i in every]), None)), None) is None


def _again(handle):
    state = RS.ReleaseState()
    state.init(handle)
    return state


def test_one_segment_of_two_groups_counts_once():
    handle, state = _Handle(), RS.ReleaseState()
    state.init(handle)
    out = list(state.handleInputRows(("t", 0), iter([_header(1, "h", 7), _header(1, "g", 5), _header(1, "g", 9)]), None))
    assert [(r["seg_count"], r["seg_total"]) for r in out] == [(1, 5)]
    assert sorted((c["grp"], c["size_sum"]) for c in out[0]["candidates"]) == [("g", 5), ("h", 7)]
