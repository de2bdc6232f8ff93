"""Streams that stop, start again and replay; buckets; the progress log; event-time windows."""

import os

import pytest
from pyspark.sql import functions as F

from relindex.operators import ingest
from relindex.operators import metrics as MT
from relindex.operators import progress as PG
from relindex.sources.buckets import BucketStore
from relindex.streaming import ingest as ST
from tests.conftest import headers_df

DATE = "Mon, 06 Feb 1995 10:00:00 +0000"


def made(spark, lo, hi, title="Show"):
    return headers_df(spark, [(f"alt.binaries.tv{n % 2}", n, f"<m{n}@x>", f"[tv] {title}.{"abcdefg"[n % 7]}.S01E0{n % 5}.mkv (0{n % 3}/7) yEnc", 1000 + n, DATE)
                              for n in range(lo, hi)])


def wanted(spark, headers):
    p = ingest.gate(ingest.materialize(ingest.parse_headers(headers), "t"))
    rel = ingest.build_releases(p, gated=False)
    return sorted(tuple(r) for r in rel.select("norm_title", "category_id", "size_bytes", "part_count", "tags").collect())


def stored(spark, root):
    return sorted(tuple(r) for r in ST.release_store(spark, root).read("releases")
                  .select("norm_title", "category_id", "size_bytes", "part_count", "tags").collect())


def test_stop_new_file_other_batch_size_start(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    for k in range(3):
        made(spark, 50 * k, 50 * k + 50).coalesce(1).write.mode("append").parquet(src)
    ST.incremental_ingest(spark, src, root, files_per_trigger=1, buckets=8).awaitTermination()
    first = made(spark, 0, 150)
    assert stored(spark, root) == wanted(spark, first)
    more = made(spark, 150, 230, "Film")
    more.coalesce(1).write.mode("append").parquet(src)
    made(spark, 140, 150).coalesce(1).write.mode("append").parquet(src)  # headers that are known already
    ST.incremental_ingest(spark, src, root, files_per_trigger=10, buckets=8).awaitTermination()
    assert stored(spark, root) == wanted(spark, first.unionByName(more))
    before = ST.release_store(spark, root).batch_id()
    ST.incremental_ingest(spark, src, root, files_per_trigger=10, buckets=8).awaitTermination()  # nothing new
    assert ST.release_store(spark, root).batch_id() == before
    state = {r["grp"]: r for r in ST.progress_log(spark, root).state().collect()}
    assert {g: r["last_article"] for g, r in state.items()} == {"alt.binaries.tv0": 228, "alt.binaries.tv1": 229}


def test_replayed_batch_is_skipped_and_idle_groups_are_marked(spark, tmp_path):
    root = str(tmp_path / "root")
    store, log = ST.release_store(spark, root, buckets=4), ST.progress_log(spark, root)
    ST.apply_batch(store, log, made(spark, 0, 40), 0)
    once = stored(spark, root)
    ST.apply_batch(store, log, made(spark, 0, 40), 0)  # replay
    assert stored(spark, root) == once
    ST.apply_batch(store, log, made(spark, 0, 40), 1)  # the same headers again: nothing is inserted
    assert {r["grp"] for r in PG.irrelevant_groups(log.state()).collect()} == {"alt.binaries.tv0", "alt.binaries.tv1"}
    ST.apply_batch(store, log, made(spark, 40, 80), 2, curated=True)
    assert {r["grp"]: r["last_article"] for r in PG.cursors(log.state()).collect()} == {"alt.binaries.tv0": 78, "alt.binaries.tv1": 79}


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_a_batch_writes_the_buckets_of_its_titles_only(spark, tmp_path):
    root = str(tmp_path / "s")
    store = BucketStore(spark, root, {"t": "k"}, buckets=32, keep=2)
    rows = spark.range(2000).select(F.concat(F.lit("title"), "id").alias("k"), F.col("id").alias("v"))
    store.commit(0, {"t": None}, t=rows)
    whole, at = _bytes(f"{root}/data"), store.manifest()
    new = spark.createDataFrame([("title7", -1), ("title8", -2)], "k string, v long")
    touched = store.touched(new, "k")
    part = store.read("t", touched)
    store.commit(1, {"t": touched}, t=part.join(new, "k", "left_anti").unionByName(new))
    now = store.manifest()
    assert BucketStore(spark, root, {"t": "k"}, buckets=5).buckets == 32  # as it was made
    assert {x for x in now if now[x] != at[x]} == {("t", b) for b in touched} and len(touched) <= 2
    assert _bytes(f"{root}/data") - whole < whole * 3 * len(touched) / 32
    got = {r["k"]: r["v"] for r in store.read("t").collect()}
    assert len(got) == 2000 and got["title7"] == -1 and got["title9"] == 9
    for b in (2, 3, 4):  # old versions go, buckets that are still named stay
        store.commit(b, {"t": touched}, t=store.read("t", touched))
    assert len(os.listdir(f"{root}/commits")) == 2 and store.read("t").count() == 2000
    assert len([v for v in os.listdir(f"{root}/data")]) == 3  # the first (carried over) and the last two
    store.commit(5, {"t": touched}, t=store.read("t", touched).where("false"))  # a bucket may become empty
    assert store.read("t", touched) is None and store.read("t").count() < 2000


def test_an_unfinished_commit_is_not_seen(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), {"t": "k"}, buckets=2)
    assert store.read("t") is None and store.batch_id() is None
    store.commit(0, {"t": None}, t=spark.createDataFrame([("a", 1)], "k string, v long"))
    half = tmp_path / "s" / "commits" / "000000000001"
    half.mkdir()
    (half / "part-0.json").write_text('{"tbl": "t", "bucket": 0, "path": "/nowhere"}')
    assert store.batch_id() == 0 and store.read("t").count() == 1


def replay(events):
    """The state machine of the log, one event after the other."""
    rows, mode = {}, None
    for _, kind, grp, article, keep, m in sorted(events, key=lambda e: e[0]):
        if kind == "advance":
            rows[grp] = (article, False)
        elif kind == "irrelevant":
            rows[grp] = (rows.get(grp, (0, False))[0], True)
        elif kind == "reset":
            rows = {g: v for g, v in rows.items() if g in (keep or [])}
        elif kind == "mode":
            mode = m
        elif mode != "curated":
            rows, mode = {}, "curated"
    return rows, mode


@pytest.mark.parametrize("seed", range(6))
def test_progress_log_equals_the_state_machine(spark, seed):
    import random
    rng = random.Random(seed)
    events = []
    for seq in range(rng.choice([0, 1, 60, 120])):
        kind = rng.choice(["advance"] * 8 + ["irrelevant"] * 3 + ["reset", "reset", "mode", "curated"])
        keep = rng.choice([None, [], ["g1", "g2", "g2"], ["g1"], ["g9", "g3"]]) if kind == "reset" else None
        events.append((seq, kind, f"g{rng.randrange(5)}" if kind in ("advance", "irrelevant") else None, rng.randrange(1000) if kind == "advance" else None,
                       keep, rng.choice(["all", "curated"]) if kind == "mode" else None))
    df = spark.createDataFrame(events, PG.EVENTS)
    rows, mode = replay(events)
    for e in (df, PG.compacted(df)):
        assert {r["grp"]: (r["last_article"], r["irrelevant"]) for r in PG.group_state(e).collect()} == rows
        assert PG.group_mode(e).first()["mode"] == mode


def test_progress_log_folder(spark, tmp_path):
    log = PG.ProgressLog(spark, str(tmp_path / "log"))
    assert log.state().count() == 0
    log.append("a", spark.createDataFrame([("advance", "x", 5), ("advance", "y", 7)], "kind string, grp string, article long"))
    log.mark_irrelevant("b", "y")
    log.set_mode("c", "all")
    state = lambda: {r["grp"]: (r["last_article"], r["irrelevant"]) for r in log.state().collect()}
    assert state() == {"x": (5, False), "y": (7, True)}
    log.reset("d", ["y", ""])
    assert state() == {"y": (7, True)}
    log.reset("d", ["x"])  # written again: replaces itself
    assert state() == {"x": (5, False)}
    log.reset_for_curated("e")
    assert state() == {}


def test_rate_windows_over_two_starts(spark, tmp_path):
    src, out = str(tmp_path / "ev"), str(tmp_path / "out")
    cols = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    row = F.expr("timestampadd(SECOND, id * 97 % 7200, timestamp'2024-01-01 00:00:00')")
    every = spark.range(1000).select(F.col("id").alias("event_id"), row.alias("ts"), (F.col("id") % 5).alias("user_id"),
                                     F.lit("e").alias("event_type"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("props"))
    every = spark.createDataFrame(every.collect(), cols)
    every.where("event_id < 750").repartition(5).write.parquet(src)
    kw = {"window": "10 minutes", "delay_seconds": 7200}
    ST.rate_window_stream(spark, src, out, files_per_trigger=2, **kw).awaitTermination()
    every.where("event_id >= 750").repartition(3).write.mode("append").parquet(src)
    ST.rate_window_stream(spark, src, out, files_per_trigger=20, **kw).awaitTermination()
    want = sorted(tuple(r) for r in MT.rate_window_counts(every, "10 minutes", 3).collect())
    assert sorted(tuple(r) for r in ST.rate_windows(spark, out, 3).drop("open").collect()) == want
    assert ST.late_events(spark, out).count() == 0
    # far ahead in time: all older windows close; what comes for them now is late
    spark.createDataFrame([(1, "2024-02-01 00:00:00", 1)], "event_id long, t string, user_id long").select(
        "event_id", F.to_timestamp("t").alias("ts"), "user_id").write.mode("append").parquet(src)
    ST.rate_window_stream(spark, src, out, **kw).awaitTermination()
    assert ST.window_store(spark, out).read("open").count() == 1  # nothing else is held
    every.where("event_id < 4").coalesce(1).write.mode("append").parquet(src)
    ST.rate_window_stream(spark, src, out, **kw).awaitTermination()
    late = ST.late_events(spark, out).collect()
    assert len(late) == 4 and all(r["late_micros"] > 0 for r in late)
    assert sorted(tuple(r) for r in ST.rate_windows(spark, out, 3).where("NOT open").drop("open").collect()) == want
