"""What jobs leave on disk, and that they make no table twice."""

import os
import time

from pyspark.sql import functions as F

from relindex.operators import ingest, upsert
from relindex.plans import common as K
from relindex.plans import queries as Q
from relindex.session import checkpoint_dir
from relindex.streaming import ingest as ST
from relindex.streaming import release_state as RS
from tests.conftest import headers_df

SF = "/root/testdata/sf0.001"


def folders(spark, *names):
    return {x for x in os.listdir(checkpoint_dir(spark).removeprefix("file://")) if x.startswith(names)}


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}


def made(spark, n=60):
    return headers_df(spark, [(f"alt.binaries.tv{i % 2}", i, f"<m{i}@x>", f"[tv] Show.{'abcdefg'[i % 7]}.S01E0{i % 5}.mkv (0{i % 3}/7) yEnc", 1000 + i,
                               "Mon, 06 Feb 1995 10:00:00 +0000") for i in range(n)])


def test_upsert_drops_the_headers_and_takes_stored_folds(spark):
    before = folders(spark, "parsed_headers")
    got = Q.q_upsert_increment(spark, SF)
    assert folders(spark, "parsed_headers") == before
    p = K.parsed(spark, SF)
    whole = ingest.build_releases(p).select("norm_title", "category_id", "size_bytes", "part_count")
    assert got.count() and not got.select(*whole.columns).exceptAll(whole).count() and not whole.exceptAll(got.select(*whole.columns)).count()
    base, batch = (p.where(F.col("article_number") % 10 == k) for k in (1, 0))
    rel = ingest.with_storage_columns(ingest.build_releases(base, gated=False))
    state = rel, ingest.collect_segments(base), ingest.fold_releases(base)
    read = upsert.upsert(*state, batch)
    stored = upsert.upsert(*state, None, ingest.fold_releases(batch), ingest.collect_segments(batch))
    for x, y in zip(read, stored, strict=True):
        assert x.count() == y.count() and not x.exceptAll(y).count()


def test_backfill_parses_the_headers_once(spark, monkeypatch):
    calls, parse = [], ingest.parse_headers
    monkeypatch.setattr(ingest, "parse_headers", lambda *a, **kw: calls.append(1) or parse(*a, **kw))
    assert Q.q_backfill_match(spark, SF).count() and len(calls) == 1


def test_a_stream_leaves_no_tables_of_its_batches(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    before = folders(spark, "stream_")
    ST.stage_header_files(made(spark), src, 2)
    ST.incremental_ingest(spark, src, root, buckets=4).awaitTermination()
    assert ST.release_store(spark, root).read("segments").count() == 60 and folders(spark, "stream_") == before


def test_staged_headers_are_dealt_once(spark, monkeypatch):
    plans, stage = [], ST.stage_header_files
    monkeypatch.setattr(ST, "stage_header_files", lambda h, *a, **kw: (plans.append(h._jdf.queryExecution().toString()), stage(h, *a, **kw)))
    assert Q.q_stream_progress(spark, SF).count() == 9
    assert len(plans) == 1 and "REPARTITION_BY_NUM" not in plans[0]


def test_keyed_stream_leaves_no_shuffle_files(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    tables, before = folders(spark, "stream_"), shuffle_files(spark)
    ST.stage_header_files(made(spark), src, 1)
    RS.keyed_ingest(spark, src, root, buckets=2, shards=2).awaitTermination()
    store = RS.partial_store(spark, root)
    for _ in range(100):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    left = {x.split("_")[1] for x in shuffle_files(spark) - before}
    assert folders(spark, "stream_") == tables and len(left) <= 1  # that of ``touched``, some numbers
    assert store.read("partials").agg(F.sum("seg_count")).first()[0] == 60
