"""Structured Streaming ingest (K1-K6).

K1 ``incremental_ingest``: header files arrive in a folder; ``readStream``
picks them up (``maxFilesPerTrigger`` bounds a micro-batch, the streaming
offsets in the checkpoint replace the per-group cursor) and ``foreachBatch``
parses, folds and upserts each micro-batch into a bucketed release store.

* The checkpoint folder belongs to the store (``<store_root>/checkpoint``): a
  stream that is stopped and started again goes on where it was, with any
  number of files a batch.
* Idempotent: a commit names its ``batchId``; a replayed batch (after a
  driver or executor failure) is skipped.
* A batch reads and rewrites the buckets of its own titles; the others are
  carried over by name (``sources.buckets``).
* The stored table is ungated, so it does not depend on how the input was cut
  into batches; readers apply ``ingest.size_gate``.
* K2 group progress is a change log (``operators.progress``): each batch
  advances its groups and marks those it inserted nothing for, unless the
  group list is curated.
* K3 repeated message ids are deduplicated inside the batch (segment merge)
  and against the table (stored segment wins), so they never count twice.
* K6 windowed counts hold the open windows only; a window is closed when the
  watermark passes its end, and what comes later is listed apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, upsert
from ..operators.progress import ProgressLog
from ..session import dropped_shuffles
from ..sources.buckets import BucketStore
from ..sources.headers import HEADER_SCHEMA

#: Tables of the release state and the title column that buckets each.
STATE = {"releases": "norm_title", "segments": "norm_title", "candidates": "dedupe_key"}


def release_store(spark: SparkSession, root: str, buckets: int = 64, keep: int = 3) -> BucketStore:
    return BucketStore(spark, f"{root.rstrip('/')}/store", STATE, buckets, keep)


def progress_log(spark: SparkSession, root: str) -> ProgressLog:
    return ProgressLog(spark, f"{root.rstrip('/')}/progress")


def apply_batch(store: BucketStore, log: ProgressLog, batch: DataFrame, batch_id: int, curated: bool = False) -> None:
    """K1 body: parse -> fold -> upsert of the touched buckets; K2 events; skip replays."""
    done = store.batch_id()
    if done is not None and done >= batch_id:
        return  # already applied (replay after failure)
    # a batch of one file has a task for each of its row groups: deal it out for the parse
    dealt = batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "article_number", "message_id")
    parsed = ingest.fold_table(dealt, "stream_parsed")
    cand = ingest.materialize(ingest.fold_releases(ingest.gate(parsed)), "stream_candidates")
    found = ingest.materialize(ingest.collect_segments(ingest.gate(parsed)), "stream_segments")
    ingest.drop_table(parsed)
    touched = store.touched(cand, "dedupe_key")
    old = {t: store.read(t, touched) for t in STATE}
    if any(v is None for v in old.values()):
        segs = found
        rel = ingest.with_storage_columns(ingest.releases_from(cand, ingest.segment_totals(segs)))
        inserted = rel.select("norm_title", "category_id")
    else:
        rel, segs, merged, inserted = upsert.upsert(old["releases"], old["segments"], old["candidates"], None, cand, found)
    new_keys = ingest.materialize(inserted, "stream_inserted")
    log.append(f"batch{batch_id:012d}", progress_events(batch, cand, new_keys, log.state(), curated))
    store.commit(batch_id, dict.fromkeys(STATE, touched), releases=rel, segments=segs,
                 candidates=cand if any(v is None for v in old.values()) else merged)
    for table in (cand, found, new_keys):  # the commit holds all that was made of them
        ingest.drop_table(table)


def progress_events(batch: DataFrame, candidates: DataFrame, inserted: DataFrame, state: DataFrame, curated: bool) -> DataFrame:
    """K2: every group of the batch advances (files come in any order, so never back); one that inserted no
    release is marked irrelevant, unless groups are curated."""
    last = (batch.groupBy("grp").agg(F.max("article_number").alias("article")).join(state.select("grp", "last_article"), "grp", "left")
            .select("grp", F.greatest("article", "last_article").alias("article")))
    events = last.select(F.lit("advance").alias("kind"), "grp", "article")
    if curated:
        return events
    useful = candidates.join(inserted.withColumnRenamed("norm_title", "dedupe_key"), ["dedupe_key", "category_id"], "left_semi").select("grp").distinct()
    idle = last.join(useful, "grp", "left_anti").select(F.lit("irrelevant").alias("kind"), "grp", F.lit(None).cast("long").alias("article"))
    return events.unionByName(idle)


def incremental_ingest(spark: SparkSession, source_dir: str, store_root: str, files_per_trigger: int = 1,
                       buckets: int = 64, curated: bool = False):
    """K1: start the stream, or go on with it; returns the ``StreamingQuery``."""
    store, log = release_store(spark, store_root, buckets), progress_log(spark, store_root)
    src = (spark.readStream.schema(HEADER_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .option("recursiveFileLookup", "true")
           .parquet(source_dir))
    return (src.writeStream.foreachBatch(lambda df, bid: apply_batch(store, log, df, bid, curated))
            .option("checkpointLocation", f"{store_root.rstrip('/')}/checkpoint").trigger(availableNow=True).start())


def stage_header_files(headers: DataFrame, target_dir: str, n_files: int = 4) -> None:
    """Write headers as ``n_files`` files, split by article number so that every file spans all groups;
    each is written by a task of its own."""
    with dropped_shuffles(headers.sparkSession):
        headers.repartition(n_files, F.col("article_number")).write.mode("overwrite").option("compression", "zstd").parquet(target_dir)


def stream_dedupe(headers_stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """K3: drop repeated ``(grp, message_id)`` within the watermark delay."""
    ts = F.to_timestamp(F.regexp_replace(F.col("date"), r"^\s*[A-Za-z]{3},\s*", ""), "d MMM yyyy HH:mm:ss Z")
    return (headers_stream.withColumn("event_ts", F.coalesce(ts, F.current_timestamp()))
            .withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["grp", "message_id"]))


# --- K6 ------------------------------------------------------------------------------------------

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def window_store(spark: SparkSession, root: str, buckets: int = 16) -> BucketStore:
    return BucketStore(spark, f"{root.rstrip('/')}/open", {"open": "user_id"}, buckets)


def apply_events(store: BucketStore, root: str, batch: DataFrame, batch_id: int, window: str, delay_seconds: int) -> None:
    """K6 body: add a micro-batch to the open windows, close those that the watermark has passed.

    The watermark of a batch is that of the batches before it (so the order inside a batch does not
    matter): the greatest time seen less ``delay_seconds``. Rows of a window that is closed by then are
    listed under ``late`` with their lateness. Each batch writes folders of its own, a replay overwrites
    them; the open windows are committed last.
    """
    done = store.batch_id()
    if done is not None and done >= batch_id:
        return
    seen = store.meta()
    mark = F.lit(None).cast("timestamp") if seen is None else F.timestamp_micros(F.lit(int(seen) - delay_seconds * 1_000_000))
    w = F.window("ts", window)
    rows = batch.where(F.col("ts").isNotNull()).select("user_id", "ts", w["start"].alias("window_start"), w["end"].alias("window_end"))
    rows = ingest.materialize(rows.withColumn("mark", mark), "stream_events")
    late = F.coalesce(F.col("window_end") <= F.col("mark"), F.lit(False))
    (rows.where(late).select("user_id", "ts", "window_start", (F.unix_micros("mark") - F.unix_micros("ts")).alias("late_micros"))
     .write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}"))
    counts = rows.where(~late).groupBy("window_start", "window_end", "user_id").agg(F.count(F.lit(1)).alias("n"))
    held = store.read("open")
    if held is not None:
        counts = counts.unionByName(held).groupBy("window_start", "window_end", "user_id").agg(F.sum("n").alias("n"))
    top = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
    top = max(x for x in (top, None if seen is None else int(seen), -(1 << 62)) if x is not None)
    counts = ingest.materialize(counts, "stream_windows")
    closed = F.unix_micros("window_end") <= F.lit(top - delay_seconds * 1_000_000)
    counts.where(closed).write.mode("overwrite").parquet(f"{root}/closed/batch={batch_id}")
    store.commit(batch_id, {"open": None}, meta=str(top), open=counts.where(~closed))


def rate_window_stream(spark: SparkSession, events_dir: str, out_dir: str, window: str, files_per_trigger: int = 4,
                       delay_seconds: int = 3600):
    """K6: windowed per-user counts over an event stream; start it or go on with it. Read with ``rate_windows`` and ``late_events``."""
    root = out_dir.rstrip("/")
    store = window_store(spark, root)
    src = spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(events_dir)
    return (src.writeStream.foreachBatch(lambda df, bid: apply_events(store, root, df, bid, window, delay_seconds))
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())


def rate_windows(spark: SparkSession, out_dir: str, limit: int) -> DataFrame:
    """K6: closed windows and, as far as counted, open ones, with the over-limit flag."""
    root = out_dir.rstrip("/")
    cols = ["window_start", "user_id", "n"]
    n = spark.read.schema("window_start timestamp, window_end timestamp, user_id long, n long").parquet(f"{root}/closed")
    n = n.select(*cols, F.lit(False).alias("open"))
    held = window_store(spark, root).read("open")
    if held is not None:
        n = n.unionByName(held.select(*cols, F.lit(True).alias("open")))
    return n.withColumn("over_limit", F.col("n") > limit)


def late_events(spark: SparkSession, out_dir: str) -> DataFrame:
    """K6: rows that came after their window was closed: user, time, window and microseconds behind the watermark."""
    return spark.read.schema("user_id long, ts timestamp, window_start timestamp, late_micros long").parquet(f"{out_dir.rstrip('/')}/late").select(
        "user_id", "ts", "window_start", "late_micros")
