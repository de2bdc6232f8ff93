"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each reads the driver tables (through the header fixture or directly), so
its work grows with them. Column names match the oracle SQL in
``oracle.py``; timestamps leave as text, arrays as joined strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..operators import search as S
from . import common as K


def q_parse_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed header projection."""
    p = K.parsed(spark, sf_dir)
    return p.select(
        "grp", "article_number", "message_id", "size", "norm_title",
        F.array_join("tags", "|").alias("tags"), "language", "category", "category_id",
        "extension", "seg_number", "seg_id", "dedupe_key", K.ts_text(F.col("posted_at")).alias("posted_at"),
    )


def q_fold_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-group candidates."""
    c = ingest.fold_releases(K.parsed(spark, sf_dir))
    return c.select(
        "grp", "dedupe_key", "category", "category_id", "language", "extension",
        F.array_join("tags", ",").alias("tags"), "size_sum", "n_headers",
        K.ts_text(F.col("posted_at")).alias("posted_at"),
    )


def q_collect_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 + D2: distinct segments per release title."""
    return ingest.collect_segments(K.parsed(spark, sf_dir))


def q_build_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + C3 + B22: the release table (batch upsert into an empty table)."""
    r = K.releases(spark, sf_dir)
    return r.select(
        "norm_title", "category", "category_id", "language", "tags", "extension", "source_group",
        "size_bytes", K.ts_text(F.col("posted_at")).alias("posted_at"), "has_parts", "part_count",
        "bucket", "posted_year", F.array_join("search_tokens", " ").alias("search_tokens"),
    )


def _page(r: DataFrame, sq: S.SearchQuery) -> DataFrame:
    page = S.search(r, sq)
    return page.select(
        "norm_title", "category", "category_id", "size_bytes",
        K.ts_text(F.col("posted_at")).alias("posted_at"),
        F.date_format(F.coalesce(F.col("posted_at"), F.to_timestamp(F.lit(K.AS_OF))),
                      "EEE, dd MMM yyyy HH:mm:ss Z").alias("pub_date"),
    )


def q_search_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 / entry: newest 100 searchable releases."""
    return _page(K.releases(spark, sf_dir), S.SearchQuery(limit=100))


REGISTRY = {
    "B_parse_headers": q_parse_headers,
    "E1_fold_releases": q_fold_releases,
    "E2_collect_segments": q_collect_segments,
    "A5_build_releases": q_build_releases,
    "J1_search_newest": q_search_newest,
}


# ---------------------------------------------------------------- search variants
from .. import config as C  # noqa: E402
from ..operators import maintenance as M  # noqa: E402

PRUNE_POLICY = C.SizePolicy(exact={}, patterns=[("^small ", 150_000_000)],
                            category_floor={**C.DEFAULT_CATEGORY_MIN_SIZES, 3000: 50_000_000, 7000: 20_000_000},
                            max_size=400_000_000)


def q_search_text(spark, sf_dir):
    """C5 + G1(size): all query words present, biggest first."""
    return _page(K.releases(spark, sf_dir), S.SearchQuery(q="Widget, small!", sort="size", limit=100))


def q_title_contains(spark, sf_dir):
    """Substring fallback when the token column is unavailable."""
    return _page(K.releases(spark, sf_dir), S.SearchQuery(q="gear", has_vector=False, sort="title", limit=100))


def q_tag_prefix(spark, sf_dir):
    """First-tag prefix filter, newest first, second page (G2 offset)."""
    return _page(K.releases(spark, sf_dir), S.SearchQuery(tag="s", limit=50, offset=50))


def _typed(spark, sf_dir, kind, **kw):
    r = S.typed_search(K.releases(spark, sf_dir), kind, S.SearchQuery(limit=100, **kw))
    return r.select("norm_title", "category", "category_id", "size_bytes", K.ts_text(F.col("posted_at")).alias("posted_at"),
                    F.date_format(F.coalesce(F.col("posted_at"), F.to_timestamp(F.lit(K.AS_OF))),
                                  "EEE, dd MMM yyyy HH:mm:ss Z").alias("pub_date"))


def q_tvsearch(spark, sf_dir):
    """J2 + H4: the parent TV category stands for all its children."""
    return _typed(spark, sf_dir, "tv", cat="5000")


def q_movie(spark, sf_dir):
    """Movie ids by default."""
    return _typed(spark, sf_dir, "movie")


def q_music(spark, sf_dir):
    """Audio ids, unknown sort falls back to date."""
    return _typed(spark, sf_dir, "music", sort="bogus")


def q_book(spark, sf_dir):
    """EBook ids by default."""
    return _typed(spark, sf_dir, "book")


def q_movie_placeholder(spark, sf_dir):
    """H5: movie search that finds nothing (no q) -> one test item; the
    empty check is an aggregate over the real search, not a constant."""
    page = S.search(K.releases(spark, sf_dir), S.SearchQuery(cat="2060", limit=100))
    it = S.items(page, K.AS_OF)
    return S.placeholder_row(it, K.AS_OF, first_cat="2060")


def q_feed_items(spark, sf_dir):
    """A13 + B23 + B24: item records for the newest 100 releases."""
    page = S.search(K.releases(spark, sf_dir), S.SearchQuery(limit=100))
    return S.items(page, K.AS_OF, api_key="k y")


def q_caps(spark, sf_dir):
    """Category dimension with parents, restricted to ids in use
    (so the result follows the release table)."""
    cats = S.category_dimension(spark)
    used = K.releases(spark, sf_dir).select(F.col("category").alias("id")).distinct()
    return cats.join(used, "id", "left_semi").select("id", "name", "parent")


# ---------------------------------------------------------------- maintenance

def _rel_cols(df):
    return df.select("norm_title", "category_id", "size_bytes", "extension", "source_group",
                     K.ts_text(F.col("posted_at")).alias("posted_at"))


def q_prune_filetypes(spark, sf_dir):
    """Rows removed by the file type allow-list."""
    return _rel_cols(M.prune_filetypes(K.releases(spark, sf_dir))[1])


def q_prune_sizes(spark, sf_dir):
    """Rows removed by a stricter size policy (regex override, floors, max)."""
    return _rel_cols(M.prune_sizes(K.releases(spark, sf_dir), PRUNE_POLICY)[1])


def q_prune_old(spark, sf_dir):
    """Rows older than 1500 days before AS_OF."""
    return _rel_cols(M.prune_old(K.releases(spark, sf_dir), 1500, K.AS_OF)[1])


def q_prune_partitions(spark, sf_dir):
    """I4: partition drop/trim report for cutoff 1998-05-15."""
    return M.prune_partitions(K.releases(spark, sf_dir), "1998-05-15")[2]


def q_prune_group(spark, sf_dir):
    """Everything from one group."""
    return _rel_cols(M.prune_group(K.releases(spark, sf_dir), "alt.binaries.misc")[1])


def q_prune_non_curated(spark, sf_dir):
    """I6 + D7: rows outside the curated list."""
    return _rel_cols(M.prune_non_curated(K.releases(spark, sf_dir), ["alt.binaries.movies", "alt.binaries.tv", ""])[1])


def q_partition_counts(spark, sf_dir):
    """Write partitioned by (bucket, posted_year), read back, count per partition."""
    from ..sources import store
    path = store.write_releases(K.releases(spark, sf_dir))
    return M.partition_counts(store.read_releases(spark, path))


def q_partition_years(spark, sf_dir):
    """Distinct years per bucket."""
    return M.partition_years(K.releases(spark, sf_dir))


def q_drop_empty_partitions(spark, sf_dir):
    """Empty year partitions 1990-2005 to drop (1990 movies retained)."""
    return M.drop_empty_partitions(spark, K.releases(spark, sf_dir), 1990, 2005, retain=[("movies", 1990)])


def q_category_audit(spark, sf_dir):
    """Per stored category, rows checked and mismatches."""
    a = M.category_audit(K.releases(spark, sf_dir))
    return a.groupBy("category_id").agg(F.count(F.lit(1)).alias("checked"),
                                        F.sum(F.col("mismatch").cast("long")).alias("mismatches"))


def q_segment_summary(spark, sf_dir):
    """Per release title count / first / last segment id."""
    return M.segment_summary(ingest.collect_segments(K.parsed(spark, sf_dir)))


REGISTRY.update({
    "C5_search_text": q_search_text,
    "C6_title_contains": q_title_contains,
    "C8_tag_prefix_page2": q_tag_prefix,
    "J2_tvsearch": q_tvsearch,
    "J3_movie": q_movie,
    "J4_music": q_music,
    "J5_book": q_book,
    "H5_movie_placeholder": q_movie_placeholder,
    "A13_feed_items": q_feed_items,
    "J7_caps": q_caps,
    "I1_prune_filetypes": q_prune_filetypes,
    "I2_prune_sizes": q_prune_sizes,
    "I3_prune_old": q_prune_old,
    "I4_prune_partitions": q_prune_partitions,
    "I5_prune_group": q_prune_group,
    "I6_prune_non_curated": q_prune_non_curated,
    "A6_partition_counts": q_partition_counts,
    "E10_partition_years": q_partition_years,
    "A8_drop_empty_partitions": q_drop_empty_partitions,
    "E8_category_audit": q_category_audit,
    "E9_segment_summary": q_segment_summary,
})


# ---------------------------------------------------------------- backfill / upsert
from ..operators import backfill as BF  # noqa: E402
from ..operators import upsert as UP  # noqa: E402


def _backfill(spark, sf_dir, n_lookback=0):
    pa = K.folded(spark, sf_dir, "norm_title")
    # every release is treated as lacking segments: the job re-derives them all
    rel = ingest.build_releases(ingest.gate(pa)).select("id", "norm_title", "source_group")
    return BF.backfill(ingest.materialize(rel, "targets"), pa, n_lookback)


def q_backfill_match(spark, sf_dir):
    """D3 + E4 + I8: segments found per release (first header per number)."""
    return _backfill(spark, sf_dir)[0]


def q_backfill_unresolved(spark, sf_dir):
    """Releases with no matching header at all. Every fifth stored title is made one that no
    header has (as after a renaming), half of the others lose their group."""
    rel = K.releases(spark, sf_dir)
    stale = F.when(F.col("id") % 5 == 0, F.concat(F.lit("renamed "), "norm_title")).otherwise(F.col("norm_title"))
    targets = rel.select("id", stale.alias("norm_title"), F.when(F.col("id") % 2 == 0, F.col("source_group")).alias("source_group"))
    return BF.backfill(targets, K.parsed_all(spark, sf_dir), groups=_curated(spark))[2]


def q_lookback(spark, sf_dir):
    """Headers inside the last 10 000 articles of each group."""
    return (BF.lookback(K.parsed_all(spark, sf_dir), 10_000)
            .groupBy("grp").agg(F.count(F.lit(1)).alias("headers"), F.min("article_number").alias("first_article")))


def q_upsert_increment(spark, sf_dir):
    """A5 + D1 + D2: table built from 90 % of the headers, then one batch
    with the remaining 10 % upserted into it (every header is processed)."""
    p = K.folded(spark, sf_dir)
    new = F.col("article_number") % 10 == 0
    base_p, batch_p = (ingest.gate(p).where(c) for c in (~new, new))
    # the table and the batch are stored, as several steps read them, and the headers dropped then
    segs, batch_segs = (ingest.materialize(ingest.collect_segments(x), "segments") for x in (base_p, batch_p))
    cand, batch_cand = (ingest.materialize(ingest.fold_releases(x), "candidates") for x in (base_p, batch_p))
    ingest.drop_table(p)
    rel = ingest.materialize(ingest.with_storage_columns(ingest.releases_from(cand, ingest.segment_totals(segs))), "releases")
    out = UP.upsert(rel, segs, cand, None, batch_cand, batch_segs)[0]
    return ingest.size_gate(out).select("norm_title", "category_id", "size_bytes", "part_count", "has_parts",
                      K.ts_text(F.col("posted_at")).alias("posted_at"), "bucket")


REGISTRY.update({
    "D3_backfill_match": q_backfill_match,
    "D4_backfill_unresolved": q_backfill_unresolved,
    "G5_lookback": q_lookback,
    "A5_upsert_increment": q_upsert_increment,
})


# ---------------------------------------------------------------- outputs
from ..operators import outputs as OUT  # noqa: E402


def _segments(spark, sf_dir):
    return ingest.collect_segments(ingest.gate(K.folded(spark, sf_dir)))


def _rel_and_segs(spark, sf_dir):
    """Releases and segments; the segments, which several steps read, and the candidates are stored, the headers dropped then."""
    p = K.folded(spark, sf_dir)
    segs = ingest.materialize(ingest.collect_segments(ingest.gate(p)), "segments")
    cand = ingest.materialize(ingest.fold_releases(ingest.gate(p)), "candidates")
    ingest.drop_table(p)
    return ingest.size_gate(ingest.releases_from(cand, ingest.segment_totals(segs))), segs


def q_segment_status(spark, sf_dir):
    """A11 + A12: per release status with a 3-segment cap (so over_limit occurs)."""
    r, s = _rel_and_segs(spark, sf_dir)
    return OUT.segment_status(r, s, max_segments=3)


def q_manifest(spark, sf_dir):
    """A10 + J6: NZB XML of every valid release, in parts."""
    r, s = _rel_and_segs(spark, sf_dir)
    return OUT.manifests(r, s)


def q_decode_segments(spark, sf_dir):
    """B19 + B20: legacy JSON (dict and list forms, old kinds of entries) decoded to rows."""
    s = _segments(spark, sf_dir)
    return OUT.decode_segments(OUT.legacy_segment_json(s))


def q_repair_segments(spark, sf_dir):
    """The entries of rewritten lists."""
    s = _segments(spark, sf_dir)
    return OUT.repair_segments(OUT.legacy_segment_json(s))


REGISTRY.update({
    "A11_segment_status": q_segment_status,
    "A10_manifest": q_manifest,
    "B19_decode_segments": q_decode_segments,
    "I7_repair_segments": q_repair_segments,
})


# ---------------------------------------------------------------- groups / metrics
from ..operators import groups as G  # noqa: E402
from ..operators import metrics as MT  # noqa: E402
from ..sources.headers import load_table  # noqa: E402

CURATED = ["alt.binaries.movies", "alt.binaries.boneless", "alt.binaries.tv", "alt.binaries.hdtv",
           "alt.binaries.teevee", "alt.binaries.e-book", "alt.binaries.mp3", "alt.binaries.misc"]


def group_list_text(spark, sf_dir):
    """Group list text built from nation/region names (some invalid, some repeated)."""
    n = load_table(spark, sf_dir, "nation").alias("n")
    r = load_table(spark, sf_dir, "region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select(
        F.col("n.n_nationkey").alias("src_pos"),
        F.concat(F.lit("alt.binaries."), F.lower("n.n_name"), F.lit(", alt.binaries."), F.lower("r.r_name"),
                 F.lit("\n")).alias("text"))


def q_group_list_clean(spark, sf_dir):
    """Valid names, first position kept."""
    valid, _ = G.clean_group_list(group_list_text(spark, sf_dir))
    return valid.select("name", F.col("pos.src_pos").alias("src_pos"), F.col("pos.i").alias("idx"))


def q_group_list_rejects(spark, sf_dir):
    """Rejected names (fatal for the list tool)."""
    _, rej = G.clean_group_list(group_list_text(spark, sf_dir))
    return rej.select("name", F.col("pos.src_pos").alias("src_pos"), F.col("pos.i").alias("idx"))


def _curated(spark):
    return spark.createDataFrame([(g, i) for i, g in enumerate(CURATED)], "name string, pos int")


def _discovered(spark, sf_dir):
    return K.headers(spark, sf_dir).select(F.col("grp").alias("name")).distinct()


def q_group_intersection(spark, sf_dir):
    """H1 / A17 auto mode: curated ∩ discovered, curated order."""
    return G.intersect_ordered(_curated(spark), _discovered(spark, sf_dir))


def q_group_missing(spark, sf_dir):
    """H2: curated names the server does not carry."""
    return G.missing(_curated(spark), _discovered(spark, sf_dir))


def _metrics(spark, sf_dir):
    pa = K.parsed_all(spark, sf_dir)
    return MT.batch_metrics(pa, pa.where(F.col("keep")), batch_size=1000)


def q_batch_metrics(spark, sf_dir):
    """E5: per (group, batch) ingest metrics."""
    return _metrics(spark, sf_dir)


def q_ingest_summary(spark, sf_dir):
    """Totals across groups per batch index."""
    return MT.ingest_summary(_metrics(spark, sf_dir))


def q_changed_counters(spark, sf_dir):
    """Labelled counters that changed between two snapshots of events."""
    ev = load_table(spark, sf_dir, "events")
    prev = MT.labelled_counters(ev.where(F.col("ts") < F.to_timestamp(F.lit("2024-01-15 00:00:00"))))
    return MT.changed_counters(prev, MT.labelled_counters(ev))


def q_rate_window(spark, sf_dir):
    """Hourly counts per user, over-limit above 1."""
    w = MT.rate_window_counts(load_table(spark, sf_dir, "events"), "1 hour", 1)
    return w.withColumn("window_start", K.ts_text(F.col("window_start")))


def q_freshness(spark, sf_dir):
    """Last run per group (header dates as run times), stale after 600 s."""
    runs = K.parsed_all(spark, sf_dir).select("grp", F.col("posted_at").alias("run_ts"))
    f = MT.ingest_freshness(runs, K.AS_OF)
    return f.withColumn("last_run", K.ts_text(F.col("last_run")))


REGISTRY.update({
    "A15_group_list_clean": q_group_list_clean,
    "A15_group_list_rejects": q_group_list_rejects,
    "H1_group_intersection": q_group_intersection,
    "H2_group_missing": q_group_missing,
    "E5_batch_metrics": q_batch_metrics,
    "E6_ingest_summary": q_ingest_summary,
    "E7_changed_counters": q_changed_counters,
    "E11_rate_window_counts": q_rate_window,
    "E12_ingest_freshness": q_freshness,
})


# ---------------------------------------------------------------- streaming
from ..streaming import ingest as ST  # noqa: E402


def q_stream_ingest(spark, sf_dir):
    """K1 + K2 + K3 + K4: headers staged as 4 files, streamed one file per
    micro-batch through parse -> fold -> upsert; returns the visible table."""
    import uuid as _uuid

    from ..session import table_path
    src = table_path(spark, f"stream-src-{_uuid.uuid4().hex[:8]}")
    ST.stage_header_files(K.unparsed(spark, sf_dir), src, n_files=4)
    root = table_path(spark, f"stream-store-{_uuid.uuid4().hex[:8]}")
    qry = ST.incremental_ingest(spark, src, root, files_per_trigger=1, buckets=8)
    qry.awaitTermination()
    rel = ingest.size_gate(ST.release_store(spark, root).read("releases"))
    return rel.select("norm_title", "category_id", "size_bytes", "part_count", "has_parts",
                      K.ts_text(F.col("posted_at")).alias("posted_at"))


def q_stream_progress(spark, sf_dir):
    """K2: the last article of each group after the stream."""
    import uuid as _uuid

    from ..session import table_path
    src, root = (table_path(spark, f"stream-{k}-{_uuid.uuid4().hex[:8]}") for k in ("src", "store"))
    ST.stage_header_files(K.unparsed(spark, sf_dir), src, n_files=2)
    ST.incremental_ingest(spark, src, root, buckets=8).awaitTermination()
    return ST.progress_log(spark, root).state().select("grp", "last_article")


def q_stream_rate_window(spark, sf_dir):
    """K6: hourly per-user counts from an event stream (equals E11)."""
    import uuid as _uuid

    from ..session import table_path
    src, out = (table_path(spark, f"events-{k}-{_uuid.uuid4().hex[:8]}") for k in ("src", "rate"))
    load_table(spark, sf_dir, "events").repartition(8).write.parquet(src)
    ST.rate_window_stream(spark, src, out, "1 hour", delay_seconds=10 * 366 * 86400).awaitTermination()  # the files are in no order
    w = ST.rate_windows(spark, out, 1).drop("open")
    return w.withColumn("window_start", K.ts_text(F.col("window_start")))


REGISTRY.update({
    "K1_stream_ingest": q_stream_ingest,
    "K2_group_progress": q_stream_progress,
    "K6_rate_window_stream": q_stream_rate_window,
})


# ---------------------------------------------------------------- language profiles
from ..operators import language as LG  # noqa: E402


def q_language_profile(spark, sf_dir):
    """Trigram profiles learnt from documents whose id leaves another remainder than 0 by 4; every
    document classified from all its trigrams."""
    docs = load_table(spark, sf_dir, "documents")
    grams = ingest.materialize(LG.trigrams(docs), "doc_trigrams")
    prof = ingest.materialize(LG.train_profiles(docs.where("doc_id % 4 <> 0"), grams), "language_profiles")
    return docs.select("doc_id", "lang").join(LG.classify(grams, prof), "doc_id", "left")


REGISTRY["B9_language_profile"] = q_language_profile


def q_renormalize_merge(spark, sf_dir):
    """Legacy rows keyed by a raw title (counter stripped, not normalized)
    plus day are re-normalized and merged per new key."""
    p = K.parsed(spark, sf_dir)
    raw = F.lower(F.regexp_replace(F.col("subject"), r"\s*\(\d+/\d+\).*$", ""))
    stored = p.select(
        # unique and ordered: two headers of one group may share an article number in the fixture
        F.struct("grp", "article_number", "message_id", "size", "subject").alias("id"),
        F.when(F.col("posted_at").isNull(), raw)
        .otherwise(F.concat(raw, F.lit(":"), F.date_format("posted_at", "yyyy-MM-dd"))).alias("norm_title"),
        "category", "language", F.array_join("tags", ",").alias("tags"), "source_group",
        F.col("size").alias("size_bytes"), "posted_at")
    out = M.renormalize_merge(stored)
    return out.select("new_title", "category", "language", "source_group", "size_bytes", "merged_rows", "tags", K.ts_text(F.col("posted_at")).alias("posted_at"))


REGISTRY["E3_renormalize_merge"] = q_renormalize_merge


def q_size_lookup(spark, sf_dir):
    """B2 + D6: headers without bytes take their size from a table that repeats ids with other sizes."""
    li = load_table(spark, sf_dir, "lineitem")
    mid = F.concat(F.lit("<"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit("@x>"))
    sizes = li.where("l_partkey % 100 = 0").select(mid.alias("message_id"), (F.col("l_quantity").cast("long") * 1000).alias("size"))
    sizes = sizes.unionByName(sizes.withColumn("size", F.col("size") - 500)).unionByName(sizes.withColumn("size", F.lit(0).cast("long")))
    return ingest.header_size(K.headers(spark, sf_dir), sizes).groupBy("grp").agg(
        F.count(F.lit(1)).alias("headers"), F.count(F.when(F.col("bytes") <= 0, 1)).alias("without_bytes"),
        F.count(F.when(F.col("size") > 0, 1)).alias("with_size"), F.sum("size").alias("size"))


def q_poll_seconds(spark, sf_dir):
    """K5: suggested delay after each batch."""
    return MT.adaptive_poll_seconds(MT.ingest_summary(_metrics(spark, sf_dir))).select("batch", "poll_seconds")


def _written_back(spark, sf_dir, prune):
    """A store, a prune of it, its write-back, and what the new version holds."""
    from ..sources import store
    path = store.write_releases(K.releases(spark, sf_dir))
    kept, removed = prune(store.read_releases(spark, path))[:2]
    return M.partition_counts(store.read_releases(spark, store.rewrite(kept, removed, path)))


def q_prune_sizes_written(spark, sf_dir):
    """I2 with write-back: rows per partition afterwards."""
    return _written_back(spark, sf_dir, lambda r: M.prune_sizes(r, PRUNE_POLICY))


def q_prune_category_written(spark, sf_dir):
    """I4 with write-back: partitions that lose all rows are gone."""
    return _written_back(spark, sf_dir, lambda r: M.prune_partitions(r, "1998-05-15"))


REGISTRY.update({
    "B2_size_lookup": q_size_lookup,
    "K5_poll_seconds": q_poll_seconds,
    "I2_prune_sizes_written": q_prune_sizes_written,
    "I4_prune_partitions_written": q_prune_category_written,
})


# ---------------------------------------------------------------- feeds, upgrade, logs
from ..operators import feeds as FD  # noqa: E402


def q_feed_xml(spark, sf_dir):
    """The feed document of the newest 100 releases, extended form, in parts."""
    page = S.search(K.releases(spark, sf_dir), S.SearchQuery(limit=100))
    items = S.items(page, K.AS_OF, api_key="k y")
    items = items.withColumn("size", F.when(F.col("size").endswith("1000"), F.lit("n/a")).otherwise(F.col("size")))
    return FD.feed_xml(items, [F.col("title"), F.col("guid")], "Mon, 31 Dec 2001 00:00:00 +0000", "a <feed> & more", language="en", extended=True)


def q_conform_releases(spark, sf_dir):
    """Releases as an older table had them (no ids, some texts, NULLs) in today's columns."""
    rel = K.releases(spark, sf_dir)
    old = rel.select("norm_title", F.when(F.col("id") % 7 == 0, F.concat("category", F.lit("x"))).otherwise(F.col("category")).alias("category"),
                     F.when(F.col("id") % 3 == 0, F.col("language")).alias("language"), F.when(F.col("id") % 2 == 0, F.col("part_count")).alias("part_count"))
    out = FD.conform_releases(old)
    return out.select("norm_title", "category", "category_id", "language", "tags", "has_parts", "part_count", "extension", K.ts_text(F.col("posted_at")).alias("posted_at"))


def q_redact_log(spark, sf_dir):
    """A request log made of events."""
    ev = load_table(spark, sf_dir, "events")
    log = ev.select("event_id", F.create_map(F.lit("Cookie"), F.col("props"), F.lit("X-Kind"), F.col("event_type")).alias("headers"),
                    F.repeat(F.coalesce("props", F.lit("")), (F.col("event_id") % 40).cast("int")).alias("query"))
    r = FD.redact_log(log)
    return r.select("event_id", F.col("headers")["Cookie"].alias("cookie"), F.col("headers")["X-Kind"].alias("kind"),
                    F.length("query").alias("query_length"), F.md5("query_shown").alias("shown"))


REGISTRY.update({"A13_feed_xml": q_feed_xml, "A9_conform_releases": q_conform_releases, "B26_redact_log": q_redact_log})
