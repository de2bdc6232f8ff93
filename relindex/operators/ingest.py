"""Header -> release pipeline: parse (one projection), fold (E1), segment
dedupe (E2), cross-group merge (A5/D2 semantics) and the size gate (C3).

Scale notes
-----------
* ``parse_headers`` is a single narrow projection + filter: no shuffle.
* Every aggregate below is decomposable (``sum``, ``count``, ``min``,
  ``min_by``/``max_by``, ``collect_set``), so Spark runs a partial aggregate
  before each exchange. A release that owns a third of all headers is
  combined map-side to one row per task before the shuffle, so no single
  reducer receives its raw headers.
* The tag union is part of the same aggregate, over distinct tag lists.
* Segments are kept as a child table ``(norm_title, message_id, ...)``
  rather than an unbounded array on the release row; arrays are only built
  downstream under the manifest segment cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import category as cat
from ..functions import dates as d
from ..functions import tags as tg
from ..functions import text as tx

# Total first-wins order inside a group; group name orders groups.
ORDER_COLS = ["article_number", "message_id", "bytes"]


def header_size(df: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Size from ``bytes``; headers without one that have an id look it
    up in an optional ``(message_id, size)`` table. The table may repeat ids: it
    is reduced to the largest size of each first, and only the headers that
    need it are joined."""
    known = F.coalesce(F.col("bytes"), F.lit(0).cast("long"))
    if sizes is None:
        return df.withColumn("size", known)
    one = (sizes.where(F.col("size") > 0).groupBy(F.trim(F.col("message_id")).alias("_id"))
           .agg(F.max(F.col("size").cast("long")).alias("_size")))
    have = df.where(known > 0).withColumn("size", known)
    lack = df.where(known <= 0).withColumn("_id", F.trim("message_id")).join(one, "_id", "left")
    return have.unionByName(lack.withColumn("size", F.coalesce("_size", F.lit(0).cast("long"))).drop("_id", "_size"))


def parse_headers(headers: DataFrame, sizes: DataFrame | None = None, hints: C.Hints | None = None,
                  detect_lang: bool = True) -> DataFrame:
    """B1-B8, B13, B14, B16, B17 as one narrow projection, plus the gate
    flags C1 (``size_ok``) and C2 (``ext_ok``) and their conjunction ``keep``.

    The projection is staged so each shared sub-result (lower-cased subject,
    bracket tags, extractor structs, category) is computed once and referenced
    by attribute. Gating is left to ``gate()`` *after* materialization: a
    filter placed directly on this projection would be pushed below it and
    Catalyst would inline the category ladder into the predicate repeatedly.
    """
    h = header_size(headers, sizes).withColumn("_usual", d.usual_date(F.col("date")))
    subject = tx.clean_text(F.coalesce(F.col("subject"), F.lit("")))
    msg = F.trim(tx.clean_text(F.coalesce(F.col("message_id"), F.lit(""))))
    p = h.select(
        "grp", "article_number", "bytes", "size",
        msg.alias("message_id"),
        subject.alias("subject"),
        tx.clean_text(F.col("grp")).alias("source_group"),
        d.parse_posted(F.col("date"), usual=F.col("_usual")).alias("posted_at"),
    )
    low = F.col("_low")
    p = tx.with_title(p.withColumn("_low", F.lower("subject")), "subject", "_low", "norm_title")
    p = p.select("*", F.upper("subject").alias("_up"), cat.group_hint(F.col("grp"), hints).alias("_hint"),
                 tg.music_match(F.col("subject"), tg.music_gate(low)).alias("_music"),
                 tg.book_match(F.col("subject"), tg.book_gate(low)).alias("_book"),
                 tg.studio_match(F.col("subject"), tg.studio_gate(low)).alias("_studio"))
    p = p.select(
        "*",
        F.when(F.col("subject").contains("["), tx.extract_tags(F.col("subject"))).otherwise(F.array().cast("array<string>")).alias("_gtags"),
        tg.music_parts(F.col("_music")).alias("_m"),
        tg.book_parts(F.col("_book")).alias("_b"),
        tg.site_match(F.col("subject"), F.col("_studio") == "").alias("_site"),
        F.coalesce(tx.detect_language(F.col("subject"), detect_lang, F.col("_up")), F.lit("und")).alias("language"),
        tx.file_extension(F.col("subject")).alias("extension"),
        tx.segment_number(F.col("subject")).alias("seg_number"),
        segment_id(F.col("message_id")).alias("seg_id"),
    )
    p = p.withColumn("_x", tg.studio_site_parts(F.col("_studio"), F.col("_site")))
    p = p.select(
        "*",
        tg.combine_tags(F.col("subject"), F.col("_gtags"), F.col("_m"), F.col("_b"), F.col("_x"), low).alias("tags"),
        cat.category_or_other(cat.infer_category(F.col("subject"), F.col("grp"), hints, tags=F.col("_gtags"),
                                                 low=low, hint=F.col("_hint"))).alias("category"),
        d.dedupe_key(F.col("norm_title"), F.col("posted_at")).alias("dedupe_key"),
    ).drop("_gtags", "_m", "_b", "_x", "_low", "_up", "_hint", "_music", "_book", "_studio", "_site")
    p = p.withColumn("category_id", cat.category_id(F.col("category")))
    p = p.select("*", (F.col("size") > 0).alias("size_ok"), cat.extension_ok(F.col("category_id"), F.col("extension")).alias("ext_ok"))
    return p.withColumn("keep", F.col("size_ok") & F.col("ext_ok"))


def gate(parsed: DataFrame) -> DataFrame:
    """C1 + C2: headers that reach the fold. Apply to a materialized parse
    (``parsed_table`` / ``materialize``), never directly to the projection."""
    return parsed.where(F.col("keep"))


#: What the fold, the segments and the gate read of a parsed header: the widest column, the subject, is not among them.
FOLD_COLUMNS = ["grp", "article_number", "bytes", "size", "message_id", "source_group", "posted_at", "language", "extension",
                "seg_number", "tags", "category", "category_id", "dedupe_key", "keep"]


def segment_id(message_id):
    """A message id without its angle brackets, NULL if nothing is left."""
    return F.nullif(F.trim(message_id, F.lit("<>")), F.lit(""))


def fold_table(headers: DataFrame, name: str = "parsed_headers", extra: tuple[str, ...] = (), **kw) -> DataFrame:
    """The parsed headers (ungated), materialized with ``FOLD_COLUMNS`` and ``extra`` only; ``seg_id``, which is as
    long as the message id it is read from, is not stored but made on reading."""
    p = materialize(parse_headers(headers, **kw).select(*FOLD_COLUMNS, *extra), name)
    return p.withColumn("seg_id", segment_id(F.col("message_id")))


def parsed_table(headers: DataFrame, name: str = "parsed_headers", partitions: int | None = None, **kw) -> DataFrame:
    """Parse once, write the result as Parquet under the shared checkpoint
    folder, and read it back gated. The three consumers (fold, tag union,
    segments) then scan a compact columnar table with column pruning instead
    of re-running the regex parse three times. ``partitions`` deals an input of
    few large files out first; real feeds need none."""
    return gate(materialize(parse_headers(headers.repartition(partitions) if partitions else headers, **kw), name))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table under the shared checkpoint folder and read it back; the shuffle files of the write are deleted."""
    import uuid

    from ..session import dropped_shuffles, table_path
    spark = df.sparkSession
    path = table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    with dropped_shuffles(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote. For a job that has stored all it makes of the table: whatever
    is still to be computed from it would fail."""
    spark = table.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        at = path(spark.sparkContext._jvm.java.net.URI(folder))
        at.getFileSystem(conf).delete(at, True)


def _ord():
    return F.struct(*[F.col(c) for c in ORDER_COLS])


def fold_releases(parsed: DataFrame) -> DataFrame:
    """One candidate per ``(grp, dedupe_key)``: first category/language/
    extension, summed size, min posted_at, tag union (sorted once merged;
    a single header keeps its own order)."""
    j = parsed.groupBy("grp", "dedupe_key").agg(
        F.min_by(F.struct("category", "category_id", "language", "extension", "source_group", "tags"), _ord()).alias("first"),
        F.sum("size").alias("size_sum"),
        F.count(F.lit(1)).alias("n_headers"),
        F.min("posted_at").alias("posted_at"),
        F.min(_ord()).alias("first_ord"),
        # distinct tag lists, merged map-side: a title's headers carry the same few lists
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tag_union"),
    )
    return j.select(
        "grp", "dedupe_key",
        F.col("first.category").alias("category"),
        F.col("first.category_id").alias("category_id"),
        F.col("first.language").alias("language"),
        F.col("first.extension").alias("extension"),
        F.col("first.source_group").alias("source_group"),
        F.when(F.col("n_headers") == 1, F.col("first.tags"))
        .otherwise(F.coalesce(F.col("tag_union"), F.array().cast("array<string>"))).alias("tags"),
        F.col("size_sum"), F.col("n_headers"), F.col("posted_at"), F.col("first_ord"),
    )


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate per ``(grp, dedupe_key)`` from those of several batches: what ``fold_releases`` would
    make of all their headers together, whatever the batches were."""
    return candidates.groupBy("grp", "dedupe_key").agg(
        F.min_by(F.struct("category", "category_id", "language", "extension", "source_group"), F.col("first_ord")).alias("first"),
        F.when(F.sum("n_headers") == 1, F.first("tags"))
        .otherwise(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags"))))).alias("tags"),
        F.sum("size_sum").alias("size_sum"), F.sum("n_headers").alias("n_headers"),
        F.min("posted_at").alias("posted_at"), F.min("first_ord").alias("first_ord"),
    ).select("grp", "dedupe_key", "first.*", "tags", "size_sum", "n_headers", "posted_at", "first_ord")


def collect_segments(parsed: DataFrame) -> DataFrame:
    """E2 + D2: distinct segments per release title, first wins by
    ``(group, article order)`` — the order groups are processed in."""
    return (
        parsed.where(F.col("seg_id").isNotNull())
        .groupBy(F.col("dedupe_key").alias("norm_title"), F.col("seg_id").alias("message_id"))
        .agg(F.min_by(F.struct(F.col("seg_number").alias("number"), F.col("source_group").alias("group"),
                               F.col("size")), F.struct(F.col("grp"), _ord())).alias("s"))
        .select("norm_title", F.col("s.number").alias("number"), "message_id",
                F.col("s.group").alias("group"), F.col("s.size").alias("size"))
    )


def segment_totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy("norm_title").agg(
        F.sum("size").alias("seg_total"), F.count(F.lit(1)).alias("seg_count"))


def size_gate(releases: DataFrame, policy: C.SizePolicy | None = None) -> DataFrame:
    """Hides releases whose segments stay below the minimum size. Applied
    where a table is read, never to what is stored: a release that is too
    small now may grow with a later batch."""
    enough = F.col("size_bytes") >= cat.min_size(F.col("norm_title"), F.col("category_id"), policy)
    return releases.where(~F.col("has_parts") | enough)


def build_releases(parsed: DataFrame, policy: C.SizePolicy | None = None, segments: DataFrame | None = None,
                   gated: bool = True) -> DataFrame:
    """Candidates -> release rows keyed by ``(norm_title, category_id)``.

    First candidate (group order) inserts; later non-null ``posted_at`` wins
    (last write); segments merge on the title alone and set size/part count
    for every category row of the title; C3 (``size_gate``) hides rows whose
    segment total is below the minimum size unless ``gated`` is false."""
    segs = segments if segments is not None else collect_segments(parsed)
    out = releases_from(fold_releases(parsed), segment_totals(segs))
    return size_gate(out, policy) if gated else out


def releases_from(cand: DataFrame, tot: DataFrame) -> DataFrame:
    """Release rows (ungated) from candidates and the segment totals of their titles."""
    rel = cand.groupBy(F.col("dedupe_key").alias("norm_title"), "category_id").agg(
        F.min_by(F.struct("category", "language", "tags", "extension", "source_group", "size_sum"), F.col("grp")).alias("f"),
        F.max_by(F.col("posted_at"), F.when(F.col("posted_at").isNotNull(), F.col("grp"))).alias("posted_at"),
    )
    j = rel.join(tot, "norm_title", "left")
    return j.select(
        release_id(F.col("norm_title"), F.col("category_id")).alias("id"),
        "norm_title",
        F.col("f.category").alias("category"),
        "category_id",
        F.col("f.language").alias("language"),
        F.array_join(F.col("f.tags"), ",").alias("tags"),
        F.col("f.extension").alias("extension"),
        F.col("f.source_group").alias("source_group"),
        F.coalesce(F.col("seg_total"), F.when(F.col("f.size_sum") > 0, F.col("f.size_sum"))).alias("size_bytes"),
        "posted_at",
        (F.coalesce(F.col("seg_count"), F.lit(0)) > 0).alias("has_parts"),
        F.coalesce(F.col("seg_count"), F.lit(0)).cast("int").alias("part_count"),
    )


def release_id(title, category_id):
    """Stable 60-bit id from ``md5(norm_title, category_id)`` (no sequence needed)."""
    h = F.md5(F.concat(F.coalesce(title, F.lit("")), F.lit("\u001f"), category_id.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def with_storage_columns(releases: DataFrame) -> DataFrame:
    """Partition columns and the derived search token column."""
    return releases.withColumns({
        "bucket": cat.category_bucket(F.col("category_id")),
        "posted_year": F.year("posted_at"),
        "search_tokens": tx.search_tokens(F.concat_ws(" ", F.col("norm_title"), F.col("tags"))),
    })
