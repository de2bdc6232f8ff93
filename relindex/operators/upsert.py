"""Incremental upsert of a header batch into an existing release table
(A5 with D1 ``existing_keys`` and D2 ``merge_segments``).

The state is three tables: releases, segments, and the folded candidates per
``(grp, dedupe_key)``. All three merge by rules that do not depend on how the
headers were cut into batches:

* a candidate keeps the attributes of its first header in article order, the
  sum of sizes and the union of tags (``ingest.merge_candidates``);
* segments merge on the title alone, stored segments win on a repeated
  message id;
* the releases of a touched title are rebuilt from its merged candidates and
  segments, for every category row of the title;
* nothing is removed: the size gate (C3, ``ingest.size_gate``) hides rows that
  are below their minimum where the table is read, so a title that grows with a
  later batch, also through another category, comes into sight.

Scale: the batch is small relative to the tables. Each of them is joined once,
semi and anti, with the batch's distinct titles, which AQE broadcasts after
measuring them; only the rows of touched titles are aggregated again. A table
kept in hash buckets (``sources.buckets``) gives and takes the buckets of the
batch's titles only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ingest


def merge_segments(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct segments per title; stored ones win on a repeated message id."""
    return (
        stored.withColumn("_prio", F.lit(0)).unionByName(new.withColumn("_prio", F.lit(1)))
        .groupBy("norm_title", "message_id")
        .agg(F.min_by(F.struct("number", "group", "size"), F.col("_prio")).alias("s"))
        .select("norm_title", F.col("s.number").alias("number"), "message_id",
                F.col("s.group").alias("group"), F.col("s.size").alias("size"))
    )


def upsert(releases: DataFrame, segments: DataFrame, candidates: DataFrame,
           parsed_batch: DataFrame | None, folded: DataFrame | None = None,
           collected: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Returns ``(new_releases, new_segments, new_candidates, inserted_keys)``; ``releases`` is the ungated table,
    ``folded`` and ``collected`` the batch's candidates and segments if they are stored already (with both of them the
    headers are not read)."""
    new = ingest.fold_releases(parsed_batch) if folded is None else folded
    titles = new.select(F.col("dedupe_key").alias("norm_title")).distinct()
    keyed = titles.withColumnRenamed("norm_title", "dedupe_key")

    merged = ingest.merge_candidates(candidates.join(keyed, "dedupe_key", "left_semi").unionByName(new))
    segs = merge_segments(segments.join(titles, "norm_title", "left_semi"),
                          ingest.collect_segments(parsed_batch) if collected is None else collected)
    rebuilt = ingest.with_storage_columns(ingest.releases_from(merged, ingest.segment_totals(segs)))

    keys = ["norm_title", "category_id"]
    inserted = rebuilt.select(*keys).join(releases.select(*keys), keys, "left_anti")  # D1
    return (
        releases.join(titles, "norm_title", "left_anti").unionByName(rebuilt),
        segments.join(titles, "norm_title", "left_anti").unionByName(segs),
        candidates.join(keyed, "dedupe_key", "left_anti").unionByName(merged),
        inserted,
    )
