"""Table maintenance as filters (I1-I9), partition jobs (A6-A8), the
renormalize merge (E3) and audits (E8-E10).

Each prune returns ``(kept, removed)``; the store rewrites only touched
partitions (dynamic partition overwrite), so a prune that touches one
category/year rewrites that directory and nothing else. Predicates on the
partition columns (``bucket``, ``posted_year``) are resolved from directory
names without reading data files.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import category as cat
from ..functions import dates as d
from ..functions import text as tx
from ..sources import store


def _split(df: DataFrame, remove: Column) -> tuple[DataFrame, DataFrame]:
    r = F.coalesce(remove, F.lit(False))
    return df.where(~r), df.where(r)


def prune_filetypes(releases: DataFrame, allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Remove rows whose extension is set and not allowed."""
    allowed = allowed or C.prune_extensions()
    ext = F.col("extension")
    return _split(releases, ext.isNotNull() & ~F.lower(ext).isin(allowed))


def prune_sizes(releases: DataFrame, policy: C.SizePolicy | None = None) -> tuple[DataFrame, DataFrame]:
    """Below the per-release minimum (when > 0), or above the global max (when > 0)."""
    policy = policy or C.SizePolicy()
    ms = cat.min_size(F.col("norm_title"), F.col("category_id"), policy)
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    cond = (ms > 0) & (size < ms)
    if policy.max_size > 0:
        cond = cond | (size > F.lit(policy.max_size))
    return _split(releases, cond)


def prune_old(releases: DataFrame, days: int, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Row-exact retention; NULL dates kept; ``days <= 0`` disables."""
    if days <= 0:
        return releases, releases.where(F.lit(False))
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    return _split(releases, F.col("posted_at") < cutoff)


def prune_old_by_inventory(spark: SparkSession, path: str, days: int, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I3 over the partition inventory of the table at ``path``: (kept, removed, report).

    Partitions whose dates are all before the cutoff go, those with none before it stay, by their inventory
    row alone; only the ones the cutoff divides are read. ``report`` has a row for each partition that
    loses rows: its action and how many (null: known only when it is read).
    """
    table, inv = store.read_releases(spark, path), store.read_inventory(spark, path)
    if days <= 0:
        return table, table.where(F.lit(False)), inv.where(F.lit(False)).select("bucket", "posted_year", F.lit("").alias("action"), "n")
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    old = F.coalesce(F.col("first_posted") < cutoff, F.lit(False))
    whole = F.coalesce((F.col("last_posted") < cutoff) & (F.col("n_undated") == 0), F.lit(False))
    rows = inv.select("bucket", "posted_year", "n", F.when(whole, "drop").when(old, "trim").otherwise("keep").alias("action")).collect()  # categories x years
    part = {a: store.partition_filter([r for r in rows if r["action"] == a]) for a in ("drop", "trim", "keep")}
    gone = F.coalesce(F.col("posted_at") < cutoff, F.lit(False))
    trimmed = table.where(part["trim"])
    kept = table.where(part["keep"]).unionByName(trimmed.where(~gone))
    removed = table.where(part["drop"]).unionByName(trimmed.where(gone))
    report = spark.createDataFrame([(r["bucket"], r["posted_year"], r["action"], r["n"] if r["action"] == "drop" else None)
                                    for r in rows if r["action"] != "keep"], "bucket string, posted_year int, action string, n long")
    return kept, removed, report


def prune_partitions(releases: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I4: date cutoff. Year partitions wholly before the cutoff are dropped
    (a partition-column predicate: no data read), the straddling year and the
    default (NULL-year) partition are trimmed row-exactly; ``other`` is untouched.
    Returns ``(kept, removed, report)``; the report has one row per touched
    partition with its action and deleted row count."""
    cdate = _dt.date.fromisoformat(cutoff)
    y = F.col("posted_year")
    managed = F.col("bucket") != C.OTHER_BUCKET
    # upper bound Jan 1 of (year + 1) <= cutoff  <=>  year < cutoff.year
    drop = managed & y.isNotNull() & (y < cdate.year)
    trim = managed & ~drop & F.col("posted_at").isNotNull() & (F.col("posted_at") < F.to_timestamp(F.lit(cutoff)))
    kept, removed = _split(releases, drop | trim)
    report = (
        removed.withColumn("action", F.when(drop, F.lit("drop")).otherwise(F.lit("trim")))
        .groupBy("bucket", "posted_year", "action").agg(F.count(F.lit(1)).alias("rows_deleted"))
    )
    return kept, removed, report


def prune_group(releases: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Remove one source group."""
    return _split(releases, F.col("source_group") == group)


def prune_non_curated(releases: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """NULL/empty group removed; with a non-empty list, groups outside it too."""
    allowed = sorted({g for g in groups if g})
    g = F.col("source_group")
    cond = g.isNull() | (g == "")
    if allowed:
        cond = cond | ~g.isin(allowed)
    return _split(releases, cond)


def prune_non_curated_join(releases: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I6/D7 for a large group list: ``left_semi`` / ``left_anti`` against a
    group table (broadcast only when the table is small — AQE decides from
    measured size)."""
    gl = groups.select(F.col("name").alias("source_group")).where(F.col("source_group") != "").distinct()
    kept = releases.join(gl, "source_group", "left_semi")
    removed = releases.join(gl, "source_group", "left_anti")
    return kept, removed


def remove_by_id(releases: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takedown of the releases listed in ``ids`` (column ``id``)."""
    gone = ids.select("id").distinct()
    return releases.join(gone, "id", "left_anti"), releases.join(gone, "id", "left_semi")


# ---------------------------------------------------------------- partitions

def partition_counts(releases: DataFrame) -> DataFrame:
    """A6/A7 report and E10: rows per (bucket, posted_year)."""
    return releases.groupBy("bucket", "posted_year").agg(F.count(F.lit(1)).alias("n"))


def inventory_counts(spark: SparkSession, path: str) -> DataFrame:
    """A6/A7 report from the inventory: no release file is read."""
    return store.read_inventory(spark, path).select("bucket", "posted_year", "n")


def partition_years(releases: DataFrame) -> DataFrame:
    """Distinct years found per category bucket."""
    return releases.where(F.col("posted_year").isNotNull()).select("bucket", "posted_year").distinct()


def drop_empty_partitions(spark: SparkSession, releases: DataFrame, first_year: int, last_year: int,
                          retain: list[tuple[str, int]] | None = None) -> DataFrame:
    """Expected partition inventory (bucket x year range) minus non-empty
    ones and retained ones; the default (NULL-year) partition is always kept."""
    buckets = [b for b, _, _ in C.CATEGORY_BUCKETS]
    inv = (spark.createDataFrame([(b,) for b in buckets], "bucket string")
           .crossJoin(spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("posted_year"))))
    nonempty = releases.where(F.col("posted_year").isNotNull()).select("bucket", "posted_year").distinct()
    out = inv.join(nonempty, ["bucket", "posted_year"], "left_anti")
    if retain:
        keep = spark.createDataFrame(retain, "bucket string, posted_year int")
        out = out.join(keep, ["bucket", "posted_year"], "left_anti")
    return out


# ---------------------------------------------------------------- E3 / E8 / E9

def renormalize_merge(stored: DataFrame) -> DataFrame:
    """Re-normalize stored titles (``title:YYYY-MM-DD`` keys), regroup by
    new key: summed size, union of tags (sorted), first non-empty category /
    language / group by id order (ids are unique), min posted_at, rows merged."""
    sk = d.split_key(F.col("norm_title"))
    s = stored.select(
        "*",
        tx.normalize_subject(sk["title"]).alias("_t"),
        sk["day"].alias("_day"),
    )
    s = s.withColumn("new_title", F.when(F.col("_day").isNull(), F.col("_t"))
                     .otherwise(F.concat(F.col("_t"), F.lit(":"), F.col("_day"))))
    first_ne = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("id")))
    agg = s.groupBy("new_title").agg(
        F.sum("size_bytes").alias("size_bytes"),
        first_ne("category").alias("category"),
        first_ne("language").alias("language"),
        first_ne("source_group").alias("source_group"),
        F.min("posted_at").alias("posted_at"),
        F.count(F.lit(1)).alias("merged_rows"),
    )
    tags = (s.select("new_title", F.explode(F.split(F.col("tags"), ",")).alias("tag")).where(F.col("tag") != "")
            .groupBy("new_title").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags")))
    return agg.join(tags, "new_title", "left").withColumn("tags", F.coalesce(F.col("tags"), F.lit("")))


def category_audit(releases: DataFrame, hints: C.Hints | None = None) -> DataFrame:
    """Recompute the category from ``title [tag] ...`` + group. Returns every
    row with its expected category (NULL: none inferred, no mismatch) and a flag."""
    tag_items = F.array_join(F.transform(F.filter(F.split(F.coalesce(F.col("tags"), F.lit("")), ","),
                                                  lambda t: t != ""), lambda t: F.concat(F.lit("["), t, F.lit("]"))), " ")
    pseudo = F.trim(F.concat_ws(" ", F.coalesce(F.col("norm_title"), F.lit("")), tag_items))
    grp = F.coalesce(F.col("source_group"), F.lit("None"))
    r = releases.select("*", F.lower(pseudo).alias("_low"), tx.extract_tags(pseudo).alias("_gtags"), cat.group_hint(grp, hints).alias("_hint"))
    r = r.withColumn("expected", cat.infer_category(F.col("_low"), grp, hints, tags=F.col("_gtags"), low=F.col("_low"), hint=F.col("_hint")))
    return r.drop("_low", "_gtags", "_hint").withColumn(
        "mismatch", F.col("expected").isNotNull() & ~F.col("category_id").eqNullSafe(F.col("expected").cast("int")))


def rewrite_categories(audited: DataFrame) -> DataFrame:
    """E8 ``--rewrite``: mismatching rows take the expected id."""
    return audited.withColumn("category_id", F.when(F.col("mismatch"), F.col("expected").cast("int"))
                              .otherwise(F.col("category_id")))


def segment_summary(segments: DataFrame) -> DataFrame:
    """Count, first and last message id by segment number."""
    o = F.struct(F.col("number"), F.col("message_id"))
    return segments.groupBy("norm_title").agg(
        F.count(F.lit(1)).alias("segments"),
        F.min_by("message_id", o).alias("first_message_id"),
        F.max_by("message_id", o).alias("last_message_id"),
    )
