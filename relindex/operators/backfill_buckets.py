"""Backfill over co-bucketed tables (D3, D4, E4, I8): header parts and release keys lie in the same hash
buckets of one key, so the match reads bucket against bucket and shuffles neither side.

The key of a part or a release is its title, its day and a salt, in one string: a null day is an empty one,
so the join is a plain equi-join and Spark sees the same hash partitioning on both sides. A title with more
than ``hot`` parts is dealt over several salts by segment number, and its releases lie under each of them; so
a title with a third of all headers is as many small bucket rows, not one task. Hot titles are counted when the
parts are written: each has over ``hot`` parts, so their table is smaller than the parts by that factor.

One left join tells both what was found and what was not; what follows it are aggregates that first work
inside the buckets.

Releases may be stale against the parts (a title renamed since): they find nothing, as in ``backfill``.
A null title finds nothing and is unresolved. Ids of targets are distinct.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as d
from ..session import table_path
from .backfill import header_parts

#: Parts of one title and day from which it is dealt over salts.
HOT_PARTS = 200_000


@dataclass(frozen=True)
class Layout:
    """The bucketed table of parts (name), the table of hot titles (path) and the number of buckets."""

    parts: str
    hot: str
    buckets: int


def _key(title: Column, day: Column, salt: Column) -> Column:
    return F.concat(title, F.lit("\u0000"), F.coalesce(day, F.lit("")), F.lit("\u0000"), salt.cast("string"))


def _save(df: DataFrame, kind: str, key: str, buckets: int) -> str:
    """A table bucketed and sorted by ``key``, with its files under the shared checkpoint folder; one file for a bucket."""
    name = f"backfill_{kind}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", table_path(df.sparkSession, name)).saveAsTable(name))
    return name


def write_parts(parsed_all: DataFrame, buckets: int = 64, n_lookback: int = 0, hot: int = HOT_PARTS) -> Layout:
    """The first header for each (group, title, day, number), in ``buckets`` buckets of the salted title.

    The header parts are aggregated once and stored with the write; the lookup pays for neither."""
    spark = parsed_all.sparkSession
    base = table_path(spark, f"backfill-base-{uuid.uuid4().hex[:12]}")
    header_parts(parsed_all, n_lookback).write.parquet(base)
    parts = spark.read.parquet(base)
    # parts of a hot title are counted in partial sums, so it is one row for each task
    big = parts.groupBy("title", "day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    path = table_path(spark, f"backfill-hot-{uuid.uuid4().hex[:12]}")
    big.select("title", "day", F.ceil(F.col("n") / hot).cast("int").alias("salts")).write.parquet(path)
    salted = _with_salts(parts, spark.read.parquet(path)).withColumn("salt", F.pmod(F.xxhash64("number", "grp"), F.col("salts")))
    rows = salted.select(_key(F.col("title"), F.col("day"), F.col("salt")).alias("key"), "grp", "number", "message_id", "size")
    return Layout(_save(rows, "parts", "key", buckets), path, buckets)


def _with_salts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``salts`` of each row's title, 1 for all that are not hot. AQE measures the hot titles before it broadcasts them."""
    h = hot.select(F.col("title").alias("_t"), F.col("day").alias("_d"), F.col("salts"))
    same = (F.col("title") == F.col("_t")) & (F.coalesce("day", F.lit("")) == F.coalesce("_d", F.lit("")))
    return rows.join(h, same, "left").drop("_t", "_d").withColumn("salts", F.coalesce("salts", F.lit(1)))


def write_targets(targets: DataFrame, layout: Layout) -> str:
    """The releases to backfill (id, norm_title, source_group) in the buckets of the parts, hot ones under every salt."""
    spark, sk = targets.sparkSession, d.split_key(F.col("norm_title"))
    t = targets.select("id", "norm_title", F.nullif(F.col("source_group"), F.lit("")).alias("grp"),
                       F.lower(sk["title"]).alias("title"), sk["day"].alias("day"))
    s = _with_salts(t, spark.read.parquet(layout.hot)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = s.select(_key(F.col("title"), F.col("day"), F.col("salt")).alias("key"), "id", "norm_title", "grp")
    return _save(rows, "targets", "key", layout.buckets)


def matched(spark: SparkSession, targets: str, layout: Layout) -> DataFrame:
    """Every target (by salt) with the parts it finds, those of its own group where it has one; no side is shuffled.

    The merge hint keeps the side from being broadcast, so the plan is the same at every size."""
    t, p = spark.table(targets).alias("t"), spark.table(layout.parts).alias("p")
    on = (F.col("t.key") == F.col("p.key")) & (F.col("t.grp").isNull() | (F.col("t.grp") == F.col("p.grp")))
    return t.hint("merge").join(p.hint("merge"), on, "left").select(
        "t.key", "t.id", "t.norm_title", F.col("t.grp").isNull().alias("any_group"), F.col("p.grp").alias("group"),
        "p.number", "p.message_id", "p.size")


def backfill(spark: SparkSession, targets: str, layout: Layout, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I8 as ``operators.backfill.backfill``: ``(filled, segments, unresolved)``, from the bucketed tables."""
    m = matched(spark, targets, layout)
    # counts by key stay inside the buckets; a release is then a row for each of its salts and groups
    sums = (m.groupBy("key", "id", "norm_title", "any_group", "group").agg(F.count("message_id").alias("n"), F.sum("size").alias("s"))
            .groupBy("id", "norm_title", "any_group", "group").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    if groups is None:
        sums = sums.withColumn("pos", F.lit(None).cast("int"))
    else:
        sums = sums.join(groups.groupBy(F.col("name").alias("group")).agg(F.min("pos").alias("pos")), "group", "left")
    # a group that found nothing comes last
    order = F.struct(F.col("n") == 0, F.col("pos").isNull(), "pos", "group")
    best = sums.groupBy("id", "norm_title").agg(F.min_by(F.struct("group", "any_group", "n", "s"), order).alias("b"))
    filled = best.where("b.n > 0").select("id", "norm_title", F.col("b.n").cast("int").alias("part_count"), F.col("b.s").alias("size_bytes"))
    unresolved = best.where("b.n = 0").select("id", "norm_title")
    found = m.where(F.col("message_id").isNotNull())
    own = found.where(~F.col("any_group"))
    picks = best.where("b.n > 0 AND b.any_group").select("id", F.col("b.group").alias("group"))
    free = found.where("any_group").join(picks, ["id", "group"], "left_semi")
    cols = ["id", "norm_title", "number", "message_id", "group", "size"]
    return filled, own.select(*cols).unionByName(free.select(*cols)), unresolved


def drop(spark: SparkSession, *tables: str) -> None:
    """Forget the tables; their files go with ``session.drop_scratch``."""
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
