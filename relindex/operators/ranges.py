"""Article range planning (G4): which ranges to fetch next, and what is missing among what is stored.

A *range* is (grp, start, stop), both ends included. Missing ranges are gaps between islands of stored article
numbers. Numbers are cut into blocks of ``BLOCK``: gaps inside a block come from a window over that block, gaps
between blocks from one row for each block; so a group with a third of all headers is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Article numbers of one window, and batch sizes of a fetch.
BLOCK = 100_000
BATCH_MIN, BATCH_MAX = 100, 1000


def _step(least: int, most: int) -> int:
    if least < 1 or most < 1:
        raise ValueError("batch sizes must be positive")
    return max(least, most)


def next_batches(state: DataFrame, least: int = BATCH_MIN, most: int = BATCH_MAX) -> DataFrame:
    """``state`` (grp, last_article, high) -> (grp, start, stop) of each group's next batch; groups with nothing left have none."""
    left = F.col("high") - F.coalesce("last_article", F.lit(0))
    start = F.coalesce("last_article", F.lit(0)) + 1
    return state.where(left > 0).select("grp", start.alias("start"), (start + F.least(left, F.lit(_step(least, most))) - 1).alias("stop"))


def missing_ranges(stored: DataFrame, bounds: DataFrame) -> DataFrame:
    """``stored`` (grp, article_number, repeats allowed) and ``bounds`` (grp, low, high) -> (grp, start, stop) of the articles in
    bounds that are not stored. Null groups and numbers count for nothing; groups without bounds are not planned."""
    a = stored.select("grp", "article_number").where("grp IS NOT NULL AND article_number IS NOT NULL")
    a = a.join(bounds, "grp").where("article_number BETWEEN low AND high").select("grp", F.floor(F.col("article_number") / BLOCK).alias("block"), "article_number")
    a = a.distinct()
    inside = Window.partitionBy("grp", "block").orderBy("article_number")
    gaps = (a.withColumn("after", F.lead("article_number").over(inside)).where("after > article_number + 1")
            .select("grp", (F.col("article_number") + 1).alias("start"), (F.col("after") - 1).alias("stop")))
    blocks = a.groupBy("grp", "block").agg(F.min("article_number").alias("first"), F.max("article_number").alias("last"))
    over = Window.partitionBy("grp").orderBy("block")
    between = (blocks.withColumn("after", F.lead("first").over(over)).where("after > last + 1")
               .select("grp", (F.col("last") + 1).alias("start"), (F.col("after") - 1).alias("stop")))
    ends = bounds.join(blocks.groupBy("grp").agg(F.min("first").alias("first"), F.max("last").alias("last")), "grp", "left")
    edge: list[tuple[Column, Column]] = [(F.col("low"), F.coalesce(F.col("first") - 1, F.col("high"))),
                                         (F.col("last") + 1, F.when(F.col("last").isNotNull(), F.col("high")))]
    out = gaps.unionByName(between)
    for start, stop in edge:
        out = out.unionByName(ends.select("grp", start.alias("start"), stop.alias("stop")).where("start <= stop"))
    return out


def batches(ranges: DataFrame, least: int = BATCH_MIN, most: int = BATCH_MAX) -> DataFrame:
    """Ranges cut into batches: (grp, start, stop)."""
    step = F.lit(_step(least, most)).cast("long")
    cut = ranges.where("start <= stop").select("grp", F.col("stop").alias("end"), F.explode(F.sequence("start", "stop", step)).alias("start"))
    return cut.select("grp", "start", F.least(F.col("start") + step - 1, F.col("end")).alias("stop"))


def dealt(plan: DataFrame, turns: int | None = None) -> DataFrame:
    """Batches dealt fairly: (turn, grp, start, stop); in each turn every group that has work left gets one batch, oldest articles first.

    ``turns`` keeps the first turns only (a round of work)."""
    t = F.row_number().over(Window.partitionBy("grp").orderBy("start"))
    out = plan.withColumn("turn", t).select("turn", "grp", "start", "stop")
    return out if turns is None else out.where(F.col("turn") <= turns)
