"""Group progress as a change log (K2).

The state of the groups - last article, irrelevant or not - is never stored as such. What happened is:
a table of events (``seq``, ``kind``, ``grp``, ``article``, ``keep``, ``mode``) with kinds

* ``advance``: the group's cursor is ``article``; an irrelevant group is relevant again;
* ``irrelevant``: the group is hidden; its cursor stays (0 if it has none);
* ``reset``: all groups but those in ``keep`` are forgotten (an empty or null list keeps none);
* ``mode``: the way of selecting groups is ``mode``; nothing is forgotten;
* ``curated``: the mode becomes ``curated``, and all groups are forgotten unless it was already.

``group_state`` folds it: for each group, the events after the last reset that forgot it. Equal ``seq``
never occur for one group.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "seq long, kind string, grp string, article long, keep array<string>, mode string"


def modes(events: DataFrame) -> DataFrame:
    """(seq, kind, mode, before): mode events in order, each with the mode before it. There are few: one for each switch."""
    order = Window.orderBy("seq")
    m = events.where(F.col("kind").isin("mode", "curated")).select(
        "seq", "kind", F.when(F.col("kind") == "curated", F.lit("curated")).otherwise(F.col("mode")).alias("mode"))
    return m.withColumn("before", F.lag("mode").over(order))


def group_mode(events: DataFrame) -> DataFrame:
    """The mode in force: one row (null if none was set)."""
    return modes(events).agg(F.max_by("mode", "seq").alias("mode"))


def resets(events: DataFrame) -> DataFrame:
    """(seq, keep): what forgets groups, real switches to curated mode included."""
    none = F.array().cast("array<string>")
    plain = events.where("kind = 'reset'").select("seq", F.coalesce("keep", none).alias("keep"))
    switch = modes(events).where("kind = 'curated' AND NOT (before <=> 'curated')").select("seq", none.alias("keep"))
    return plain.unionByName(switch)


def _forgotten(events: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, since): the last reset that forgot each group (null: none did).

    Resets are numbered from the newest; a group that the newest n keep is forgotten by reset n + 1. The n
    comes from the numbers of the resets that keep the group: they must be 1, 2, ... n without a gap.
    """
    numbered = resets(events).withColumn("nth", F.row_number().over(Window.orderBy(F.col("seq").desc())))  # resets are operator actions: few
    kept = numbered.select("nth", F.explode(F.array_distinct("keep")).alias("grp"))
    run = kept.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("nth"))).where("rank = nth")
    first = run.groupBy("grp").agg((F.max("nth") + 1).alias("nth"))
    return (groups.join(first, "grp", "left").withColumn("nth", F.coalesce("nth", F.lit(1)))
            .join(numbered.select("nth", F.col("seq").alias("since")), "nth", "left").select("grp", "since"))


def group_state(events: DataFrame) -> DataFrame:
    """(grp, last_article, irrelevant) of every group that is not forgotten."""
    own = events.where(F.col("kind").isin("advance", "irrelevant") & F.col("grp").isNotNull())
    since = _forgotten(events, own.select("grp").distinct())
    live = own.join(since, "grp").where("since IS NULL OR seq > since")
    advance = F.when(F.col("kind") == "advance", F.col("seq"))
    return live.groupBy("grp").agg(
        F.coalesce(F.max_by("article", advance), F.lit(0).cast("long")).alias("last_article"),
        F.max_by(F.col("kind") == "irrelevant", "seq").alias("irrelevant"))


def cursors(state: DataFrame) -> DataFrame:
    """(grp, last_article) of the groups that are not hidden."""
    return state.where(~F.col("irrelevant")).select("grp", "last_article")


def irrelevant_groups(state: DataFrame) -> DataFrame:
    return state.where("irrelevant").select("grp")


def compacted(events: DataFrame) -> DataFrame:
    """A short log with the same state: an event or two for each group, one for the mode."""
    state, last = group_state(events), events.agg(F.max("seq")).first()[0] or 0
    none, text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    at = F.lit(last).cast("long")
    out = state.select((at - 1).alias("seq"), F.lit("advance").alias("kind"), "grp", F.col("last_article").alias("article"), none.alias("keep"), text.alias("mode"))
    hidden = state.where("irrelevant").select(at.alias("seq"), F.lit("irrelevant").alias("kind"), "grp", F.lit(0).cast("long").alias("article"), none.alias("keep"), text.alias("mode"))
    mode = group_mode(events).where("mode IS NOT NULL").select(
        at.alias("seq"), F.lit("mode").alias("kind"), text.alias("grp"), F.lit(None).cast("long").alias("article"), none.alias("keep"), "mode")
    return out.unionByName(hidden).unionByName(mode)


class ProgressLog:
    """The log as a folder of entries, one for each append. One writer at a time; an entry that is written again replaces itself."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{EVENTS}, entry string").parquet(self.root).where("seq IS NOT NULL")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{EVENTS}, entry string")

    def append(self, entry: str, events: DataFrame) -> None:
        """Add events (any of kind, grp, article, keep, mode); those of one entry count as simultaneous,
        ``irrelevant`` after ``advance``."""
        last = self.events().where(F.col("entry") != entry).agg(F.max("seq")).first()[0] or 0
        have = [c.strip().split(" ") for c in EVENTS.split(",")][1:]
        cols = [(F.col(n) if n in events.columns else F.lit(None)).cast(t).alias(n) for n, t in have]
        seq = F.lit(last).cast("long") + F.when(F.col("kind") == "irrelevant", 2).otherwise(1)
        events.select(*cols).select(seq.alias("seq"), "*").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/entry={entry}")

    def _one(self, entry: str, kind: str, **values) -> None:
        types = {"grp": "string", "keep": "array<string>", "mode": "string"}
        names = list(values)
        self.append(entry, self.spark.createDataFrame([(kind, *values.values())], ", ".join(["kind string", *(f"{n} {types[n]}" for n in names)])))

    def mark_irrelevant(self, entry: str, grp: str) -> None:
        self._one(entry, "irrelevant", grp=grp)

    def reset(self, entry: str, keep: list[str] | None = None) -> None:
        self._one(entry, "reset", keep=[g for g in keep or [] if g])

    def set_mode(self, entry: str, mode: str) -> None:
        self._one(entry, "mode", mode=mode)

    def reset_for_curated(self, entry: str) -> None:
        self._one(entry, "curated")

    def state(self) -> DataFrame:
        return group_state(self.events())
