"""Group lists and selection.

Group lists are small dimension tables (hundreds of names), but every step
is still a DataFrame transform so lists of any size work: order is carried
as a position column, never by collecting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def clean_group_list(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(src_pos, text)`` rows of comma/newline lists -> trimmed names,
    validated against the group name pattern, deduplicated keeping the first
    position. Returns ``(valid(name, pos), rejects(name, pos))``; the caller
    treats any reject as fatal, as the list tool does."""
    parts = text.select("src_pos", F.posexplode(F.split(F.col("text"), r"[,\n]")).alias("i", "raw"))
    names = parts.select(F.trim("raw").alias("name"), F.struct("src_pos", "i").alias("pos")).where(F.col("name") != "")
    ok = F.col("name").rlike(C.GROUP_NAME_PATTERN)
    valid = names.where(ok).groupBy("name").agg(F.min("pos").alias("pos"))
    rejects = names.where(~ok)
    return valid, rejects


def as_text(valid: DataFrame, sep: str = "\n") -> DataFrame:
    """Output form: newline or CSV text (one row)."""
    return valid.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))),
                                              lambda s: s["name"]), sep).alias("text"))


def intersect_ordered(curated: DataFrame, discovered: DataFrame) -> DataFrame:
    """H1: curated names present on the server, in curated order."""
    return curated.join(discovered.select("name").distinct(), "name", "left_semi")


def missing(curated: DataFrame, discovered: DataFrame) -> DataFrame:
    """H2: curated names absent from the server with their rank by name (1 is first); the list is a
    configuration table, so the ranking window over it is small."""
    gone = curated.join(discovered.select("name").distinct(), "name", "left_anti").select("name").distinct()
    return gone.select("name", F.row_number().over(Window.orderBy("name")).alias("rank"))


def select_groups(mode: str, curated: DataFrame, configured: DataFrame, discovered: DataFrame,
                  fallback: DataFrame) -> DataFrame:
    """Curated -> configured -> (configured mode: nothing) -> auto:
    curated-list ∩ discovered, else the full list. Emptiness checks are
    one-row aggregates on small lists."""
    def nonempty(df: DataFrame) -> bool:
        return df.limit(1).count() > 0

    if mode == "curated" and nonempty(curated):
        return curated
    if nonempty(configured):
        return configured
    if mode == "configured":
        return configured.limit(0)
    hit = intersect_ordered(fallback, discovered)
    return hit if nonempty(hit) else fallback


def group_filters(groups: DataFrame, progress: DataFrame, ignored: DataFrame, as_of: str,
                  curated_mode: bool) -> DataFrame:
    """Drop ignored groups; drop groups marked irrelevant unless curated;
    hold back groups whose next probe time is in the future."""
    g = groups.join(ignored.select("name").distinct(), "name", "left_anti")
    p = progress.select("name", "irrelevant", "next_probe")
    g = g.join(p, "name", "left")
    cond = F.col("next_probe").isNull() | (F.col("next_probe") <= F.to_timestamp(F.lit(as_of)))
    if not curated_mode:
        cond = cond & ~F.coalesce(F.col("irrelevant"), F.lit(False))
    return g.where(cond).drop("irrelevant", "next_probe")
