"""Configuration tables (A14, A16, B21): JSON files read with a schema.

Each reader returns the usable rows and the rejects, so a bad entry is seen
instead of silently skipped; the callers turn the few rows of a checked table
into the constants that the column functions compile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

#: Rows of a configuration table at most; a larger file is not a configuration.
MAX_ROWS = 10_000


def _table(spark: SparkSession, path: str, schema: str, good) -> tuple[DataFrame, DataFrame]:
    rows = (spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
            .option("multiLine", "true").json(path))
    ok = F.coalesce(F.col("_corrupt").isNull() & good, F.lit(False))
    return rows.where(ok).drop("_corrupt"), rows.where(~ok)


def _few(df: DataFrame) -> list:
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a configuration table has more than {MAX_ROWS} rows")
    return rows


def read_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Category dimension (id, name) from a JSON array, and rejects."""
    return _table(spark, path, "id string, name string", F.col("id").isNotNull() & F.col("name").isNotNull())


def read_hints(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Group hints (token, key, pos) from a JSON array, and rejects: unknown category keys and empty tokens."""
    known = F.lower("key").isin([*C.CATEGORY_KEYS])
    return _table(spark, path, "token string, key string, pos int", (F.length("token") > 0) & known)


def hints_from(spark: SparkSession, extra: DataFrame) -> C.Hints:
    """A16 -> B14: the default hints with the configured ones after them, in order of ``pos``."""
    rows = _few(extra.orderBy("pos", "token").select("token", "key"))
    return C.Hints([*C.DEFAULT_GROUP_HINTS, *((r["token"], r["key"]) for r in rows)])


def size_policy(policy: DataFrame) -> tuple[C.SizePolicy, DataFrame]:
    """A table (kind, key, size) of kinds exact, pattern, floor and max -> policy and rejects.

    A pattern is tried against an empty text in Spark, so the regex dialect that will run it judges it.
    """
    rows = policy.select("kind", "key", F.col("size").try_cast("long").alias("size"))
    ok = F.coalesce(F.col("kind").isin("exact", "pattern", "floor", "max") & (F.col("size") >= 0)
                    & ((F.col("kind") != "floor") | F.col("key").rlike("^[0-9]+$")), F.lit(False))
    good = {k: [] for k in ("exact", "pattern", "floor", "max")}
    for r in _few(rows.where(ok).orderBy("kind", "key")):
        good[r["kind"]].append((r["key"], r["size"]))
    floors = {**C.DEFAULT_CATEGORY_MIN_SIZES, **{int(k): v for k, v in good["floor"]}}
    return C.SizePolicy(dict(good["exact"]), good["pattern"], floors, max((v for _, v in good["max"]), default=0)), rows.where(~ok)
