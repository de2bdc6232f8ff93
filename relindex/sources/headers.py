"""Header sources.

A1 ``read_headers``: overview records from files (JSON lines or Parquet),
unifying the ``:bytes`` spelling; an article range becomes a pushed-down
filter. The fixture builder derives the same record shape from the driver's
TPC-H-style tables so every registered query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_SCHEMA = T.StructType([
    T.StructField("grp", T.StringType()),
    T.StructField("article_number", T.LongType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("date", T.StringType()),
])

# Raw overview records may carry the size as ``bytes`` or ``:bytes`` (text or int).
RAW_HEADER_SCHEMA = T.StructType([
    T.StructField("group", T.StringType()),
    T.StructField("article_number", T.LongType()),
    T.StructField("message-id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("bytes", T.StringType()),
    T.StructField(":bytes", T.StringType()),
    T.StructField("date", T.StringType()),
])

FIXTURE_GROUPS = ["hdtv", "movies", "tv", "e-book", "music.flac", "sounds.mp3", "games", "misc"]
REPOST_GROUP = "alt.binaries.repost"


def _int_or_zero(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("long"), F.lit(0).cast("long"))


def unify_raw(df: DataFrame) -> DataFrame:
    """``bytes or :bytes or 0`` and the canonical column names."""
    return df.select(
        F.col("`group`").alias("grp"),
        F.col("article_number").cast("long").alias("article_number"),
        F.col("`message-id`").alias("message_id"),
        F.col("subject"),
        F.coalesce(
            F.nullif(_int_or_zero(F.col("bytes")), F.lit(0)),
            F.nullif(_int_or_zero(F.col("`:bytes`")), F.lit(0)),
            F.lit(0).cast("long"),
        ).alias("bytes"),
        F.col("date"),
    )


def read_headers(spark: SparkSession, path: str, fmt: str = "json",
                 group: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """A1: overview records, optionally one group and an article range
    (``xover(group, start, end)``); filters reach the scan."""
    if fmt == "json":
        df = unify_raw(spark.read.schema(RAW_HEADER_SCHEMA).json(path))
    else:
        df = spark.read.schema(HEADER_SCHEMA).parquet(path)
    if group is not None:
        df = df.where(F.col("grp") == group)
    if start is not None:
        df = df.where(F.col("article_number") >= start)
    if end is not None:
        df = df.where(F.col("article_number") <= end)
    return df


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver parquet table; zone-less timestamps are read as session-zone (UTC) timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def _subject(v: Column) -> Column:
    """Subject text per lineitem row; ``v = l_orderkey % 16`` selects a variant."""
    ln = F.col("l_linenumber").cast("string")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    tag = F.concat(F.lit("["), F.col("p_type"), F.lit("] "))
    part = F.concat(F.lit(".part0"), ln, F.lit(".rar ("), ln, F.lit("/7)"))
    return (
        F.when(v == 1, F.concat(tag, name, F.lit(".S01E02.720p"), part, F.lit(" yEnc")))
        .when(v == 2, F.concat(F.lit("[FRENCH] "), name, part, F.lit(" yEnc")))
        .when(v == 3, F.concat(name, F.lit("-Greatest-2021-FLAC-320"), part))
        .when(v == 4, F.concat(name, F.lit("-Title-2020-EPUB-1234567890"), part))
        .when(v == 5, F.concat(tag, name, part, F.lit(" repost yEnc")))
        .when(v == 7, F.concat(tag, F.col("p_name"), F.lit(" ("), ln, F.lit("/7)")))
        .when(v == 8, F.concat(F.lit("Studio."), name, F.lit(".2022.1080p"), part))
        .when(v == 9, F.concat(F.lit("[tv] "), name, part, F.lit(" yEnc")))
        .otherwise(F.concat(tag, name, part, F.lit(" yEnc")))
    )


def fixture_headers(spark: SparkSession, sf_dir: str, reposts: bool = True, deal: int | None = None) -> DataFrame:
    """Header records derived from ``lineitem ⋈ orders ⋈ part``.

    ``article_number = l_orderkey * 8 + l_linenumber`` is a plain expression
    (no window), so the fixture costs one join and no single-task ranking.
    The synthetic lineitem repeats some ``(orderkey, linenumber)`` pairs, so
    consumers order first-wins rules by ``(article_number, message_id, bytes)``.
    Reposts copy every row with ``article_number % 20 = 0`` into one more group.
    ``deal`` is the number of tasks of what follows the joins: an exchange of a given number is not merged by its bytes,
    which tell nothing of the work of the texts made and parsed then. The joined rows are dealt, not an input of the joins:
    once ``part`` is too large to broadcast, its join has an exchange of its own, which would undo the deal.
    """
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey)
    if deal:
        j = j.repartition(deal, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    grp_name = F.concat(
        F.lit("alt.binaries."),
        F.element_at(F.array(*[F.lit(g) for g in FIXTURE_GROUPS]), (F.col("l_suppkey") % 8 + 1).cast("int")),
    )
    v = F.col("l_orderkey") % 16
    posted = F.date_trunc("quarter", F.col("o_orderdate"))
    base = j.select(
        grp_name.alias("grp"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("article_number"),
        F.concat(F.lit("<"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"),
                 F.lit("."), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_suppkey").cast("string"),
                 F.lit("@x>")).alias("message_id"),
        _subject(v).alias("subject"),
        F.when(F.col("l_partkey") % 50 == 0, F.lit(0).cast("long"))
        .otherwise(F.floor(F.col("l_extendedprice")).cast("long") * 1000).alias("bytes"),
        F.when(v == 6, F.lit(None).cast("string"))
        .otherwise(F.date_format(posted, "EEE, dd MMM yyyy HH:mm:ss Z")).alias("date"),
        (F.col("l_suppkey") % 8).alias("_gi"),
    )
    if not reposts:
        return base.drop("_gi")
    own = F.struct("grp", "article_number")
    again = F.struct(F.lit(REPOST_GROUP).alias("grp"), (F.col("article_number") * 8 + F.col("_gi")).alias("article_number"))
    posts = F.when(F.col("article_number") % 20 == 0, F.array(own, again)).otherwise(F.array(own))
    return base.select(F.inline(posts), "message_id", "subject", "bytes", "date")
