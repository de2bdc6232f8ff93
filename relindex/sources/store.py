"""Release store: Parquet partitioned by ``bucket`` / ``posted_year`` (A3, A4).

Writes never overwrite the path being read: each write, a prune's write-back
included, goes to a new versioned directory.
Within each task rows are sorted by ``posted_at`` so file min/max statistics
let date predicates skip row groups.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table_path

PARTITION_COLS = ["bucket", "posted_year"]

RELEASE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("norm_title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("source_group", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("posted_at", T.TimestampType()),
    T.StructField("has_parts", T.BooleanType()),
    T.StructField("part_count", T.IntegerType()),
    T.StructField("search_tokens", T.ArrayType(T.StringType())),
    T.StructField("bucket", T.StringType()),
    T.StructField("posted_year", T.IntegerType()),
])


def new_path(spark: SparkSession, name: str = "releases") -> str:
    return table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def write_releases(df: DataFrame, path: str | None = None, mode: str = "overwrite",
                   max_records_per_file: int = 5_000_000, inventory: bool = False) -> str:
    """A4: partitioned write. No shuffle is added: each task writes its rows
    into the partition directories it holds (a hot category/year is spread
    over many tasks and files instead of landing in one). With ``inventory``
    the partitions' figures are written beside them."""
    spark = df.sparkSession
    path = path or new_path(spark)
    cols = [f.name for f in RELEASE_SCHEMA.fields if f.name in df.columns]
    (df.select(*cols)
       .sortWithinPartitions(*PARTITION_COLS, "posted_at")
       .write.mode(mode)
       .option("maxRecordsPerFile", max_records_per_file)
       .partitionBy(*PARTITION_COLS)
       .parquet(path))
    if inventory:
        write_inventory(spark, path)
    return path


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """A3: scan with partition discovery; ``posted_year`` typed as int. A table version without rows (a prune
    took them all) has no file to tell its columns: it is read by ``RELEASE_SCHEMA``."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        df = spark.read.schema(RELEASE_SCHEMA).parquet(path)
    return df.withColumn("posted_year", F.col("posted_year").cast("int"))


def rewrite(kept: DataFrame, removed: DataFrame, path: str, target: str | None = None) -> str:
    """Write-back of a prune: a new table version of the ``kept`` rows of ``path``.

    Partitions that lose no row are copied as they are (they are only read
    under a partition filter), those that lose rows are written without them,
    and those that lose all rows are not in the new version at all.
    """
    touched = removed.select(*PARTITION_COLS).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PARTITION_COLS]
    mark = touched.select(*[F.col(c).alias(f"_{c}") for c in PARTITION_COLS])
    whole = read_releases(kept.sparkSession, path).join(F.broadcast(mark), same, "left_anti")  # categories x years: a bounded list
    part = kept.join(F.broadcast(mark), same, "left_semi")
    return write_releases(whole.unionByName(part, allowMissingColumns=True), target)


# ---------------------------------------------------------------- inventory

def write_inventory(spark: SparkSession, path: str) -> None:
    """One row for each partition of the table at ``path``: rows, rows without a date, least and greatest ``posted_at`` and size.

    It lies in ``<path>/_inventory``, which table scans do not see.
    """
    r = read_releases(spark, path)
    (r.groupBy(*PARTITION_COLS).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("posted_at").isNull(), 1)).alias("n_undated"),
        F.min("posted_at").alias("first_posted"), F.max("posted_at").alias("last_posted"),
        F.min("size_bytes").alias("least_size"), F.max("size_bytes").alias("most_size"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/_inventory"))


INVENTORY = ("bucket string, posted_year int, n long, n_undated long, first_posted timestamp, last_posted timestamp, "
             "least_size long, most_size long")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INVENTORY).parquet(f"{path}/_inventory")


def partition_filter(rows) -> Column:
    """A predicate on the partition columns alone (directories are chosen by it, no file is read for it)."""
    out = F.lit(False)
    for r in rows:
        out = out | (F.col("bucket").eqNullSafe(F.lit(r["bucket"])) & F.col("posted_year").eqNullSafe(F.lit(r["posted_year"]).cast("int")))
    return out


# ---------------------------------------------------------------- seek paging

def page_key() -> Column:
    """The page order (date descending, undated first, then title and category) as a value that rises."""
    return F.struct(F.col("posted_at").isNotNull().alias("dated"), F.coalesce(-F.unix_micros("posted_at"), F.lit(0).cast("long")).alias("age"),
                    F.col("norm_title").alias("title"), F.col("category_id").alias("category_id"))


_KEY = "struct<dated:boolean,age:bigint,title:string,category_id:int>"


def write_pages(releases: DataFrame, path: str, rows_per_file: int = 100_000) -> str:
    """A copy in page order: range-partitioned files, and a small index with each file's rows and first key."""
    spark = releases.sparkSession
    n = max(1, -(-releases.count() // rows_per_file))
    k = releases.withColumn("_key", page_key()).repartitionByRange(n, "_key").sortWithinPartitions("_key")
    k.withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    k.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")  # an empty file, for tables without rows
    (spark.read.schema(f"_key {_KEY}, part int").parquet(f"{path}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("first"))
     .write.mode("overwrite").parquet(f"{path}/index"))
    return path


def seek_page(spark: SparkSession, path: str, limit: int, after=None) -> DataFrame:
    """The next ``limit`` rows after the key ``after`` (a row's ``_key``; None: from the start), in page order.

    Only the files that hold them are read: the file of ``after`` and as many following ones as it takes,
    so page 1000 costs what page 1 costs.
    """
    index = spark.read.schema(f"part int, n long, first {_KEY}").parquet(f"{path}/index")
    key = None if after is None else F.struct(*[F.lit(after[f]).cast(t).alias(f) for f, t in (("dated", "boolean"), ("age", "bigint"), ("title", "string"), ("category_id", "int"))])
    start = 0 if key is None else index.where(F.col("first") <= key).agg(F.max("part")).first()[0] or 0
    parts, room = [], limit
    while room > 0:
        more = index.where(F.col("part") > (parts[-1] if parts else start - 1)).orderBy("part").limit(1).first()
        if more is None:
            break
        parts.append(more["part"])
        if len(parts) > 1 or key is None:  # of the first file any number of rows may lie before ``after``
            room -= more["n"]
    if not parts:
        return spark.read.parquet(f"{path}/schema")
    rows = spark.read.parquet(f"{path}/rows")
    page = rows.where(F.col("part").isin(parts)).drop("part")
    return (page if key is None else page.where(F.col("_key") > key)).orderBy("_key").limit(limit)
