"""Shared plan pieces for the registered queries: the header fixture, the
parsed headers and the release table, each derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources.headers import fixture_headers

# Fixed "now" for the time-dependent operators: the fixture's dates run
# 1995-01-01 .. 2001-08-01, so pruning and feeds take an explicit instant.
AS_OF = "2001-12-31 00:00:00"


def ts_text(c: Column) -> Column:
    """Timestamps leave oracle-checked queries as text (zone-free, exact)."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_headers(spark, sf_dir, deal=max(deal(spark), 3 * spark.sparkContext.defaultParallelism))


def unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers for a job that only stores them: nothing is dealt out for a parse."""
    return fixture_headers(spark, sf_dir)


def deal(spark: SparkSession) -> int:
    """Partitions for the parse: the driver's ``lineitem`` is a single file of one row group."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated parsed headers, materialized once per call under the checkpoint folder."""
    return ingest.parsed_table(headers(spark, sf_dir))


def folded(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Ungated parsed headers with the columns of the fold, and ``extra`` ones, materialized."""
    return ingest.fold_table(headers(spark, sf_dir), extra=extra)


def parsed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungated parsed headers (gate flags kept as columns), materialized."""
    return ingest.materialize(ingest.parse_headers(headers(spark, sf_dir)), "parsed_all")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release table (with partition + token columns) built from the fixture."""
    return ingest.with_storage_columns(ingest.build_releases(ingest.gate(folded(spark, sf_dir))))
