"""Ingest metrics and counters.

All are grouped aggregations with partial (map-side) combining; windows are
Spark's ``window`` bucketing (no per-row Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_metrics(headers: DataFrame, gated: DataFrame, batch_size: int = 1000) -> DataFrame:
    """E5: per (group, batch of ``batch_size`` article numbers): processed,
    inserted (release keys first seen in this batch), deduplicated, cursor,
    high water, remaining and percent complete."""
    b = F.floor(F.col("article_number") / batch_size).cast("long")
    proc = headers.groupBy("grp", b.alias("batch")).agg(
        F.count(F.lit(1)).alias("processed"), F.max("article_number").alias("cursor"))
    first = gated.groupBy("grp", "dedupe_key").agg(F.min(b).alias("batch"))
    ins = first.groupBy("grp", "batch").agg(F.count(F.lit(1)).alias("inserted"))
    high = headers.groupBy("grp").agg(F.max("article_number").alias("high_water"))
    m = proc.join(ins, ["grp", "batch"], "left").join(high, "grp")
    return m.select(
        "grp", "batch", "processed", F.coalesce("inserted", F.lit(0)).alias("inserted"),
        (F.col("processed") - F.coalesce("inserted", F.lit(0))).alias("deduplicated"),
        "cursor", "high_water",
        F.greatest(F.col("high_water") - F.col("cursor"), F.lit(0)).alias("remaining"),
        F.when(F.col("high_water") > 0, F.floor(F.col("cursor") * 100 / F.col("high_water")).cast("long")).alias("percent_complete"),
    )


def ingest_summary(metrics: DataFrame) -> DataFrame:
    """Totals across groups for each batch index."""
    return metrics.groupBy("batch").agg(
        F.sum("processed").alias("processed"), F.sum("inserted").alias("inserted"),
        F.sum("remaining").alias("remaining"), F.count(F.lit(1)).alias("groups"))


def adaptive_poll_seconds(summary: DataFrame, lo: int = 5, hi: int = 60) -> DataFrame:
    """K5: suggested delay after each batch: ``hi`` when nothing remains, ``lo``
    when nothing was processed, else the shorter the larger the remaining
    share of processed and remaining articles."""
    share = F.col("remaining") / (F.col("processed") + F.col("remaining"))
    delay = (F.when(F.col("remaining") <= 0, F.lit(float(hi))).when(F.col("processed") <= 0, F.lit(float(lo)))
             .otherwise(F.lit(lo) + F.lit(hi - lo) * (1 - share)))
    return summary.withColumn("poll_seconds", delay)


def with_rates(metrics: DataFrame) -> DataFrame:
    """E5 with ``duration_ms`` and ``database_ms`` columns: averages for each header and the group's ETA in seconds
    (null where nothing was processed, no time passed or nothing remains)."""
    known = F.when(F.col("processed") > 0, F.col("processed"))
    rate = known / (F.col("duration_ms") / 1000)
    return metrics.select(
        "*", F.coalesce(F.round(F.col("duration_ms") / known, 3), F.lit(0.0)).alias("average_batch_ms"),
        F.coalesce(F.round(F.col("database_ms") / known, 3), F.lit(0.0)).alias("average_database_latency_ms"),
        F.when((F.col("duration_ms") > 0) & (F.col("remaining") > 0), F.floor(F.col("remaining") / rate)).cast("long").alias("eta_seconds"))


def global_eta(metrics: DataFrame) -> DataFrame:
    """E6 with the ETA over all groups of a batch index (0 where it cannot be told)."""
    s = metrics.groupBy("batch").agg(F.sum("processed").alias("processed"), F.sum("remaining").alias("remaining"), F.sum("duration_ms").alias("duration_ms"))
    told = (F.col("duration_ms") > 0) & (F.col("processed") > 0) & (F.col("remaining") > 0)
    eta = F.floor(F.col("remaining") / (F.col("processed") / (F.col("duration_ms") / 1000)))
    return s.select("batch", "processed", "remaining", F.when(told, eta).otherwise(0).cast("long").alias("eta_seconds"))


def counter_key(name: Column, labels: Column) -> Column:
    """``name{a=1,b=2}``: any number of labels (a map), sorted by name; without labels just the name. Null values are no labels."""
    own = F.filter(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull())
    told = F.array_join(F.transform(F.array_sort(own), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.when(F.size(own) == 0, name).otherwise(F.concat(name, F.lit("{"), told, F.lit("}")))


def counters(events: DataFrame, name: str, labels: Column) -> DataFrame:
    """(key, value) of every name and set of labels."""
    return events.groupBy(counter_key(F.col(name), labels).alias("key")).agg(F.count(F.lit(1)).alias("value"))


def labelled_counters(events: DataFrame, label: str = "k") -> DataFrame:
    """E7 over events with one label in their properties."""
    value = F.get_json_object("props", f"$.{label}")
    return counters(events, "event_type", F.create_map(F.lit(label), value))


def changed_counters(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """E7 emit: keys whose value differs from the previous snapshot."""
    j = cur.join(prev.withColumnRenamed("value", "prev"), "key", "left")
    return j.where(~F.col("value").eqNullSafe(F.col("prev"))).select("key", "value")


def rate_window_counts(events: DataFrame, window: str, limit: int, key: str = "user_id") -> DataFrame:
    """Fixed-window request counts per client with an over-limit flag."""
    w = events.groupBy(F.window("ts", window).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), key, "n", (F.col("n") > limit).alias("over_limit"))


def ingest_freshness(runs: DataFrame, as_of: str, stale_after: int = 600) -> DataFrame:
    """Age of the last good run per group; stale above the threshold or never run."""
    last = runs.groupBy("grp").agg(F.max("run_ts").alias("last_run"))
    age = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("last_run")
    return last.select("grp", "last_run", age.alias("age_seconds"),
                       (F.col("last_run").isNull() | (age > stale_after)).alias("stale"))
