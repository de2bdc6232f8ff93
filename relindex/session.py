"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC timestamps and AQE for runtime re-planning
# (partition coalescing, skew-join splitting, broadcast conversion from
# measured sizes). Shuffle partition count is left to the caller/cluster.
CORE_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a generated method above this size is never compiled by the JVM: the parse would run interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.timestampNTZ.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "relindex") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in CORE_CONF.items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RELINDEX_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> None:
    """Apply the session-level settings the library needs (idempotent)."""
    for k, v in CORE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local master (tests) may lack the setting; a scratch folder is made
    and recorded then. Elsewhere a folder of one machine would be lost or
    unseen, so its absence is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="relindex-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


#: Scratch tables that this process has named, oldest first.
_scratch: list[str] = []


def table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for an intermediate table."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    _scratch.append(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files when they end; else those stay on disk until the driver's garbage collector
    comes upon the plan. For writes only: the plan of a write is run once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def drop_batch_shuffles(batch: DataFrame) -> int:
    """Delete the shuffle files behind a micro-batch that ``foreachBatch`` has stored; the stream's own plan is no write, so
    ``dropped_shuffles`` does not reach them. Returns their number. A replay of the batch runs a new plan."""
    cleaner = batch.sparkSession.sparkContext._jsc.sc().cleaner()
    todo, seen, ids = [batch._jdf.queryExecution().toRdd()], set(), set()
    while todo:
        rdd = todo.pop()
        if rdd.id() in seen:
            continue
        seen.add(rdd.id())
        deps = rdd.dependencies()
        for dep in (deps.apply(i) for i in range(deps.size())):
            if dep.getClass().getSimpleName() == "ShuffleDependency":
                ids.add(dep.shuffleId())
            todo.append(dep.rdd())
    if cleaner.isDefined():
        for i in ids:
            cleaner.get().doCleanupShuffle(i, False)
    return len(ids)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; call it when the results that read them are stored.

    Results are lazy, so a query cannot do this itself.
    """
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n
