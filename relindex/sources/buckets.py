"""Versioned tables in hash buckets: a commit rewrites the buckets it touches and carries the others over by name.

A store is a folder with

* ``data/<batch>-<tag>/<table>/_b=<bucket>/``: Parquet files of one version of one bucket;
* ``commits/<batch>/``: one JSON row for each table and bucket that has rows, with the folder that holds it.

The commit folder is written last, by Spark, and counts once its ``_SUCCESS`` file is there; so a reader
never sees half a version and a writer that dies leaves files that nobody names. The newest commit alone
says what is current: its size is tables x buckets, whatever the number of versions. ``keep`` versions
stay readable, what none of them names is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped_shuffles

_COMMIT = "tbl string, bucket int, path string"
_META, _BUCKETS = "_meta", "_buckets"


class BucketStore:
    """Tables (name -> column that its rows are bucketed by) under one root. A store keeps the number of buckets it was made with."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], buckets: int = 64, keep: int = 3):
        self.spark, self.root, self.tables, self.keep = spark, root.rstrip("/"), tables, max(1, keep)
        self.buckets = next((b for t, b in self.manifest() if t == _BUCKETS), buckets)

    # -- the file system that Spark writes to
    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _commits(self) -> list[str]:
        fs = self._fs()
        return [n for n in self._names(f"{self.root}/commits") if fs.exists(self._path(f"{self.root}/commits/{n}/_SUCCESS"))]

    def bucket_of(self, col: Column) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(self.buckets)).cast("int")

    def manifest(self, name: str | None = None) -> dict[tuple[str, int], str]:
        """(table, bucket) -> folder of a commit, the newest unless named."""
        name = name or next(iter(self._commits()[-1:]), None)
        if name is None:
            return {}
        rows = self.spark.read.schema(_COMMIT).json(f"{self.root}/commits/{name}").collect()  # tables x buckets rows
        return {(r["tbl"], r["bucket"]): r["path"] for r in rows}

    def batch_id(self) -> int | None:
        """Number of the newest commit."""
        done = self._commits()
        return int(done[-1]) if done else None

    def meta(self) -> str | None:
        return self.manifest().get((_META, 0))

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a table, or of some of its buckets; None if there are none."""
        at = self.manifest()
        want = None if buckets is None else set(buckets)
        paths = [p for (t, b), p in sorted(at.items()) if t == table and (want is None or b in want)]
        return self.spark.read.parquet(*paths) if paths else None

    def touched(self, keys: DataFrame, column: str) -> list[int]:
        """Buckets of the keys (at most ``buckets`` numbers)."""
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(column)).alias("b")).distinct().collect())

    def commit(self, batch_id: int, touched: dict[str, list[int] | None], meta: str | None = None, **tables: DataFrame) -> None:
        """Write the ``touched`` buckets of each table (None: all) anew and carry the others over."""
        at = self.manifest()
        version = f"{self.root}/data/{batch_id:012d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            gone = touched.get(name)
            at = {(t, b): p for (t, b), p in at.items() if t != name or (gone is not None and b not in gone)}
            rows = df.withColumn("_b", self.bucket_of(F.col(self.tables[name])))
            # AQE packs small buckets together and splits a hot one over several tasks
            # the rows of a title lie together, so that its columns take little room
            rows = rows.hint("rebalance", "_b").sortWithinPartitions("_b", self.tables[name])
            with dropped_shuffles(rows.sparkSession):
                rows.write.partitionBy("_b").option("compression", "zstd").parquet(f"{version}/{name}")
            for folder in self._names(f"{version}/{name}"):
                if folder.startswith("_b="):
                    at[name, int(folder[3:])] = f"{version}/{name}/{folder}"
        at = {k: p for k, p in at.items() if k[0] not in (_META, _BUCKETS)} | {(_BUCKETS, self.buckets): ""}
        rows = [(t, b, p) for (t, b), p in sorted(at.items())] + ([(_META, 0, meta)] if meta is not None else [])
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.root}/commits/{batch_id:012d}")
        self.vacuum()

    def vacuum(self) -> int:
        """Delete commits beyond the newest ``keep`` and the folders that no kept commit names."""
        fs, done, n = self._fs(), self._commits(), 0
        for name in done[:-self.keep]:
            n += fs.delete(self._path(f"{self.root}/commits/{name}"), True)
        kept = done[-self.keep:]
        # paths as names below the root: the file system may spell the root differently
        named = {p.split(f"{self.root}/data/", 1)[-1] for c in kept for (t, _), p in self.manifest(c).items() if t not in (_META, _BUCKETS)}
        newest = int(done[-1]) if done else -1
        for version in self._names(f"{self.root}/data"):
            if int(version.split("-")[0]) > newest:
                continue  # a batch that is being written
            for table in self._names(f"{self.root}/data/{version}"):
                for folder in self._names(f"{self.root}/data/{version}/{table}"):
                    if folder.startswith("_b=") and f"{version}/{table}/{folder}" not in named:
                        n += fs.delete(self._path(f"{self.root}/data/{version}/{table}/{folder}"), True)
            if not any(x.startswith(f"{version}/") for x in named):
                n += fs.delete(self._path(f"{self.root}/data/{version}"), True)
        return n
