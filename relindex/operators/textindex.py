"""Inverted indexes over the release table (C5, C6, C8): search without reading every row's tokens or title.

A posting is (term, id, bucket, posted_year): a release that has the term. Terms of the token index are
the words of ``search_tokens``; those of the gram index are the distinct runs of three characters of the
lower-cased title, and ``^`` with the first three characters of the tag string.

Layout: ``gen=<g>/seg=<s>/_p=<hash partition of the term>``, sorted by term inside a file. A lookup reads the
partitions of its own terms (constant folding turns the hash of a literal term into a partition filter,
file statistics skip row groups). An update adds a segment that holds only the postings that changed: live
ones and tombstones; the newest segment decides for each (term, id). ``compact`` merges the segments into a
new generation. Document frequencies are kept in the same way, as changes that add up.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search as S

#: Hash partitions of the terms, and characters of a gram.
PARTITIONS, GRAM = 32, 3
_POSTING = "term string, id long, bucket string, posted_year int, live boolean, gen long, seg long, _p int"
_DF = "term string, df long, gen long, seg long, _p int"


def token_terms() -> Column:
    return F.array_distinct("search_tokens")


def grams(text: Column) -> Column:
    """Distinct runs of ``GRAM`` characters of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    at = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, GRAM)))


def gram_terms() -> Column:
    tag = F.when(F.length("tags") >= GRAM, F.array(F.concat(F.lit("^"), F.substring("tags", 1, GRAM)))).otherwise(F.array().cast("array<string>"))
    return F.concat(grams(F.col("norm_title")), tag)


KINDS = {"tokens": token_terms, "grams": gram_terms}


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTITIONS)).cast("int")


class TextIndex:
    """One index (``tokens`` or ``grams``) in a folder. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, kind: str):
        self.spark, self.root, self.kind = spark, f"{root.rstrip('/')}/{kind}", kind

    def _read(self, name: str, schema: str) -> DataFrame | None:
        at = self.current()
        if at is None:
            return None
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return df.where((F.col("gen") == at[0]) & (F.col("seg") <= at[1]))

    def current(self) -> tuple[int, int] | None:
        """(generation, newest segment): the last row of the commits."""
        try:
            r = self.spark.read.schema("gen long, seg long").json(f"{self.root}/commits").agg(F.max(F.struct("gen", "seg")).alias("m")).first()["m"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return (r["gen"], r["seg"]) if r else None

    def _postings_of(self, releases: DataFrame) -> DataFrame:
        return releases.select("id", "bucket", "posted_year", F.explode(KINDS[self.kind]()).alias("term"))

    def _write(self, gen: int, seg: int, postings: DataFrame) -> None:
        """Segment of (term, id, bucket, posted_year, live); a frequency counts live ones and takes tombstones off."""
        at = f"gen={gen}/seg={seg}"
        rows = postings.select("term", "id", "bucket", "posted_year", "live", _part(F.col("term")).alias("_p"))
        # partitions of common terms are split over tasks and files, small ones share a task
        (rows.hint("rebalance", "_p").sortWithinPartitions("_p", "term", "id").write.mode("overwrite").partitionBy("_p")
         .parquet(f"{self.root}/postings/{at}"))
        mine = self.spark.read.schema("term string, id long, bucket string, posted_year int, live boolean, _p int").parquet(f"{self.root}/postings/{at}")
        (mine.groupBy("_p", "term").agg(F.sum(F.when(F.col("live"), 1).otherwise(-1)).alias("df"))
         .sortWithinPartitions("_p", "term").write.mode("overwrite").partitionBy("_p").parquet(f"{self.root}/df/{at}"))
        self.spark.createDataFrame([(gen, seg)], "gen long, seg long").coalesce(1).write.mode("append").json(f"{self.root}/commits")

    def build(self, releases: DataFrame) -> "TextIndex":
        """Index a whole table (with unique ids) in a new generation."""
        at = self.current()
        self._write(0 if at is None else at[0] + 1, 0, self._postings_of(releases).withColumn("live", F.lit(True)))
        return self

    def update(self, old: DataFrame, new: DataFrame) -> int:
        """Index a change: ``old`` are the rows of the touched titles as indexed, ``new`` as they are now.

        Writes the postings that differ, and returns how many: a term that a release keeps is not written.
        """
        gen, seg = self.current()
        a, b = self._postings_of(old), self._postings_of(new)
        gone = a.exceptAll(b).withColumn("live", F.lit(False))
        # a release that moved (other bucket or year) is the same (term, id): its live posting decides
        moved = b.exceptAll(a).withColumn("live", F.lit(True))
        change = gone.join(moved.select("term", "id"), ["term", "id"], "left_anti").unionByName(moved)
        kept = gone.join(moved.select("term", "id"), ["term", "id"], "left_semi")
        # df of a moved posting: one more live row is no further document
        from .ingest import materialize
        change = materialize(change.unionByName(kept.withColumn("live", F.lit(None).cast("boolean"))), "index_change")
        n = change.where("live IS NOT NULL").count()
        self._write_change(gen, seg + 1, change)
        return n

    def _write_change(self, gen: int, seg: int, change: DataFrame) -> None:
        """``live`` null marks the place a moved posting had: it only evens out the frequency."""
        at = f"gen={gen}/seg={seg}"
        p = _part(F.col("term")).alias("_p")
        (change.where("live IS NOT NULL").select("term", "id", "bucket", "posted_year", "live", p).hint("rebalance", "_p")
         .sortWithinPartitions("_p", "term", "id").write.mode("overwrite").partitionBy("_p").parquet(f"{self.root}/postings/{at}"))
        (change.groupBy(p, "term").agg(F.sum(F.when(F.col("live"), 1).otherwise(-1)).alias("df")).where("df <> 0")
         .write.mode("overwrite").partitionBy("_p").parquet(f"{self.root}/df/{at}"))
        self.spark.createDataFrame([(gen, seg)], "gen long, seg long").coalesce(1).write.mode("append").json(f"{self.root}/commits")

    def _live(self, postings: DataFrame) -> DataFrame:
        newest = postings.groupBy("term", "id").agg(F.max_by(F.struct("bucket", "posted_year", "live"), "seg").alias("x"))
        return newest.where("x.live").select("term", "id", "x.bucket", "x.posted_year")

    def compact(self) -> None:
        """Merge all segments into a new generation."""
        gen, _ = self.current()
        self._write(gen + 1, 0, self._live(self._read("postings", _POSTING)).withColumn("live", F.lit(True)))

    def postings(self, term: str) -> DataFrame:
        """(id, bucket, posted_year) of the releases that have the term."""
        t = F.lit(term)
        rows = self._read("postings", _POSTING).where((F.col("_p") == _part(t)) & (F.col("term") == t))
        if self.current()[1] == 0:  # one segment: no posting is written twice
            return rows.where("live").select("id", "bucket", "posted_year")
        return self._live(rows).select("id", "bucket", "posted_year")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Document frequencies of the terms of one query."""
        found = dict.fromkeys(terms, 0)
        parts = F.array(*[_part(F.lit(t)) for t in terms])
        hits = [r[0] for r in self.spark.range(1).select(F.explode(parts)).distinct().collect()]
        df = self._read("df", _DF).where(F.col("_p").isin(hits) & F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df"))
        return found | {r["term"]: r["df"] for r in df.collect()}  # one row for each term of a query

    def candidates(self, terms: list[str]) -> DataFrame:
        """(id, bucket, posted_year) of the releases that have all terms, from the rarest on."""
        n = self.frequencies(terms)
        order = sorted(dict.fromkeys(terms), key=lambda t: (n[t], t))
        out = self.postings(order[0])
        for t in order[1:]:
            out = out.join(self.postings(t), "id", "left_semi")
        return out


def literal_runs(pattern: str) -> list[str]:
    """The runs of a LIKE pattern between its wildcards, escapes taken out."""
    runs, run, k = [], "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            run += pattern[k + 1]
            k += 1
        elif c in "%_":
            runs.append(run)
            run = ""
        else:
            run += c
        k += 1
    return [r for r in (*runs, run) if r]


def query_grams(spark: SparkSession, pattern: str) -> list[str]:
    """The grams that every title under the pattern must have (computed by Spark, so that letters fold alike)."""
    runs = literal_runs(pattern)
    if not runs:
        return []
    row = spark.range(1).select(F.array_distinct(F.flatten(F.array(*[grams(F.lit(r)) for r in runs]))).alias("g")).first()
    return row["g"]


def _among(releases: DataFrame, found: DataFrame) -> DataFrame:
    """Releases among the candidates; partition columns are part of the join, so the scan is pruned to theirs."""
    f = found.select(F.col("id").alias("_id"), F.col("bucket").alias("_bucket"), F.col("posted_year").alias("_year"))
    on = (F.col("id") == F.col("_id")) & F.col("bucket").eqNullSafe(F.col("_bucket")) & F.col("posted_year").eqNullSafe(F.col("_year"))
    return releases.join(f, on, "left_semi")


def text_match(releases: DataFrame, tokens: TextIndex, q: str) -> DataFrame:
    """C5 over the token index: every query token present; no tokens -> no rows."""
    terms = S.query_tokens(q)
    return _among(releases, tokens.candidates(terms)) if terms else releases.where(F.lit(False))


def title_contains(releases: DataFrame, index: TextIndex, q: str) -> DataFrame:
    """C6 over the gram index: candidates have all grams of the query, ``ILIKE`` decides; a query
    without a run of three characters scans."""
    need = query_grams(releases.sparkSession, q)
    return S.title_contains(_among(releases, index.candidates(need)) if need else releases, q)


def tag_prefix(releases: DataFrame, index: TextIndex, tag: str) -> DataFrame:
    """C8 over the gram index; a prefix under three characters scans."""
    return S.tag_prefix(_among(releases, index.candidates([f"^{tag[:GRAM]}"])) if len(tag) >= GRAM else releases, tag)


def search(releases: DataFrame, sq: S.SearchQuery, tokens: TextIndex, index: TextIndex) -> DataFrame:
    """J1 over the indexes: the same page as ``search.search``."""
    sq = sq.validated()
    df = S.category_in(S.searchable(releases), S.split_categories(sq.cat))
    if sq.q:
        df = text_match(df, tokens, sq.q) if sq.has_vector else title_contains(df, index, sq.q)
    if sq.tag:
        df = tag_prefix(df, index, sq.tag)
    return S.order_and_page(df, sq.sort, sq.limit, sq.offset)


def new_root(spark: SparkSession) -> str:
    from ..session import table_path
    return table_path(spark, f"textindex-{uuid.uuid4().hex[:8]}")
