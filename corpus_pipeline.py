"""From raw documents to a training mix: five stages, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
Null and repeated ``doc_id`` are documents of their own in every stage: where an operator's answer
is joined back, the rows are numbered first and the join is on that number (decontamination carries whole rows instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relindex.llm import curriculum, decontaminate, jaccard_join, langid, pii
from relindex.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The near-duplicate stage: words of a shingle, percent of the union.
SHINGLE, PERCENT = 5, 80

#: The decontamination stage: words of an item from which its occurrence is a leak (an answer such as 'yes' is in clean
#: documents too). A word is what it is to decontaminate.
LEAK_WORDS = 8
_FOLDED_WORD = r"[^\x00-/:-@\[-`{-\x7F]+"


def numbered(docs: DataFrame) -> DataFrame:
    """``COLUMNS`` and ``row``, a number that no other row has; stored, so that it is the same wherever it is read."""
    return stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are learnt from all documents that have one. Documents without any letter are
    rejected (null and empty texts too); a null ``lang`` takes the prediction, and stays null where no
    document has a language to learn from."""
    d = docs.select(*COLUMNS)
    r = langid.identify(d, langid.train(d), carry=("text", "lang", "source", "n_chars"), unlearnt=None)
    return (r.where(~F.col("lang_pred").eqNullSafe(langid.UNDETERMINED))
            .select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least ``doc_id`` stays (null after all others;
    of equal ``doc_id`` the one with the least hash of its columns, of equal rows any)."""
    d = numbered(docs)
    groups = jaccard_join.jaccard_join(d, key="row", size=SHINGLE, percent=PERCENT).select("row", "component")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*COLUMNS), F.col("row").alias("kept"))
    places = d.select("row", order.alias("place"))
    kept = groups.join(places, "row").groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.kept").alias("row"))
    return d.join(kept, "row", "left_semi").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item of ``LEAK_WORDS`` words or more go."""
    d = docs.select(F.struct(*COLUMNS).alias("row"), "text")  # the answer depends on the text only: whole rows go along
    items = table(spark, sf_dir, "benchmark").where(F.regexp_count("text", F.lit(_FOLDED_WORD)) >= LEAK_WORDS)
    r = decontaminate.decontaminate(d, items, key="row")
    return r.where(F.size("spans") == 0).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    d = docs.select(*COLUMNS)
    r = pii.find_pii(d, pii.train(pii.labelled_table(d)), carry=("text", "lang", "source", "n_chars"))
    r = r.withColumn("clean", pii.masked(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    return r.select("doc_id", F.col("clean").alias("text"), "lang", "source",
                    F.when(changed, F.length("clean")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: documents that it takes, with their words taken and training positions, in order."""
    d = numbered(docs)
    m = curriculum.mix(d, carry=("row",)).where("taken > 0").select("row", "size", "target", "taken", "positions")
    return (d.join(m, "row").drop("row")
            .withColumn("position", F.get("positions", F.lit(0))).orderBy("position", "doc_id"))


STAGES = [("language_id", identify_language), ("jaccard_join", drop_near_copies), ("decontamination", drop_benchmark_leaks),
          ("pii", mask_personal_data), ("mix", mix_sources)]

#: The language profiles and the random field are no SQL; tests/llm holds the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the training mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
