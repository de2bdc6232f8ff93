"""Statistical language identification as a Spark job (character trigrams).

Every trigram of every document counts, in training and in scoring: a language
has the smoothed relative frequency of each of its trigrams, a document takes
the language with the largest log-likelihood. Scoring is an equi-join of the
documents' distinct trigrams with the languages' on ``gram``; a trigram that a
language lacks is settled from the document's total, so nothing is crossed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, gram, n) over the whole lower-cased, letter-only text."""
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"(?U)[^\p{L}]+", " ")), F.lit(" "))
    d = docs.select("doc_id", s.alias("s")).where(F.length("s") >= 3)
    # one pass over the text: ``substring`` at each place would walk to it from the start, the square of the length
    g = d.select("doc_id", F.explode(F.regexp_extract_all("s", F.lit(r"(?s)(?=(...))."), 1)).alias("gram"))
    return g.where(~F.col("gram").contains("  ")).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))


def train_profiles(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(lang, gram, weight, missing): log-likelihood of a trigram with add-one smoothing, and that of one
    the language never had."""
    lg = grams.join(docs.select("doc_id", "lang").where(F.col("lang").isNotNull()), "doc_id") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = lg.groupBy("lang").agg(F.sum("n").alias("total"))
    kinds = lg.select("gram").distinct().agg(F.count(F.lit(1)).alias("kinds"))
    base = F.col("total") + F.col("kinds")
    return lg.join(total, "lang").join(F.broadcast(kinds)).select(
        "lang", "gram", F.ln((F.col("n") + 1) / base).alias("weight"), F.ln(1 / base).alias("missing"))


def classify(grams: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, predicted): the language with the largest log-likelihood, ties by name. Languages are few
    (their list and constants are broadcast); a document that shares no trigram with any has none."""
    gain = (grams.join(profiles, "gram").groupBy("doc_id", "lang")
            .agg(F.sum(F.col("n") * (F.col("weight") - F.col("missing"))).alias("gain")))
    constants = profiles.groupBy("lang").agg(F.min("missing").alias("missing"))
    size = grams.groupBy("doc_id").agg(F.sum("n").alias("size"))
    scored = gain.join(F.broadcast(constants), "lang").join(size, "doc_id").withColumn(
        "score", F.col("gain") + F.col("size") * F.col("missing"))
    return scored.groupBy("doc_id").agg(F.min_by("lang", F.struct(-F.col("score"), "lang")).alias("predicted"))
