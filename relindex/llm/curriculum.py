"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule (piecewise
linear in time); its integral is the source's cumulative token demand, which
ends at the source's target. The documents of a source stand in a fixed random
order, pass after pass, and a document's first token is due when the demand
reaches the tokens before it: inverting the demand gives its training
position. Documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_WORD, stored

#: Buckets of a source's random order (three hex digits): the running sum of a hot source is made in so many parts.
BUCKET_DIGITS = 3

#: Schedules of the contract's three weights: (time, relative rate) knots.
#: Heavy sources fade out, light ones grow; the mean rate of each is 1.
KNOTS = {5: [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)], 2: [(0.0, 1.0), (1.0, 1.0)], 1: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]}


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(BLANK_WORD)).cast("long")


def sizes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``source``, ``no_source`` (0, or 1 for null, which sorts last), ``size``, ``h`` (place in the random order), ``carried``
    (a struct of the columns of ``carry``, if any)."""
    t = F.col(text)
    return docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.when(F.col(source).isNull(), 1).otherwise(0).alias("no_source"), word_count(t).alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("h"), F.xxhash64(t).alias("tie"),
        *[F.struct(*carry).alias("carried")] * bool(carry))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights in code point order, null last. One row for each source: a small dimension."""
    k = (F.row_number().over(Window.orderBy("no_source", "source")) - 1) % len(cycle)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(c) for c in cycle]), (k + 1).cast("int")))


def targets(sources: DataFrame, *, repeats: int = 3) -> DataFrame:
    """Adds ``target``: all sizes shared by weight; a source stops at ``repeats`` times its size and
    the excess is shared by weight among the others until none is above.

    With the sources in order of cap by weight, those before the first one whose cap is not reached
    are capped; the rest share what is left.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (sources.withColumn("cap", F.col("source_size") * float(repeats))
         .withColumn("total", F.sum("source_size").over(every))
         .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
         .withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("capped"), F.col("level"))))
                     .over(every)["level"]))
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))) \
        .select("source", "no_source", "source_size", "weight", "target")


def due(knots, share):
    """The time at which the integral of the schedule reaches ``share`` of its whole.

    ``knots``: array of structs ``t``, ``r`` (rate at t), ascending. Within a piece the integral is a
    parabola; the stable form of the quadratic's root is taken.
    """
    pieces = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(
        F.element_at(knots, i)["t"].alias("t"), F.element_at(knots, i)["r"].alias("r"),
        (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]).alias("w"),
        (F.element_at(knots, i + 1)["r"] - F.element_at(knots, i)["r"]).alias("d"),
        ((F.element_at(knots, i + 1)["r"] + F.element_at(knots, i)["r"]) / 2
         * (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"])).alias("a")))
    whole = F.aggregate(pieces, F.lit(0.0), lambda x, p: x + p["a"])
    start = F.struct((share * whole).alias("left"), F.lit(None).cast("double").alias("at"))

    def walk(x, p):
        left = x["left"]
        root = F.sqrt(F.greatest(p["r"] * p["r"] + 2 * p["d"] / p["w"] * left, F.lit(0.0)))
        here = p["t"] + F.when(left <= 0, 0.0).otherwise(2 * left / (p["r"] + root))
        return F.when(x["at"].isNotNull(), x).when(left <= p["a"], F.struct(left.alias("left"), here.alias("at"))) \
            .otherwise(F.struct((left - p["a"]).alias("left"), F.lit(None).cast("double").alias("at")))

    return F.aggregate(pieces, start, walk, lambda x: F.coalesce(x["at"], F.lit(1.0)))


def knots_of(weight, schedules: dict = KNOTS):
    """The schedule of a weight; a constant rate where it has none."""
    def arr(k):
        return F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(r)).alias("r")) for t, r in k])
    out = arr([(0, 1), (1, 1)])
    for w, k in schedules.items():
        out = F.when(weight == w, arr(k)).otherwise(out)
    return out


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
        cycle: tuple[int, ...] = (5, 2, 1), repeats: int = 3, schedules: dict = KNOTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: ``key``, the columns of ``carry``, ``size``, ``source_size``, ``target``,
    ``taken`` and ``positions``, the training positions (0 to 1) of its copies, ascending.

    A source is taken in whole passes, and the last pass ends with the document whose middle the
    target passes, so its words come within half a document of the target. A null text has size 0 and
    is never taken; null sources are one source, last in order; null keys and repeated rows are
    documents of their own (rows that are equal share their places by turns, the result does not
    depend on which, but for ``carry``, by which they are ordered then); an empty table gives an empty result. Other columns are not looked at.

    Plan: sizes are counted once and stored; a source's running sum is the sum of the buckets before
    plus a window within one of 4096 buckets, so a source with a third of all rows spreads out.
    """
    s = stored(sizes(docs, key=key, text=text, source=source, carry=carry), "sizes").withColumn("b", F.substring("h", 1, BUCKET_DIGITS))
    per_bucket = s.groupBy("source", "no_source", "b").agg(F.sum("size").alias("n"))
    plan = targets(cyclic_weights(per_bucket.groupBy("source", "no_source").agg(F.sum("n").alias("source_size")), cycle), repeats=repeats)
    ahead = Window.partitionBy("source", "no_source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_bucket.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
               .join(plan, ["source", "no_source"]).select("source", "no_source", "b", "ahead", "source_size", "weight", "target"))
    within = Window.partitionBy("source", "no_source", "b").orderBy("h", "size", "tie", *["carried"] * bool(carry)).rowsBetween(Window.unboundedPreceding, -1)
    d = (s.join(offsets, ["source", "no_source", "b"])
         .withColumn("first", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
         .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
         .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
         .withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(
             F.col("passes") + F.when(F.col("first") + F.col("size") / 2 < F.col("rest"), 1).otherwise(0)).cast("int")))
    share = lambda j: (j * F.col("source_size") + F.col("first")) / F.greatest(F.col("target"), F.lit(1.0))
    at = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda j: due(knots_of(F.col("weight"), schedules), F.least(share(j), F.lit(1.0))))
    return d.select(F.col("key").alias(key), *[F.col("carried")[c].alias(c) for c in carry], "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                    F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<double>")).alias("positions"))


def training_order(mixed: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """One row for each copy, range-sorted by training position (ties by key and copy)."""
    return (mixed.select(F.col(key), "size", F.posexplode("positions").alias("copy", "position"))
            .orderBy("position", key, "copy"))
