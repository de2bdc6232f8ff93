"""Order MinHash fingerprints of documents, in Spark's own functions only.

The symbols of a text are its words; a word of more than ``LONG`` code points
(a text without blanks, base64) counts as its runs of ``GRAM`` code points, one
at each place. K-mers of symbols are numbered by occurrence, so a k-mer that
comes twice is two elements. Every element has a pseudo-random priority, whose
first bits deal it into one of ``2^bits`` bins; a bin selects the ``picked``
elements of least priority from its own start on, puts them back into text
order and hashes the tuple. A bin that holds fewer borrows from the following
bins (the last one is followed by the first), so short texts have full tuples
in all bins as well. Two texts agree in a bin when both the chosen k-mers and
their order agree, which makes the likeness sensitive to edits and moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer, elements of a tuple, and bits of the number of bins.
K, PICKED, BITS = 3, 2, 6
#: A word of more code points than ``LONG`` is taken apart into runs of ``GRAM`` code points.
LONG, GRAM = 40, 4
#: Bits of a place in the text inside a packed number; the others hold a hash.
_PLACE = 28
_MASK = (1 << _PLACE) - 1
#: Rows of a bucket of neighbouring keys, about, and buckets at most.
BUCKET_ROWS, BUCKETS, RANGES = 512, 100_000, 64


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(~_MASK).bitwiseOR(place)


def _kmers(words: Column, k: int) -> Column:
    """Hash of every run of ``k`` word hashes; a shorter text is one k-mer, an empty one has none."""
    every = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    n = F.size(words)
    return F.slice(every, F.lit(1), F.greatest(n - (k - 1), F.least(n, F.lit(1))))


def _elements(kmers: Column) -> Column:
    """Priority and place of each occurrence-numbered k-mer, ascending."""
    def element(x, number):
        return _packed(F.xxhash64(F.shiftright(x, _PLACE), number), x.bitwiseAND(_MASK))

    def numbered(s):
        first = F.filter(F.transform(s, lambda x, i: F.when(
            (i == 0) | (F.shiftright(x, _PLACE) != F.shiftright(F.get(s, i - 1), _PLACE)), i).otherwise(-1)), lambda i: i >= 0)
        return let(first, lambda f: F.when(F.size(f) == F.size(s), F.transform(s, lambda x: element(x, F.lit(0)))).otherwise(
            F.flatten(F.transform(f, lambda a, j: F.transform(
                F.slice(s, a + 1, F.coalesce(F.get(f, j + 1), F.size(s)) - a), lambda x, o: element(x, o))))))

    return let(F.sort_array(F.transform(kmers, lambda h, i: _packed(h, i.cast("long")))), lambda s: F.sort_array(numbered(s)))


def _symbols(text: Column) -> Column:
    """Hashes of the words of a text; a long word gives the hash of a run of code points for each of its places."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def grams(w):
        return let(F.split(w, ""), lambda c: F.transform(c, lambda x, i: F.xxhash64(x, *[F.get(c, i + j) for j in range(1, GRAM)])))

    return let(words, lambda every: F.when(~F.exists(every, lambda w: F.length(w) > LONG), F.transform(every, lambda w: F.xxhash64(w))).otherwise(
        F.flatten(F.transform(every, lambda w: F.when(F.length(w) > LONG, grams(w)).otherwise(F.array(F.xxhash64(w)))))))


def signature(text: Column, *, k: int = K, picked: int = PICKED, bits: int = BITS) -> Column:
    """Sorted array of one number for each bin: the bin in the first ``bits`` bits, then the tuple's hash. Empty without words."""
    def bin_of(x):
        return F.shiftright(x, 64 - bits)

    def tuple_at(kmers, around, size, i):
        return F.shiftrightunsigned(F.xxhash64(F.transform(F.array_sort(F.transform(
            F.slice(around, i + 1, F.least(size, F.lit(picked))), lambda x: x.bitwiseAND(_MASK))), lambda p: F.get(kmers, p.cast("int")))), bits)

    def tuples(kmers, chosen):
        """The first element of each bin that has one serves its bin and the empty ones before it."""
        heads = F.filter(F.transform(chosen, lambda x, i: F.when((i == 0) | (bin_of(F.get(chosen, i - 1)) != bin_of(x)), i).otherwise(-1)), lambda i: i >= 0)
        last = bin_of(F.element_at(chosen, -1)) - (1 << bits)
        return let(F.concat(chosen, F.slice(chosen, 1, picked - 1)), lambda around: F.flatten(F.transform(heads, lambda i: let(
            tuple_at(kmers, around, F.size(chosen), i), lambda hashed: F.transform(
                F.sequence(F.when(i == 0, last).otherwise(bin_of(F.get(chosen, i - 1))) + 1, bin_of(F.get(chosen, i))),
                lambda b: F.shiftleft(b, 64 - bits).bitwiseOR(hashed))))))

    return F.sort_array(let(_symbols(text), lambda w: let(_kmers(w, k), lambda km: let(_elements(km), lambda t: let(
        F.filter(t, lambda x, i: (i < picked) | (bin_of(F.get(t, i - picked)) != bin_of(x))),
        lambda chosen: F.when(F.size(chosen) == 0, F.array().cast("array<bigint>")).otherwise(tuples(km, chosen)))))))


def likeness(a: Column, b: Column, *, bits: int = BITS) -> Column:
    """Share of the bins in which two signatures agree; 1 for two texts without words, 0 if one alone has none."""
    def bins(s):
        return F.transform(s, lambda x: F.shiftrightunsigned(x, 64 - bits))
    every = F.size(F.array_union(bins(a), bins(b)))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def printed(s: Column) -> Column:
    """A signature as text: eight hex digits for each bin (its number and 26 bits of the tuple's hash)."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0"))), "")


def _bucketed(docs: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Adds ``bucket``, ascending with the key (null first), and the first key of each bucket.

    Buckets are equal parts of the ranges between key quantiles, so neither gaps nor clusters of keys
    make a large bucket; there are at most about ``BUCKETS`` of them.
    """
    key = F.col("key")
    n, lo, hi, cuts = docs.agg(F.count("key"), F.min("key"), F.max("key"),
                               F.percentile_approx("key", [i / RANGES for i in range(1, RANGES)], 1000)).first()
    if not n:
        return docs.withColumn("bucket", F.lit(-1).cast("long")), docs.select("key", F.lit(-1).cast("long").alias("bucket")).limit(1)
    edges = sorted({int(lo), *map(int, cuts)}) + [int(hi) + 1]
    parts = max(1, min(BUCKETS, -(-n // bucket_rows)) // (len(edges) - 1))
    marks = F.array(*[F.lit(e).cast("decimal(20,0)") for e in edges])
    at = F.size(F.filter(F.array(*[F.lit(e).cast("decimal(20,0)") for e in edges[:-1]]), lambda e: e <= key))
    low, high = F.element_at(marks, F.greatest(at, F.lit(1))), F.element_at(marks, F.greatest(at, F.lit(1)) + 1)
    part = F.floor((key - low).cast("double") * parts / (high - low).cast("double")).cast("long")
    bucket = F.when(key.isNull(), -1).otherwise((at - 1) * parts + F.least(part, F.lit(parts - 1)))
    out = docs.withColumn("bucket", bucket.cast("long"))
    return out, out.groupBy("bucket").agg(F.min("key").alias("key"))


def compare_with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, picked: int = PICKED,
                      bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text (its second half replaced by the beginning of
    the next text by key; after the last comes the first), and their likeness.

    Returns ``key``, ``n_chars``, ``edited``, ``signature``, ``edited_signature``, ``near_edited``,
    ``near_next``. Null texts count as empty; keys are integers, null comes first, equal keys stand in
    the order of their texts; of one row the next is itself; an empty table gives an empty result.
    Texts of any length are read whole, with or without blanks. Other columns are not looked at.

    Plan: one shuffle of the texts, by bucket of neighbouring keys. The first row of each bucket also
    goes to the bucket before, so every row finds the next one in its own bucket. The table of first
    keys has ``BUCKETS`` + ``RANGES`` rows at most and is broadcast.
    """
    d, heads = _bucketed(docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), bucket_rows)
    order, every = Window.orderBy("bucket"), Window.partitionBy()
    heads = heads.select(F.col("key").alias("head"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(every)).alias("before"))
    both = (d.join(F.broadcast(heads), F.col("key").eqNullSafe(F.col("head")), "left")
            .select("key", "text", F.explode(F.filter(F.array(
                F.struct("bucket", F.lit(0).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy"))),
                lambda x: x["bucket"].isNotNull())).alias("to"))
            .select("key", "text", "to.bucket", "to.copy").repartition("bucket"))
    nearby = Window.partitionBy("bucket").orderBy("copy", "key", "text")
    s = both.withColumn("signature", signature(F.col("text"), k=k, picked=picked, bits=bits))
    s = (s.withColumn("next", F.lead("text").over(nearby)).withColumn("next_signature", F.lead("signature").over(nearby))
         .where("copy = 0"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    s = s.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    s = s.withColumn("edited_signature", signature(F.col("edited"), k=k, picked=picked, bits=bits))
    return s.select(F.col("key").alias(key), "n_chars", "edited", "signature", "edited_signature",
                    likeness(F.col("signature"), F.col("edited_signature"), bits=bits).alias("near_edited"),
                    likeness(F.col("signature"), F.col("next_signature"), bits=bits).alias("near_next"))
