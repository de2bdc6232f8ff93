"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Functions of this subpackage go to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: Rows of an Arrow batch sent to Python. Texts may be long, so batches are short.
ARROW_ROWS = 256

#: Characters between words for the operators that split at blanks (fixed by the contracts).
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound the memory of one Arrow batch (``ARROW_ROWS`` texts at most)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage in a way that survives lost executors, and lets several
    consumers read the same rows without computing them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sha_of_list(col, sep: str = ","):
    return F.sha2(F.array_join(col, sep), 256)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes: ``bytes.split()`` parts at exactly these characters."""
    return text.encode("utf-8").split() if text else []


def texts(batches: Iterator[pa.RecordBatch], column: str = "text"):
    """(batch, list of texts) for each Arrow batch."""
    for b in batches:
        if b.num_rows:
            yield b, b.column(b.schema.get_field_index(column)).to_pylist()


def words_expr(col) -> F.Column:
    """Array of words of a text column; null and blank texts give an empty array."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(BLANK_WORD), F.lit(0))


def lower_ascii(col) -> F.Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text) with ``doc`` = the key where keys are unique and not null (one small aggregate
    tells), else a struct of the key and a hash of the text, so that no two different rows share it.

    Equal rows are one document in joins; ``doc`` sorts like the key. See ``key_of``.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    odd = d.groupBy("key").count().where("count > 1 OR key IS NULL").limit(1).count()
    if not odd:
        return d.select(F.col("key").alias("doc"), "text")
    return d.select(F.struct("key", F.xxhash64("text").alias("th")).alias("doc"), "text").dropDuplicates(["doc"])


def key_of(df: DataFrame, column: str = "doc") -> F.Column:
    return F.col(f"{column}.key") if df.schema[column].dataType.typeName() == "struct" else F.col(column)


#: Bits of a broadcast hash filter at most (2^28 bits are 32 MB).
FILTER_BITS = 28


def hash_filter(hashes: DataFrame, column: str = "h", max_bits: int = FILTER_BITS) -> tuple[int, bytes]:
    """A bitmap (bits as a power of two, bytes) in which every hash of ``column`` is set.

    Its size follows the number of hashes, 16 bits for each, and never passes ``max_bits``: beyond,
    it lets more through, which costs work but no result. Filters only choose what is looked at.
    """
    n = hashes.count()
    bits = min(max_bits, max(15, (16 * n).bit_length()))
    place = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = (hashes.select(F.shiftright(place, 15).alias("bucket"), (place.bitwiseAND(0x7FFF) + 1).alias("bit"))
            .repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())
    out = bytearray(1 << (bits - 3))
    for r in rows:
        out[r["bucket"] << 12:(r["bucket"] + 1) << 12] = r["bits"]
    return bits, bytes(out)


def passes(bitmap: tuple[int, bytes], hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the filter."""
    bits, raw = bitmap
    at = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (np.frombuffer(raw, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
