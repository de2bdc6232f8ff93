"""Steps that must grow with their input, and the quick paths of the parse against the general ones."""

import time
from collections import Counter

from pyspark.sql import functions as F

from relindex.functions import category as cat
from relindex.functions import dates as d
from relindex.functions import text as tx
from relindex.operators import language as LG
from tests.conftest import headers_df


def test_trigrams_of_a_long_text_take_one_pass(spark):
    words = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}\U00010428é" for i in range(70_000))
    docs = spark.createDataFrame([(1, words), (2, "a"), (3, None), (4, "..")], "doc_id long, text string")
    start = time.time()
    got = {(r["doc_id"], r["gram"]): r["n"] for r in LG.trigrams(docs).collect()}
    assert time.time() - start < 20
    s = f" {words} "
    want = {(1, g): n for g, n in Counter(s[i:i + 3] for i in range(len(s) - 2)).items()}
    assert got == want | {(2, " a "): 1}


def test_title_of_ascii_and_other_subjects(spark):
    rows = [("a.part01.rar (1/2) yEnc",), ("é.part01.rar (1/2) yEnc",), ("a\x85repoſt b",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(tx.normalize_subject(F.col("s"))).collect()]
    assert got == ["a", "é", "a b", None, ""]


def test_hint_tokens_keep_their_order(spark):
    rows = [("alt.xbox360",), ("alt.xbox",), ("a.audiobooks",), ("a.ebooks",), ("a.none",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "g string").select(cat.group_hint(F.col("g"))).collect()]
    assert got == ["console_xbox360", "console_xbox", "audio", "ebook", None, None]


def test_usual_and_other_dates(spark):
    rows = [("Mon, 01 Jan 2024 10:00:00 +0100",), ("1 Jan 24 10:00 GMT",), ("1 Jan 2024 10:00:00 +0000\n",), ("31 Feb 2024 10:00:00 +0000",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(F.date_format(d.parse_posted(F.col("s")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-01-01 09:00", "2024-01-01 10:00", None, None]


def test_stream_batch_is_dealt_for_the_parse(spark, tmp_path):
    from relindex.streaming import ingest as ST
    rows = [("alt.binaries.misc", i, f"<{i}@x>", f"Title{i % 7}.rar ({i}/9)", 10**9, "1 Jan 2024 10:00:00 +0000") for i in range(400)]
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    ST.stage_header_files(headers_df(spark, rows), src, 1)
    made, materialize = {}, ST.ingest.materialize

    def noted(df, name):
        if name == "stream_parsed":
            made[name] = df.select(F.spark_partition_id().alias("p")).distinct().count()
        return materialize(df, name)
    ST.ingest.materialize = noted
    try:
        ST.incremental_ingest(spark, src, root, buckets=2).awaitTermination()
    finally:
        ST.ingest.materialize = materialize
    assert made["stream_parsed"] > 1
    assert ST.release_store(spark, root).read("releases").count() == 7


def test_titles_by_steps_equal_the_chain(spark):
    parts = ["[", "]", "(1/2)", "( 3 / 4 )", "part", "part 1", "rar", "Par2", "yEnc", "ye[x]nc", "[FRENCH]", "[[a]ITA]", "repost", "part repost 12",
             "re(1/2)post", ".", "_", " ", "\t", "-", "é", "İ", "\x85", "a", "7"]
    rows = [("".join(parts[(i * 7 + k * (1 + i % 11) + i // 25) % len(parts)] for k in range(i % 9)),) for i in range(2000)]
    df = spark.createDataFrame(rows, "s string").withColumn("low", F.lower("s"))
    want = tx.clean_text(tx.normalize_subject(F.col("s")))
    assert tx.with_title(df, "s", "low", "t").where(~F.col("t").eqNullSafe(want)).count() == 0
    seen = {r["s"]: r["t"] for r in tx.with_title(df.union(spark.createDataFrame([("part repost 12.x [[a]ITA]", "part repost 12.x [[a]ita]")], "s string, low string")),
                                                  "s", "low", "t").collect()}
    assert seen["part repost 12.x [[a]ITA]"] == "x"


def test_parse_has_tasks_enough_for_every_core(spark):
    from relindex.plans import common as K
    h = K.headers(spark, "/root/testdata/sf0.001")
    assert h.select(F.spark_partition_id().alias("p")).distinct().count() >= 3 * spark.sparkContext.defaultParallelism


def test_parse_keeps_its_tasks_when_no_table_is_broadcast(spark):
    from relindex.plans import common as K
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        h = K.headers(spark, "/root/testdata/sf0.001")
        assert h.select(F.spark_partition_id().alias("p")).distinct().count() >= 3 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
