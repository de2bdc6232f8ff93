from pyspark.sql import functions as F

from relindex.functions import category as cat
from relindex.functions import tags as tg
from relindex.functions import text as tx


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "s string").select(col(F.col("s")).alias("r")).first()["r"]


def test_normalize_subject(spark):
    assert one(spark, tx.normalize_subject, " -[FRENCH] Example.part01.rar yEnc (01/15) repost sample- ") == "example"
    assert one(spark, tx.normalize_subject, "Example [123/456]") == "example"
    assert one(spark, tx.normalize_subject, "Release.part01.rar") == "release"


def test_clean_text(spark):
    assert one(spark, lambda c: tx.normalize_subject(tx.clean_text(c)), "Example\x00(1/1)") == "example"


def test_extract_tags(spark):
    assert one(spark, tx.extract_tags, "[Foo Bar] [Baz]") == ["foo", "bar", "baz"]
    assert one(spark, tx.extract_tags, "no brackets") == []


def test_segment_number(spark):
    cases = {"some file (1/10)": 1, "prefix (12/34) suffix": 12, "no segments": 1, "(abc/123)": 1, "(1/)": 1, "(1/2": 1}
    for s, n in cases.items():
        assert one(spark, tx.segment_number, s) == n


def test_detect_language(spark):
    assert one(spark, tx.detect_language, "[FRENCH] film") == "fr"
    assert one(spark, tx.detect_language, "this is a simple test release") == "en"
    assert one(spark, tx.detect_language, "") is None
    assert one(spark, tx.detect_language, "1234 !!!") is None


def test_music_and_book_tags(spark):
    assert one(spark, tg.subject_tags, "Artist-Album-2024-AAC") == ["artist", "album", "2024", "aac"]
    assert one(spark, tg.subject_tags, "Author-Title-2024-AZW3") == ["author", "title", "2024", "azw3"]
    assert one(spark, tg.subject_tags, "Studio.Name.2022.1080p") == ["studio name", "2022", "1080p"]


def test_infer_category(spark):
    df = spark.createDataFrame([("Test", "alt.binaries.psp"), ("Test", "alt.binaries.pc.games"),
                                ("Cartoons", "alt.binaries.animations"), ("Cartoons x264", "alt.binaries.animations"),
                                ("Show S01E02 720p", None), ("plain", None), ("x", "alt.binaries.sounds.mp3")],
                               "s string, g string")
    got = [r["c"] for r in df.select(cat.infer_category(F.col("s"), F.col("g")).alias("c")).collect()]
    # leftmost hint wins: "pc" starts before "games" in alt.binaries.pc.games,
    # so the hint rule yields pc (4000); "sounds" contains "nds" (console_nds)
    assert got == ["1020", "4000", "6000", "6040", "5040", None, "1010"]


def test_category_id_and_bucket(spark):
    df = spark.createDataFrame([("2040",), ("abc",), ("6010",)], "c string")
    r = df.select(cat.category_id(F.col("c")).alias("i")).select("i", cat.category_bucket(F.col("i")).alias("b")).collect()
    assert [(x["i"], x["b"]) for x in r] == [(2040, "movies"), (7000, "books"), (6010, "adult")]
    a = df.select(cat.is_adult_category(F.col("c")).alias("a")).collect()
    assert [x["a"] for x in a] == [False, False, True]
