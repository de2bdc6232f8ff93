from pyspark.sql import functions as F

from relindex import config as C
from relindex.operators import ingest, upsert
from tests.conftest import headers_df

D = "Mon, 01 Jan 2024 00:00:00 +0000"


def build(spark, rows, policy=None):
    p = ingest.parsed_table(headers_df(spark, rows))
    return {(r["norm_title"], r["category_id"]): r for r in ingest.build_releases(p, policy).collect()}


NOFLOOR = C.SizePolicy(category_floor={})


def test_single_and_sum(spark):
    r = build(spark, [("alt.binaries.misc", 1, "<a>", "Example", 456, None)], NOFLOOR)
    assert r[("example", 7010)]["size_bytes"] == 456
    r = build(spark, [("alt.binaries.misc", 1, "<a>", "Example (1/2)", 100, None),
                      ("alt.binaries.misc", 2, "<b>", "Example (2/2)", 200, None)], NOFLOOR)
    row = r[("example", 7010)]
    assert (row["size_bytes"], row["part_count"], row["has_parts"]) == (300, 2, True)


def test_zero_size_dropped(spark):
    assert build(spark, [("alt.binaries.misc", 1, "<a>", "Example", 0, None)], NOFLOOR) == {}


def test_two_groups_two_categories(spark):
    r = build(spark, [("alt.binaries.movies", 1, "<a>", "Example.mkv", 100, None),
                      ("alt.binaries.music", 1, "<b>", "Example.mkv", 100, None)], NOFLOOR)
    assert sorted(k[1] for k in r) == [2000, 3000]


def test_exact_override_and_floor(spark):
    pol = C.SizePolicy(exact={"example": 1000}, category_floor={})
    assert build(spark, [("alt.binaries.misc", 1, "<1@a>", "Example", 500, None)], pol) == {}
    pol = C.SizePolicy(category_floor={2000: 1000})
    assert build(spark, [("alt.binaries.movies", 1, "<1@a>", "Example.mkv", 500, None)], pol) == {}


def test_parts_and_duplicates(spark):
    r = build(spark, [("alt.binaries.misc", 1, "<a>", "Release.part01.rar", 100, None),
                      ("alt.binaries.misc", 2, "<b>", "Release.part02.rar", 200, None)], NOFLOOR)
    assert r[("release", 7010)]["size_bytes"] == 300
    r = build(spark, [("alt.binaries.misc", 1, "<a>", "Example (1/2)", 100, None),
                      ("alt.binaries.misc", 2, "<a>", "Example (1/2)", 100, None),
                      ("alt.binaries.misc", 3, "<b>", "Example (2/2)", 200, None)], NOFLOOR)
    row = r[("example", 7010)]
    assert (row["size_bytes"], row["part_count"]) == (300, 2)


def test_dated_key_and_min_posted(spark):
    r = build(spark, [("alt.binaries.misc", 1, "<a>", "Foo (1/2)", 100, "Tue, 02 Jan 2024 10:00:00 +0000"),
                      ("alt.binaries.misc", 2, "<b>", "Foo (2/2)", 100, "Tue, 02 Jan 2024 08:00:00 GMT")], NOFLOOR)
    row = r[("foo:2024-01-02", 7010)]
    assert str(row["posted_at"]) == "2024-01-02 08:00:00"


def test_growth_over_batches(spark):
    b1 = ingest.parsed_table(headers_df(spark, [("alt.binaries.misc", 1, "<m1>", "Example (1/2)", 100, D)]))
    segs = ingest.collect_segments(b1)
    rel = ingest.with_storage_columns(ingest.build_releases(b1, segments=segs, gated=False))
    b2 = ingest.parsed_table(headers_df(spark, [
        ("alt.binaries.misc", 2, "<m2>", "Example (2/2)", 150, D),
        ("alt.binaries.misc", 3, "<m1>", "Example (1/2)", 100, D)]))
    out, new_segs, _, inserted = upsert.upsert(rel, segs, ingest.fold_releases(b1), b2)
    row = out.where(F.col("norm_title") == "example:2024-01-01").first()
    assert (row["size_bytes"], row["part_count"]) == (250, 2)
    assert new_segs.count() == 2
    assert inserted.count() == 0


def test_extension_gate(spark):
    p = ingest.parse_headers(headers_df(spark, [("alt.binaries.movies", 1, "<a>", "Film.bolt (1/1)", 100, None),
                                                 ("alt.binaries.movies", 2, "<b>", "Film.mkv (1/1)", 100, None)]))
    assert [r["ext_ok"] for r in p.orderBy("article_number").collect()] == [False, True]


def test_invariants_on_fixture(spark):
    from relindex.plans import common as K
    p = K.parsed(spark, "/root/testdata/sf0.001")
    segs = ingest.collect_segments(p)
    rel = ingest.build_releases(p, segments=segs)
    assert rel.groupBy("norm_title", "category_id").count().where("count > 1").count() == 0
    tot = segs.groupBy("norm_title").agg(F.sum("size").alias("t"))
    bad = rel.join(tot, "norm_title").where(F.col("t") != F.col("size_bytes"))
    assert bad.count() == 0
