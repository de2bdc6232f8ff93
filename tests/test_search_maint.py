import pytest
from pyspark.sql import functions as F

from relindex import config as C
from relindex.operators import backfill as BF
from relindex.operators import groups as G
from relindex.operators import ingest, maintenance as M, search as S
from relindex.operators import metrics as MT
from tests.conftest import headers_df

REL = ("id long, norm_title string, category string, category_id int, tags string, extension string, "
       "source_group string, size_bytes long, posted_at timestamp, has_parts boolean, search_tokens array<string>, "
       "bucket string, posted_year int")


def rel(spark, rows):
    return spark.createDataFrame(rows, REL)


def test_query_tokens_and_validation():
    assert S.query_tokens("c++ movies") == ["c", "movies"]
    assert S.query_tokens("foo | bar") == ["foo", "bar"]
    with pytest.raises(ValueError):
        S.SearchQuery(limit=101).validated()
    with pytest.raises(ValueError):
        S.SearchQuery(offset=-1).validated()
    with pytest.raises(ValueError):
        S.SearchQuery(offset=20_000).validated()


def test_search_order_and_match(spark):
    import datetime as dt
    r = rel(spark, [
        (1, "a b", "2000", 2000, "", None, "g", 10, dt.datetime(2024, 1, 1), True, ["a", "b"], "movies", 2024),
        (2, "a c", "2000", 2000, "", None, "g", 20, None, True, ["a", "c"], "movies", None),
        (3, "a d", "5000", 5000, "x", None, "g", 0, dt.datetime(2024, 1, 2), True, ["a", "d"], "tv", 2024),
    ])
    got = [x["id"] for x in S.search(r, S.SearchQuery(q="a", sort="unknown")).collect()]
    assert got == [2, 1]  # NULL date first (PostgreSQL DESC), id 3 not searchable
    assert [x["id"] for x in S.search(r, S.SearchQuery(q="b c")).collect()] == []
    assert [x["id"] for x in S.search(r, S.SearchQuery(q="!!")).collect()] == []
    assert [x["id"] for x in S.search(r, S.SearchQuery(cat="5000,2000", sort="size")).collect()] == [2, 1]


def test_expand_categories(spark):
    assert S.expand_categories(spark, ["2000"])[:3] == ["2000", "2010", "2020"]
    assert S.expand_categories(spark, ["7020", "9999"]) == ["7020", "9999"]


def test_prune_sizes_and_types(spark):
    r = rel(spark, [(i, f"t{i}", str(c), c, "", e, "g", s, None, True, [], "x", None)
                    for i, (c, s, e) in enumerate([(5000, 90, "rar"), (5000, 110, "foo"), (3000, 40, "rar"), (3000, 60, None)])])
    pol = C.SizePolicy(category_floor={5000: 100, 3000: 50})
    kept, removed = M.prune_sizes(r, pol)
    assert removed.count() == 2
    kept, removed = M.prune_filetypes(r)
    assert [x["extension"] for x in removed.collect()] == ["foo"]
    kept, removed = M.prune_filetypes(r, C.prune_extensions("foo"))
    assert removed.count() == 0


def test_prune_groups(spark):
    r = rel(spark, [(i, f"t{i}", "7000", 7000, "", None, g, 1, None, True, [], "books", None)
                    for i, g in enumerate(["keep.one", "drop.me", None, "", "keep.two"])])
    kept, _ = M.prune_non_curated(r, ["keep.one", "keep.two"])
    assert sorted(x["source_group"] for x in kept.collect()) == ["keep.one", "keep.two"]


def test_retention_partitions(spark):
    import datetime as dt
    r = rel(spark, [
        (1, "a", "2000", 2000, "", None, "g", 1, dt.datetime(2023, 5, 1), True, [], "movies", 2023),
        (2, "b", "2000", 2000, "", None, "g", 1, dt.datetime(2024, 1, 5), True, [], "movies", 2024),
        (3, "c", "2000", 2000, "", None, "g", 1, dt.datetime(2024, 3, 5), True, [], "movies", 2024),
    ])
    kept, removed, report = M.prune_partitions(r, "2024-02-01")
    rep = {(x["posted_year"], x["action"]): x["rows_deleted"] for x in report.collect()}
    assert rep == {(2023, "drop"): 1, (2024, "trim"): 1}
    assert [x["id"] for x in kept.collect()] == [3]


def test_backfill(spark):
    h = headers_df(spark, [("alt.binaries.x", 1, "<m1>", "My Release (1/2)", 10, None),
                           ("alt.binaries.x", 2, "<m2>", "My Release (2/2)", 15, None)])
    p = ingest.parse_headers(h)
    t = spark.createDataFrame([(7, "my release", "alt.binaries.x"), (8, "other", "alt.binaries.x")],
                              "id long, norm_title string, source_group string")
    filled, segs, unresolved = BF.backfill(t, p)
    f = filled.first()
    assert (f["id"], f["part_count"], f["size_bytes"]) == (7, 2, 25)
    assert [x["id"] for x in unresolved.collect()] == [8]


def test_rate_windows(spark):
    import datetime as dt
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, s), k) for s, k in [(0, 1), (5, 1), (15, 2)]],
                               "ts timestamp, user_id long")
    w = MT.rate_window_counts(ev, "10 seconds", 1)
    got = sorted((x["user_id"], x["n"], x["over_limit"]) for x in w.collect())
    assert got == [(1, 2, True), (2, 1, False)]


def test_group_list_clean(spark):
    t = spark.createDataFrame([(0, "a.b, c_d\nbad name,a.b")], "src_pos int, text string")
    valid, rej = G.clean_group_list(t)
    assert sorted(x["name"] for x in valid.collect()) == ["a.b", "c_d"]
    assert [x["name"] for x in rej.collect()] == ["bad name"]


def test_language_profiles(spark):
    from relindex.operators import language as LG
    docs = spark.createDataFrame([
        (1, "the quick brown fox jumps over the lazy dog and the cat", "en"),
        (2, "der schnelle braune fuchs springt ueber den faulen hund und die katze", "de"),
        (3, "the dog and the fox are in the house with the cat", None),
        (4, "die katze und der hund sind in dem haus mit dem fuchs", None),
    ], "doc_id long, text string, lang string")
    g = LG.trigrams(docs)
    pred = {r["doc_id"]: r["predicted"] for r in LG.classify(g, LG.train_profiles(docs, g)).collect()}
    assert pred[3] == "en" and pred[4] == "de"
