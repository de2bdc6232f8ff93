"""Token and gram indexes against the scanning predicates."""

import re

import pytest
from pyspark.sql import functions as F

from relindex.operators import search as S
from relindex.operators import textindex as TI
from relindex.sources import store

SCHEMA = ("id long, norm_title string, category string, category_id int, language string, tags string, extension string, source_group string, "
          "size_bytes long, posted_at timestamp, has_parts boolean, part_count int, search_tokens array<string>, bucket string, posted_year int")
TITLES = ["big widget show", "Small Widget 100%", "widget_small file", "Ünïcode Straße ÀB", "ab", "", None, "the the the", "x widgets", "gear box gear", "日本語 テスト title"]


def table(spark, titles, first=0, year=2020):
    rows = []
    for i, t in enumerate(titles, first):
        rows.append((i, t, "5000", 5000, "en", ["sd,tv", "tv", "hd", "", None][i % 5], "mkv", "g", 100 + i, None, True, 1,
                     sorted(set(S.query_tokens(t))), "tv" if i % 2 else "movies", year + i % 3 if i % 4 else None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def indexed(spark, tmp_path):
    rel = store.read_releases(spark, store.write_releases(table(spark, TITLES), str(tmp_path / "rel")))
    return rel, *(TI.TextIndex(spark, str(tmp_path / "ix"), k).build(rel) for k in ("tokens", "grams"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_equal_to_scans(spark, indexed):
    rel, tok, gram = indexed
    for q in ("widget", "Widget, small!", "the", "nothing", "straße", "title テスト", "100"):
        assert ids(TI.text_match(rel, tok, q)) == ids(S.text_match(rel, q)), q
    assert ids(TI.text_match(rel, tok, "!!")) == []
    for q in ("widget", "WIDGET", "w%t", "wid%show", "t_s", "a", "ab", "ÀB", "àb", "straße", "100\\%", "gear box", "日本語", "%", "_", "dget sm", "e the t"):
        assert ids(TI.title_contains(rel, gram, q)) == ids(S.title_contains(rel, q)), q
    for tag in ("s", "sd", "sd,", "sd,tv", "tvx", "SD,", ""):
        assert ids(TI.tag_prefix(rel, gram, tag)) == ids(S.tag_prefix(rel, tag)), tag
    for sq in (S.SearchQuery(q="widget", sort="size"), S.SearchQuery(q="widget", has_vector=False, cat="5000", sort="title", limit=2, offset=1),
               S.SearchQuery(tag="sd,", sort="size"), S.SearchQuery(sort="size")):
        assert [r["id"] for r in TI.search(rel, sq, tok, gram).collect()] == [r["id"] for r in S.search(rel, sq).collect()]


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_reads_no_token_arrays_and_one_partition_of_terms(spark, indexed):
    rel, tok, gram = indexed
    p = plan(TI.text_match(rel.drop("search_tokens"), tok, "widget"))
    assert "search_tokens" not in p
    assert re.search(r"PartitionFilters: \[[^\]]*\(_p#\d+ = \d+\)", p)  # the hash of the term is a constant
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,widget\)", p)
    n = gram.candidates(TI.query_grams(spark, "widget")).count()
    assert n == 4  # the gram index leaves the rows that have all grams


def test_update_writes_what_changed(spark, indexed, tmp_path):
    rel, tok, gram = indexed
    old = rel.where("id IN (0, 1)")
    new = table(spark, ["big widget film", "gone"], 0, 2024).where("id = 0").unionByName(table(spark, ["fresh widget"], 50))
    now = rel.where("id NOT IN (0, 1)").unionByName(new, allowMissingColumns=True)
    n_tok = tok.update(old, new)
    gram.update(old, new)
    # release 0 moved to another year or not: show -> film, or all three words; 1: three words gone; 50: two new
    assert n_tok < 12
    for q in ("widget", "show", "film", "small", "fresh widget", "100"):
        assert ids(TI.text_match(now, tok, q)) == ids(S.text_match(now, q)), q
        assert tok.frequencies(S.query_tokens(q)) == {t: now.where(F.array_contains("search_tokens", t)).count() for t in S.query_tokens(q)}
    for q in ("widget", "idget f", "small", "fresh"):
        assert ids(TI.title_contains(now, gram, q)) == ids(S.title_contains(now, q)), q
    files = spark.read.parquet(f"{tok.root}/postings/gen=0/seg=1")
    assert files.count() == n_tok and {r["term"] for r in files.select("term").collect()} <= {"big", "widget", "show", "film", "small", "100", "fresh"}
    tok.compact()
    assert tok.current() == (1, 0)
    assert ids(TI.text_match(now, tok, "widget")) == ids(S.text_match(now, "widget"))
    assert tok.frequencies(["widget"])["widget"] == now.where(F.array_contains("search_tokens", "widget")).count()
    assert tok.update(now, now) == 0
    assert ids(TI.text_match(now, tok, "widget")) == ids(S.text_match(now, "widget"))


def test_empty_table(spark, tmp_path):
    rel = table(spark, TITLES).where("false")
    tok = TI.TextIndex(spark, str(tmp_path / "ix"), "tokens").build(rel)
    assert ids(TI.text_match(rel, tok, "widget")) == [] and tok.frequencies(["a"]) == {"a": 0}
