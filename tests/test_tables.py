"""Range planning, inventories, seek paging, backfill modes and metrics against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from relindex.operators import backfill as BF
from relindex.operators import ingest
from relindex.operators import maintenance as M
from relindex.operators import metrics as MT
from relindex.operators import outputs as OUT
from relindex.operators import ranges as R
from relindex.sources import store
from tests.conftest import headers_df
from tests.test_textindex import SCHEMA


@pytest.mark.parametrize("block", [7, 100_000])
def test_missing_ranges_and_batches(spark, block, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(2)
    have = {"a": {n for n in range(1, 200) if rng.random() < 0.6}, "b": {50}, "c": set(), "d": set(range(1, 21))}
    rows = [(g, n) for g, s in have.items() for n in s for _ in range(rng.choice([1, 1, 3]))] + [(None, 5), ("a", None), ("z", 9), ("d", 900)]
    bounds = [("a", 1, 230), ("b", 1, 50), ("c", 5, 9), ("d", 1, 20), ("e", 3, 2)]
    got = R.missing_ranges(spark.createDataFrame(rows, "grp string, article_number long"), spark.createDataFrame(bounds, "grp string, low long, high long"))
    want = {(g, n) for g, lo, hi in bounds for n in range(lo, hi + 1) if n not in have.get(g, ())}
    ranges = [tuple(r) for r in got.collect()]
    assert sorted((g, n) for g, lo, hi in ranges for n in range(lo, hi + 1)) == sorted(want)
    assert len({(g, lo - 1) for g, lo, _ in ranges} & {(g, hi) for g, _, hi in ranges}) == 0  # ranges are maximal
    cut = [tuple(r) for r in R.batches(got, 2, 5).collect()]
    assert sorted((g, n) for g, lo, hi in cut for n in range(lo, hi + 1)) == sorted(want) and max(hi - lo for _, lo, hi in cut) == 4
    turns = R.dealt(R.batches(got, 2, 5)).collect()
    for g in "abc":
        mine = sorted((r["turn"], r["start"]) for r in turns if r["grp"] == g)
        assert [t for t, _ in mine] == list(range(1, len(mine) + 1)) and [s for _, s in mine] == sorted(s for _, s in mine)
    assert {r["grp"] for r in R.dealt(R.batches(got), 1).collect()} == {"a", "b", "c"}


def test_next_batches(spark):
    st = spark.createDataFrame([("a", 10, 5000), ("b", None, 30), ("c", 7, 7), ("d", 9, 3)], "grp string, last_article long, high long")
    assert sorted(tuple(r) for r in R.next_batches(st).collect()) == [("a", 11, 1010), ("b", 1, 30)]
    with pytest.raises(ValueError):
        R.next_batches(st, 0, 5)


def releases(spark, n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        day = None if i % 9 == 0 else f"{rng.choice([1999, 2000, 2001])}-{rng.randint(1, 12):02d}-01 00:00:00"
        rows.append((i, f"t{rng.randrange(60)}", "5000", 5000 + i, "en", None, "mkv", "g", i, day, True, 1, [], rng.choice(["tv", "movies"]), int(day[:4]) if day else None))
    return spark.createDataFrame(rows, SCHEMA.replace("posted_at timestamp", "posted_at string")).withColumn("posted_at", F.to_timestamp("posted_at"))


def test_seek_pages_read_what_they_need(spark, tmp_path):
    rel = releases(spark)
    want = [r["id"] for r in rel.orderBy(F.col("posted_at").desc_nulls_first(), "norm_title", "category_id").collect()]
    path = store.write_pages(rel, str(tmp_path / "p"), 50)
    got, after, files = [], None, []
    while True:
        page = store.seek_page(spark, path, 30, after)
        rows = page.collect()
        if not rows:
            break
        files.append(sum(spark.read.parquet(f"{path}/rows").where(F.col("part") == p).count() for p in parts_of(page)))
        got += [r["id"] for r in rows]
        after = rows[-1]["_key"]
    assert got == want and len(files) == 14
    assert max(files) <= 4 * 50 < len(want)  # the last pages read no more than the first ones
    empty = store.write_pages(rel.where("false"), str(tmp_path / "e"))
    assert store.seek_page(spark, empty, 10).count() == 0


def parts_of(page):
    import re
    text = page._jdf.queryExecution().optimizedPlan().toString()
    hit = re.search(r"part#\d+ IN \(([\d,]+)\)|part#\d+ = (\d+)", text)
    return [int(x) for x in (hit.group(1) or hit.group(2)).split(",")]


def test_prune_by_inventory_equals_prune(spark, tmp_path):
    path = store.write_releases(releases(spark), str(tmp_path / "r"), inventory=True)
    rel = store.read_releases(spark, path)
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    for days in (0, 100, 500, 900, 5000):
        kept, removed, report = M.prune_old_by_inventory(spark, path, days, "2002-01-01 00:00:00")
        want = M.prune_old(rel, days, "2002-01-01 00:00:00")
        assert (ids(kept), ids(removed)) == (ids(want[0]), ids(want[1])), days
        told = {(r["bucket"], r["posted_year"]): r for r in report.collect()}
        assert set(told) == {(r["bucket"], r["posted_year"]) for r in removed.select("bucket", "posted_year").distinct().collect()}
        if days == 500:
            assert {r["action"] for r in told.values()} == {"drop", "trim"}
    assert rel.count() == 400 and "/_inventory/" not in "".join(rel.inputFiles())
    inv = {(r["bucket"], r["posted_year"]): r["n"] for r in M.inventory_counts(spark, path).collect()}
    assert inv == {(r["bucket"], r["posted_year"]): r["n"] for r in M.partition_counts(rel).collect()}


def test_backfill_modes_and_getnzb(spark):
    date = "Mon, 06 Feb 1995 10:00:00 +0000"
    h = headers_df(spark, [("alt.binaries.tv", n, f"<m{n}@x>", f"[tv] Show.{'abcd'[n % 4]}.mkv ({n % 3 + 1}/3) yEnc", 1000 + n, date) for n in range(24)])
    pa = ingest.materialize(ingest.parse_headers(h), "t")
    p = ingest.gate(pa)
    segs = ingest.collect_segments(p)
    rel = ingest.materialize(ingest.build_releases(p, segments=segs, gated=False), "t")
    rows = {r["id"]: r for r in rel.collect()}
    a, b, *_ = sorted(rows)
    empty = segs.where("false")
    assert BF.targets(rel, segs).count() == 0  # all have segments
    assert BF.targets(rel, empty).count() == 4 and BF.targets(rel.withColumn("has_parts", F.col("id") == a), empty, auto=True).count() == 1
    one = spark.createDataFrame([(a,), (a,)], "id long")
    blank = rel.withColumns({"part_count": F.lit(0), "size_bytes": F.lit(None).cast("long"), "has_parts": F.lit(False)})
    out, found, gone = BF.backfill_job(blank, empty, pa, ids=one)
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == set(rows) and got[a]["has_parts"] and not got[b]["has_parts"] and gone.count() == 0
    assert {r["norm_title"] for r in found.collect()} == {rows[a]["norm_title"]}
    stale = blank.withColumn("norm_title", F.when(F.col("id") == b, F.lit("no such:1995-02-06")).otherwise(F.col("norm_title")))
    out, _, gone = BF.backfill_job(stale, empty, pa)
    assert {r["id"] for r in out.collect()} == set(rows) - {b} and [r["id"] for r in gone.collect()] == [b]
    nzb = "".join(r["nzb"] for r in BF.getnzb(blank, empty, pa, one).orderBy("part").collect())
    assert nzb.endswith("</segments></file></nzb>") and nzb.count("<segment ") == got[a]["part_count"]
    assert OUT.manifests(blank, empty).count() == 0


def test_counter_keys_and_rates(spark):
    k = lambda m: spark.range(1).select(MT.counter_key(F.lit("hits"), m)).first()[0]
    assert k(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"), F.lit("c"), F.lit(None).cast("string"))) == "hits{a=1,b=2}"
    assert k(F.lit(None).cast("map<string,string>")) == "hits" and k(F.create_map(F.lit("c"), F.lit(None).cast("string"))) == "hits"
    m = spark.createDataFrame([("g", 0, 100, 900, 500, 50), ("h", 0, 0, 900, 500, 0), ("i", 0, 10, 0, 7, 7)],
                              "grp string, batch long, processed long, remaining long, duration_ms long, database_ms long")
    r = {x["grp"]: x for x in MT.with_rates(m).collect()}
    assert (r["g"]["average_batch_ms"], r["g"]["average_database_latency_ms"], r["g"]["eta_seconds"]) == (5.0, 0.5, 4)
    assert (r["h"]["average_batch_ms"], r["h"]["eta_seconds"]) == (0.0, None) and r["i"]["eta_seconds"] is None
    assert MT.global_eta(m).first()["eta_seconds"] == int(1800 / (110 / 1.007))


def test_prune_that_takes_every_row_leaves_a_table(spark):
    path = store.write_releases(releases(spark))
    table = store.read_releases(spark, path)
    none = store.read_releases(spark, store.rewrite(table.where("false"), table, path))
    assert none.columns == store.RELEASE_SCHEMA.names and none.count() == 0
    assert M.partition_counts(none).collect() == []
