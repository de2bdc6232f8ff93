"""Segment validation and repair, dates, sizes, policies, write-back and batch independence."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from relindex import config as C
from relindex.functions import category as cat
from relindex.functions.dates import parse_posted
from relindex.operators import groups, ingest, maintenance, metrics, outputs, upsert
from relindex.plans import common as K
from relindex.sources import policies, store
from tests.conftest import headers_df

GOOD = {"number": 1, "message_id": "a", "group": "g", "size": 5}


@pytest.mark.parametrize(("entries", "fine", "repaired"), [
    ([GOOD], True, None),
    ([{**GOOD, "message_id": "<a>"}], False, [(1, "a", "g", 5)]),
    ([{**GOOD, "number": "1"}], False, [(1, "a", "g", 5)]),
    ([{**GOOD, "size": "x"}], False, None),
    ([[1, "<a>", "g"]], False, None),
    ([[1, "<a>", "g", 5]], False, [(1, "a", "g", 5)]),
    ([{k: v for k, v in GOOD.items() if k != "size"}], False, [(1, "a", "g", 0)]),
    ([{**GOOD, "size": None}], False, [(1, "a", "g", 0)]),
    ([{**GOOD, "more": 1}], False, [(1, "a", "g", 5)]),
    ([GOOD, [2, "b", "g", None]], False, None),
    ([GOOD, 7], False, None),
])
@pytest.mark.parametrize("blank", ["", " "])
def test_segment_entries(spark, entries, fine, repaired, blank):
    legacy = spark.createDataFrame([("t", "[" + blank + json.dumps(entries)[1:])], "norm_title string, segments string")
    assert outputs.decode_segments(legacy).agg(F.bool_and("valid")).first()[0] is fine
    got = [tuple(r)[2:] for r in outputs.repair_segments(legacy).orderBy("pos").collect()]
    assert got == (repaired or [])


def test_unparsable_segments_are_left_alone(spark):
    legacy = spark.createDataFrame([("a", "{"), ("b", None), ("c", "{}"), ("d", "[]")], "norm_title string, segments string")
    assert outputs.decode_segments(legacy).count() == 0 and outputs.repair_segments(legacy).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("Tue, 02 Jan 2024 10:00:00 +0000", "2024-01-02 10:00:00"), ("02 Jan 2024 10:00:00 EST", "2024-01-02 15:00:00"),
    ("Tue, 2 Jan 24 10:00 pdt", "2024-01-02 17:00:00"), ("1 Jan 99 00:00:00 GMT", "1999-01-01 00:00:00"),
    ("Tue, 02 Jan 2024 10:00:00 -0800 (PST)", "2024-01-02 18:00:00"), ("2024-01-02T10:00:00+00:00", None), ("junk", None), (None, None)])
def test_posted_dates(spark, text, want):
    d = spark.createDataFrame([(text,)], "d string").select(F.date_format(parse_posted(F.col("d")), "yyyy-MM-dd HH:mm:ss"))
    assert d.first()[0] == want


def test_iso_dates_only_where_asked(spark):
    d = spark.createDataFrame([("2024-01-02T10:00:00+00:00",)], "d string").select(parse_posted(F.col("d"), iso=True))
    assert d.first()[0] == dt.datetime(2024, 1, 2, 10)


def test_size_lookup_does_not_multiply(spark):
    h = headers_df(spark, [("g", 1, "<a>", "s", 0, None), ("g", 2, "<b>", "s", 7, None), ("g", 3, None, "s", 0, None)])
    sizes = spark.createDataFrame([("<a>", 5), ("<a>", 9), ("<b>", 50), ("<c>", 1), ("<a>", 0)], "message_id string, size long")
    assert sorted((r["article_number"], r["size"]) for r in ingest.header_size(h, sizes).collect()) == [(1, 9), (2, 7), (3, 0)]


def test_min_size_of_dated_and_bare_title(spark):
    pol = C.SizePolicy(exact={"foo": 10, "bar:2024-01-01": 20}, category_floor={})
    d = spark.createDataFrame([("foo",), ("foo:2024-05-05",), ("bar:2024-01-01",), ("bar",)], "t string")
    assert [r[0] for r in d.select(cat.min_size(F.col("t"), F.lit(2000), pol)).collect()] == [10, 10, 20, 0]


def test_policy_tables_have_rejects(spark, tmp_path):
    t = spark.createDataFrame([("exact", "a", "5"), ("pattern", "^x", "6"), ("floor", "2000", "7"), ("max", None, "99"), ("floor", "z", "1"),
                               ("exact", "b", "many"), ("odd", "c", "1")], "kind string, key string, size string")
    pol, rejects = policies.size_policy(t)
    assert (pol.exact, pol.patterns, pol.category_floor[2000], pol.max_size) == ({"a": 5}, [("^x", 6)], 7, 99)
    assert sorted(r["key"] for r in rejects.collect()) == ["b", "c", "z"]
    (tmp_path / "hints.json").write_text(json.dumps([{"token": "zz", "key": "tv", "pos": 1}, {"token": "", "key": "tv"}, {"token": "q", "key": "nope"}]))
    good, bad = policies.read_hints(spark, str(tmp_path / "hints.json"))
    hints = policies.hints_from(spark, good)
    assert hints.pairs[-1] == ("zz", "tv") and bad.count() == 2
    d = spark.createDataFrame([("x", "alt.zz")], "s string, g string")
    assert d.select(cat.infer_category(F.col("s"), F.col("g"), hints)).first()[0] == C.CATEGORY_KEYS["tv"]
    (tmp_path / "cats.json").write_text(json.dumps([{"id": 2000, "name": "Movies"}, {"id": 5}]))
    good, bad = policies.read_categories(spark, str(tmp_path / "cats.json"))
    assert [tuple(r) for r in good.collect()] == [("2000", "Movies")] and bad.count() == 1


@pytest.mark.parametrize("batches", [1, 4, 16])
def test_table_does_not_depend_on_batches(spark, batches):
    p = K.parsed(spark, "/root/testdata/sf0.001").cache()
    cols = ["norm_title", "category_id", "category", "language", "size_bytes", "part_count", "posted_at"]
    want = sorted(map(tuple, ingest.build_releases(p).select(*cols).collect()), key=str)
    state = None
    for k in range(batches):
        b = p.where(F.pmod(F.xxhash64("message_id"), F.lit(batches)) == k)
        if state is None:
            segs, cand = ingest.collect_segments(b), ingest.fold_releases(b)
            rel = ingest.with_storage_columns(ingest.releases_from(cand, ingest.segment_totals(segs)))
        else:
            rel, segs, cand, _ = upsert.upsert(*state, b)
        state = tuple(ingest.materialize(x, "test_state") for x in (rel, segs, cand))
    assert sorted(map(tuple, ingest.size_gate(state[0]).select(*cols).collect()), key=str) == want


def test_write_back_drops_emptied_partitions(spark):
    rel = ingest.with_storage_columns(ingest.build_releases(K.parsed(spark, "/root/testdata/sf0.001")))
    path = store.write_releases(rel)
    whole = store.read_releases(spark, path)
    gone = (F.col("bucket") == "movies") & (F.col("posted_year") == 1996) | (F.col("source_group") == "alt.binaries.tv")
    kept, removed = whole.where(~F.coalesce(gone, F.lit(False))), whole.where(F.coalesce(gone, F.lit(False)))
    new = store.read_releases(spark, store.rewrite(kept, removed, path))
    assert removed.count() > 0
    assert sorted(r[0] for r in new.select("id").collect()) == sorted(r[0] for r in kept.select("id").collect())
    assert new.where("bucket = 'movies' AND posted_year = 1996").count() == 0


def test_poll_delay(spark):
    d = spark.createDataFrame([(10, 90), (0, 5), (7, 0)], "processed long, remaining long")
    assert [round(r["poll_seconds"], 6) for r in metrics.adaptive_poll_seconds(d).collect()] == [10.5, 5.0, 60.0]


def test_audit_counts_rows_without_inference(spark):
    r = spark.createDataFrame([("zzz", "", None, 7000), ("foo [tv]", "tv", None, 2000)], "norm_title string, tags string, source_group string, category_id int")
    got = {x["norm_title"]: (x["expected"], x["mismatch"]) for x in maintenance.category_audit(r).collect()}
    assert got == {"zzz": (None, False), "foo [tv]": ("5000", True)}


def test_missing_groups_are_ranked(spark):
    cur, disc = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (["c", "a", "b"], ["b"]))
    assert {tuple(r) for r in groups.missing(cur, disc).collect()} == {("a", 1), ("c", 2)}


def test_manifest_of_a_large_release(spark):
    rel = spark.createDataFrame([(1, "t", 2000)], "id long, norm_title string, category_id int")
    seg = spark.range(1, 2501).select(F.lit("t").alias("norm_title"), F.col("id").cast("int").alias("number"),
                                      F.concat(F.lit("m&"), "id").alias("message_id"), F.lit("g").alias("group"), F.lit(5).cast("long").alias("size"))
    parts = [r["nzb"] for r in outputs.manifests(rel, seg).orderBy("part").collect()]
    assert len(parts) == 4 and "".join(parts).count("<segment ") == 2500 and "".join(parts).endswith("</segments></file></nzb>")
    assert "".join(parts).index("m&amp;999<") < "".join(parts).index("m&amp;1000<")
    assert outputs.manifests(rel, seg, max_segments=1000).count() == 0


def test_scratch_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    from relindex import session
    monkeypatch.setattr(session, "_scratch", [])
    df = ingest.materialize(spark.range(5), "to_drop")
    path = session._scratch[0]
    assert df.count() == 5 and "to_drop" in path
    assert session.drop_scratch(spark) == 1 and session.drop_scratch(spark) == 0
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        spark.read.parquet(path).count()


def test_no_scratch_folder_on_a_cluster():
    from relindex import session

    class Nothing:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Nothing)


def test_manifest_texts_and_their_segments_are_not_dealt_out_once_a_release(spark):
    """The releases of one title share its segments; two releases more must not shuffle them again, nor whole documents."""
    seg = spark.createDataFrame([("t", n, f"m{n}", "g", 10 * n) for n in (1, 2, 1001)] + [("u", 1, "a&b", None, 5)],
                                "norm_title string, number int, message_id string, `group` string, size long")
    rel = spark.createDataFrame([(i, "t", 2000 + i, True) for i in (1, 2, 3)] + [(4, "u", 2000, True), (4, "u", 2000, True)],
                                "id long, norm_title string, category_id int, has_parts boolean")
    df = outputs.manifests(rel, seg)
    doc = {}
    for r in df.orderBy("id", "part").collect():
        doc[r["id"]] = doc.get(r["id"], "") + r["nzb"]
    assert sorted(doc) == [1, 2, 3, 4]
    for i in (1, 2, 3):
        assert doc[i].endswith(f'subject="{i}"><groups><group>g</group></groups><segments><segment bytes="10" number="1">m1</segment>'
                               '<segment bytes="20" number="2">m2</segment><segment bytes="10010" number="1001">m1001</segment></segments></file></nzb>')
    assert doc[4].endswith('<groups></groups><segments>' + '<segment bytes="5" number="1">a&amp;b</segment>' * 2 + '</segments></file></nzb>')
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    dealt = [x for x in plan.split("\n\n") if ") Exchange" in x]
    assert dealt and not [x for x in dealt if "nzb#" in x]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import time

    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key, None)
    a = ingest.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "no_shuffle")
    b = ingest.materialize(spark.range(3), "no_shuffle")
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(key, None) == kept
    assert a.count() == 7
    gone = a.inputFiles()[0]
    ingest.drop_table(a)
    assert not os.path.exists(gone.removeprefix("file://")) and b.count() == 3


def test_the_table_of_the_fold_gives_the_same_segments_and_candidates(spark):
    sf = "/root/testdata/sf0.001"
    whole, p = K.parsed(spark, sf), K.folded(spark, sf)
    assert not {"subject", "norm_title"} & set(p.columns)
    for make in (ingest.collect_segments, ingest.fold_releases):
        x, y = make(whole), make(ingest.gate(p))
        assert x.columns == y.columns and x.count() == y.count() and not x.exceptAll(y).count()
