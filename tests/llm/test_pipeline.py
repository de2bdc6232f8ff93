"""The pipeline's stages against brute force, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from relindex.llm import decontaminate
from relindex.llm.common import stored
from tests.llm.test_operators import SCHEMA, join_brute, leaks_brute, made_up


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("sf")
    texts = made_up(11)
    rows = [(i, t + (" write to a.b7@mail.example.com now" if i % 9 == 0 and t else ""), "en" if i % 4 else None, f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "12 34 !!", None, "s1", 8)]
    spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).repartition(3).write.parquet(f"{d}/documents.parquet")
    items = [("q1", " ".join(texts[5].split()[:14])), ("q2", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages(spark, folder):
    d, rows, items = folder
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, d), "test-stage")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mix":
            assert docs.columns == P.COLUMNS
    letters = {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert set(kept["language_id"]) == letters and all(r["lang"] for r in kept["language_id"].values())
    left = [r for r in rows if r[0] in letters]
    groups = join_brute(left, 5, 80)
    assert set(kept["jaccard_join"]) == {i for i, (_, root, _) in groups.items() if root == i}
    left = [r for r in left if r[0] in kept["jaccard_join"]]
    assert set(kept["decontamination"]) == {i for i, (_, hit, _) in leaks_brute(left, items) if not hit}
    assert set(kept["pii"]) == set(kept["decontamination"])
    for i, r in kept["pii"].items():
        before = kept["decontamination"][i]["text"]
        assert r["text"] == before.replace("a.b7@mail.example.com", "<email>") and r["n_chars"] == (len(r["text"]) if r["text"] != before else kept["decontamination"][i]["n_chars"])
    assert set(kept["mix"]) <= set(kept["pii"]) and all(r["taken"] == r["size"] * len(r["positions"]) > 0 for r in kept["mix"].values())
    whole = sum(len(decontaminate.words(r["text"])) if hasattr(decontaminate, "words") else len(r["text"].split()) for r in kept["pii"].values())
    assert abs(sum(r["taken"] for r in kept["mix"].values()) - whole) < 0.2 * whole


def test_run_and_empty_table(spark, folder, tmp_path):
    d, *_ = folder
    assert P.run(spark, d).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_keys(spark, tmp_path):
    prose = lambda name, n: " ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    leak, copied = prose("leak", 14), prose("copied", 40)
    rows = [(None, f"{prose('bad', 30)} {leak}", "en", "s0", 1), (None, prose("clean", 50), "en", "s0", 2), (None, prose("more", 60), "en", "s1", 3),
            (None, copied, "en", "s0", 4), (None, copied, "en", "s1", 5), (8, copied, "en", "s1", 6), (7, prose("seven", 30), "en", "s0", 7),
            (7, prose("other", 45), "en", "s0", 8), (7, f"{prose('worse', 20)} {leak}", "en", "s0", 9), (9, prose("nine", 35), "en", "s1", 10), (9, prose("nine", 35), "en", "s1", 10),
            (None, "", "en", "s0", 11), (10, prose("ten", 50), "en", "s0", 12), (3, prose("ten", 50), "en", "s0", 13)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    deduplicated = sorted(r[4] for r in P.drop_near_copies(spark, docs, str(tmp_path)).collect())
    assert deduplicated == [1, 2, 3, 6, 7, 8, 9, 10, 11, 13]  # of three copies the one with a key, of two equal rows one
    assert sorted(r[4] for r in P.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()) == [2, 3, 4, 5, 6, 7, 8, 10, 10, 11, 12, 13]
    sliced = decontaminate.decontaminate(docs.select(F.struct(*P.COLUMNS).alias("row"), "text"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), key="row", slice_bytes=40)
    assert sorted(r[0] for r in sliced.where(F.size("spans") == 0).select("row.n_chars").collect()) == [2, 3, 4, 5, 6, 7, 8, 10, 10, 11, 12, 13]
    mixed = P.mix_sources(spark, docs, str(tmp_path)).collect()
    assert all(r["size"] == len(r["text"].split()) and r["taken"] == r["size"] * len(r["positions"]) > 0 for r in mixed)
    assert len(mixed) <= 13 and all(sum(r["n_chars"] == n for r in mixed) <= 1 + (n == 10) for n in range(1, 14))
    assert all(sum(p == q for m in mixed if m["source"] == r["source"] for q in m["positions"]) == 1 for r in mixed for p in r["positions"])
    kept = P.run(spark, str(tmp_path)).collect()
    assert {r["n_chars"] for r in kept} <= {2, 3, 6, 7, 8, 10, 13} and len({r["n_chars"] for r in kept}) == len(kept) > 0


def test_no_language_to_learn_from(spark):
    rows = [(1, "some words", None, "s0", 1), (2, "12 !?", None, "s0", 2), (None, "Ünï", None, None, 3), (4, None, None, "s1", 4), (5, "", None, "s1", 5), (6, "12", "en", "s1", 6)]
    kept = P.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r["n_chars"], r["lang"]) for r in kept) == [(1, None), (3, None)]


def test_short_items_are_no_leaks(spark, tmp_path):
    seven, eight = "one Two-three four five six seven", "Ünï, two (three) four_five six 7 éight"
    assert [len(decontaminate.fold_words(x)) for x in (seven, eight)] == [7, 8]
    texts = ["yes of course", "yes yes yes yes yes yes yes yes yes", f"and {seven} ends", f"and {eight} ends", "nothing", None]
    docs = spark.createDataFrame([(i, t, "en", "s0", i) for i, t in enumerate(texts)], SCHEMA)
    spark.createDataFrame([("q1", "Yes"), ("q2", "of course"), ("q3", seven), ("q4", eight), ("q5", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in P.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()) == [0, 1, 2, 4, 5]
    codes = [chr(c) for c in [*range(256), 0x3000, 0x1F600]]
    found = spark.createDataFrame([(c, f"a{c}b") for c in codes], "c string, t string").select("c", "t", F.regexp_count("t", F.lit(P._FOLDED_WORD)).alias("n")).collect()
    assert all(r["n"] == len(decontaminate.fold_words(r["t"])) for r in found)
