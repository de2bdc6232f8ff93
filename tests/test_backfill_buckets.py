"""Co-bucketed backfill against the shuffled one, hot titles included; the plan shuffles neither side."""

import pytest
from pyspark.sql import functions as F

from relindex.operators import backfill as BF
from relindex.operators import backfill_buckets as BB
from relindex.operators import ingest
from tests.conftest import headers_df

DATE = "Mon, 06 Feb 1995 10:00:00 +0000"


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(f"alt.binaries.tv{n % 3}", n, f"<m{n}@x>", f"[tv] Show.{'abcde'[n % 5]}.mkv ({n % 40 + 1}/40) yEnc", 1000 + n, None if n % 5 == 4 else DATE)
            for n in range(300)]
    # one title with most of the headers
    rows += [("alt.binaries.hot", n, f"<h{n}@x>", f"[tv] Hot.show.mkv ({n}/900) yEnc", 50 + n, DATE) for n in range(1, 901)]
    return ingest.materialize(ingest.parse_headers(headers_df(spark, rows)), "t")


def told(dfs):
    return [sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) for df in dfs]


@pytest.mark.parametrize("hot", [10, 100, 200_000])
def test_equals_shuffled_backfill(spark, parsed, hot):
    rel = ingest.materialize(ingest.build_releases(ingest.gate(parsed), gated=False), "t")
    title = F.when(F.col("id") % 3 == 0, F.concat(F.lit("gone "), "norm_title")).otherwise(F.col("norm_title"))
    grp = F.when(F.col("id") % 2 == 0, F.col("source_group")).when(F.col("id") % 4 == 1, F.lit(""))
    t = rel.select("id", title.alias("norm_title"), grp.alias("source_group"))
    t = ingest.materialize(t.unionByName(spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "no such", None)], t.schema)), "t")
    order = spark.createDataFrame([("alt.binaries.tv2", 0), ("alt.binaries.tv1", 1), ("alt.binaries.tv1", 4)], "name string, pos int")
    layout = BB.write_parts(parsed, buckets=4, hot=hot)
    assert (spark.read.parquet(layout.hot).count() > 0) == (hot < 200_000)
    targets = BB.write_targets(t, layout)
    for groups in (None, order):
        got = told(BB.backfill(spark, targets, layout, groups))
        want = told(BF.backfill(t, parsed, groups=groups))
        assert got == want and got[0] and got[2]
    BB.drop(spark, targets, layout.parts)


def test_no_exchange_and_spread(spark, parsed):
    layout = BB.write_parts(parsed, buckets=4, hot=10)
    t = spark.createDataFrame([(7, "x", None)], "id long, norm_title string, source_group string")
    targets = BB.write_targets(t, layout)
    plan = BB.matched(spark, targets, layout)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    counts = BB.matched(spark, targets, layout).groupBy("key", "id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in counts  # the first aggregate stays inside the buckets
    most = spark.table(layout.parts).groupBy("key").count().agg(F.max("count")).first()[0]
    assert most <= 40  # 900 parts of one title lie under 90 keys
    assert BB.backfill(spark, targets, layout)[2].count() == 1


def test_empty_tables(spark, parsed):
    layout = BB.write_parts(parsed.limit(0), buckets=2)
    t = spark.createDataFrame([(7, "x", None)], "id long, norm_title string, source_group string")
    filled, segs, gone = BB.backfill(spark, BB.write_targets(t, layout), layout)
    assert (filled.count(), segs.count(), [r["id"] for r in gone.collect()]) == (0, 0, [7])
    filled, segs, gone = BB.backfill(spark, BB.write_targets(t.limit(0), layout), layout)
    assert (filled.count(), segs.count(), gone.count()) == (0, 0, 0)
