"""Benchmark: headline operations at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

upsert of a 10 % batch, search top-100, size + age pruning, backfill match.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from relindex import config as C  # noqa: E402
from relindex.operators import backfill as BF  # noqa: E402
from relindex.operators import ingest, maintenance as M, search as S, upsert as UP  # noqa: E402
from relindex.session import build_session, drop_scratch  # noqa: E402
from relindex.sources import store  # noqa: E402
from relindex.sources.headers import fixture_headers  # noqa: E402

AS_OF = "2001-12-31 00:00:00"


def timed(fn):
    t = time.perf_counter()
    out = fn()
    return out, time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app="relindex-bench")
    q: dict[str, float] = {}

    headers = fixture_headers(spark, sf_dir)
    n_headers = headers.count()

    # header parse: one projection over every header, written once
    raw, q["parse"] = timed(lambda: ingest.materialize(
        ingest.parse_headers(headers.repartition(2 * cpus)), "bench_parsed"))
    parsed = ingest.gate(raw)

    # fold to releases (E1, E2, cross-group merge, C3) and partitioned write
    def fold():
        segs = ingest.materialize(ingest.collect_segments(parsed), "bench_segments")
        rel = ingest.with_storage_columns(ingest.build_releases(parsed, segments=segs))
        return store.write_releases(rel), segs
    (rel_path, segs), q["fold"] = timed(fold)
    rel = store.read_releases(spark, rel_path)
    n_releases = rel.count()

    # upsert of a 10 % batch into the table built from the other 90 %
    new = F.col("article_number") % 10 == 0
    base_p, batch_p = parsed.where(~new), parsed.where(new)
    base_segs = ingest.materialize(ingest.collect_segments(base_p), "bench_base_segments")
    base_rel = store.read_releases(spark, store.write_releases(
        ingest.with_storage_columns(ingest.build_releases(base_p, segments=base_segs, gated=False))))
    base_cand = ingest.materialize(ingest.fold_releases(base_p), "bench_base_candidates")
    base_rel.count()

    def up():
        out = UP.upsert(base_rel, base_segs, base_cand, batch_p)[0]
        return store.write_releases(out)
    _, q["upsert_10pct"] = timed(up)

    # search top-100: text + category + newest; and plain newest
    def srch():
        a = S.search(rel, S.SearchQuery(q="widget", cat="2000,5000,7020", limit=100)).collect()
        b = S.search(rel, S.SearchQuery(limit=100, sort="size")).collect()
        return len(a) + len(b)
    _, q["search_top100"] = timed(srch)

    # size and age pruning: count kept/removed for both policies
    def prune():
        pol = C.SizePolicy(patterns=[("^small ", 150_000_000)], max_size=400_000_000)
        k1, r1 = M.prune_sizes(rel, pol)
        k2, r2 = M.prune_old(rel, 1500, AS_OF)
        return r1.count() + r2.count()
    _, q["prune_size_age"] = timed(prune)

    # backfill match: every release re-derives its segments from the headers
    def bf():
        filled, _, unresolved = BF.backfill(rel.select("id", "norm_title", "source_group"), raw)
        return filled.count() + unresolved.count()
    _, q["backfill"] = timed(bf)

    total = sum(q.values())
    print(json.dumps({
        "metric": "total_sec", "value": round(total, 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in q.items()},
        "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": cpus,
        "headers": n_headers, "releases": n_releases,
        "parse_rows_per_sec": round(n_headers / q["parse"], 1) if q["parse"] else None,
    }))
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
