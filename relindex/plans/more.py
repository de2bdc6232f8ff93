"""Registered queries over indexes, inventories, logs and plans, each with its DuckDB SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import backfill as BF
from ..operators import backfill_buckets as BB
from ..operators import groups as G
from ..operators import ingest
from ..operators import maintenance as M
from ..operators import metrics as MT
from ..operators import progress as PG
from ..operators import ranges as R
from ..operators import search as S
from ..operators import textindex as TI
from ..operators import upsert as UP
from .. import config as C
from ..functions import category as CAT
from ..session import table_path
from ..sources import policies, store
from ..sources.headers import load_table
from ..streaming import ingest as ST
from ..streaming import release_state as RS
from . import common as K
from . import oracle as O
from . import queries as Q
from .oracle_sql import headers_ctes, parsed_ctes, releases_ctes, ts_text, with_ctes

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name: str, fn, sql) -> None:
    QUERIES[name], ORACLE[name] = fn, sql


# ---------------------------------------------------------------- search over indexes

def _indexed(spark, sf_dir, *kinds):
    """The stored release table and its indexes."""
    rel = store.read_releases(spark, store.write_releases(K.releases(spark, sf_dir)))
    root = TI.new_root(spark)
    return rel, *(TI.TextIndex(spark, root, k).build(rel) for k in kinds)


def _told(page):
    return page.select("norm_title", "category", "category_id", "size_bytes", K.ts_text(F.col("posted_at")).alias("posted_at"),
                       F.date_format(F.coalesce(F.col("posted_at"), F.to_timestamp(F.lit(K.AS_OF))), "EEE, dd MMM yyyy HH:mm:ss Z").alias("pub_date"))


def q_indexed_text(spark, sf_dir):
    """C5 over the token index, inside J1."""
    rel, tok = _indexed(spark, sf_dir, "tokens")
    return _told(TI.search(rel.drop("search_tokens"), S.SearchQuery(q="Widget, small!", sort="size", limit=100), tok, None))


_add("C5_indexed_text", q_indexed_text, lambda: O._page_sql(O._tokens_where("Widget, small!"), sort="size_bytes"))


def q_indexed_title(spark, sf_dir):
    """C6 over the gram index."""
    rel, gram = _indexed(spark, sf_dir, "grams")
    return _told(TI.search(rel.drop("search_tokens"), S.SearchQuery(q="gear", has_vector=False, sort="title", limit=100), None, gram))


_add("C6_indexed_title", q_indexed_title, lambda: O._page_sql("norm_title ILIKE '%gear%'", sort="norm_title"))


def q_indexed_wildcards(spark, sf_dir):
    """C6 over the gram index with wildcards, all rows that match."""
    rel, gram = _indexed(spark, sf_dir, "grams")
    return TI.title_contains(rel, gram, "W_dget%199").select("norm_title", "category_id")


_add("C6_indexed_wildcards", q_indexed_wildcards, lambda: with_ctes(releases_ctes(), "SELECT norm_title, category_id FROM releases WHERE norm_title ILIKE '%W_dget%199%'"))


def q_indexed_tag(spark, sf_dir):
    """C8 over the gram index."""
    rel, gram = _indexed(spark, sf_dir, "grams")
    return _told(TI.search(rel.drop("search_tokens"), S.SearchQuery(tag="small", limit=50), None, gram))


_add("C8_indexed_tag", q_indexed_tag, lambda: O._page_sql("tags LIKE 'small%'", limit=50))


def q_indexed_after_upsert(spark, sf_dir):
    """C5 + C6 over indexes of the table of 90 % of the headers, updated by the titles that the other 10 % touch."""
    p = K.parsed(spark, sf_dir)
    new = F.col("article_number") % 10 == 0
    base_p, batch_p = p.where(~new), p.where(new)
    segs = ingest.collect_segments(base_p)
    rel = ingest.materialize(ingest.with_storage_columns(ingest.build_releases(base_p, segments=segs, gated=False)), "index_base")
    root = TI.new_root(spark)
    tok, gram = (TI.TextIndex(spark, root, k).build(rel) for k in ("tokens", "grams"))
    cand = ingest.fold_releases(batch_p)
    out = ingest.materialize(UP.upsert(rel, segs, ingest.fold_releases(base_p), batch_p, cand)[0], "index_new")
    titles = cand.select(F.col("dedupe_key").alias("norm_title")).distinct()
    old, now = (t.join(titles, "norm_title", "left_semi") for t in (rel, out))
    for index in (tok, gram):
        index.update(old, now)
    found = TI.title_contains(TI.text_match(ingest.size_gate(out), tok, "widget"), gram, "small")
    return found.select("norm_title", "category_id")


_add("C5_indexed_after_upsert", q_indexed_after_upsert, lambda: with_ctes(
    releases_ctes(), f"SELECT norm_title, category_id FROM releases WHERE {O._tokens_where('widget')} AND norm_title ILIKE '%small%'"))


def q_seek_page(spark, sf_dir):
    """G1 + G2: the third page of 100 newest, by seeking from the last key of the page before."""
    path = store.write_pages(S.searchable(K.releases(spark, sf_dir)), table_path(spark, f"pages-{uuid.uuid4().hex[:8]}"), 1000)
    after = None
    for _ in range(2):
        after = store.seek_page(spark, path, 100, after).agg(F.max("_key").alias("k")).first()["k"]
    return _told(store.seek_page(spark, path, 100, after))


_add("G2_seek_page", q_seek_page, lambda: O._page_sql(limit=100, offset=200))


# ---------------------------------------------------------------- inventory

def q_inventory(spark, sf_dir):
    """Partition figures from the inventory that the write leaves."""
    path = store.write_releases(K.releases(spark, sf_dir), inventory=True)
    return store.read_inventory(spark, path).select(
        "bucket", "posted_year", "n", "n_undated", K.ts_text(F.col("first_posted")).alias("first_posted"),
        K.ts_text(F.col("last_posted")).alias("last_posted"), "least_size", "most_size")


_add("E10_partition_inventory", q_inventory, lambda: with_ctes(releases_ctes(), f"""
SELECT bucket, CAST(posted_year AS INTEGER) AS posted_year, count(*) AS n, count(*) - count(posted_at) AS n_undated, {ts_text('min(posted_at)')} AS first_posted,
  {ts_text('max(posted_at)')} AS last_posted, min(size_bytes) AS least_size, max(size_bytes) AS most_size FROM releases GROUP BY bucket, posted_year"""))


def q_drop_empty_inventory(spark, sf_dir):
    """A8 over the inventory: no release file is read."""
    path = store.write_releases(K.releases(spark, sf_dir), inventory=True)
    return M.drop_empty_partitions(spark, M.inventory_counts(spark, path), 1990, 2005, retain=[("movies", 1990)])


_add("A8_drop_empty_inventory", q_drop_empty_inventory, O.sql_drop_empty)


def q_prune_old_inventory(spark, sf_dir):
    """I3 over the inventory: rows that go, by partition."""
    path = store.write_releases(K.releases(spark, sf_dir), inventory=True)
    removed = M.prune_old_by_inventory(spark, path, 1500, K.AS_OF)[1]
    return removed.groupBy("bucket", "posted_year").agg(F.count(F.lit(1)).alias("n"))


_add("I3_prune_old_inventory", q_prune_old_inventory, lambda: with_ctes(releases_ctes(), f"""
SELECT bucket, CAST(posted_year AS INTEGER) AS posted_year, count(*) AS n FROM releases
WHERE posted_at < TIMESTAMP '{K.AS_OF}' - INTERVAL 1500 DAY GROUP BY ALL"""))


# ---------------------------------------------------------------- ranges

def _bounds(h):
    return h.groupBy("grp").agg((F.min("article_number") - 50).alias("low"), (F.max("article_number") + 1500).alias("high"))


def q_range_batches(spark, sf_dir):
    """The articles that are missing between and around the stored ones, cut and dealt over the groups."""
    h = K.headers(spark, sf_dir).select("grp", "article_number")
    return R.dealt(R.batches(R.missing_ranges(h, _bounds(h))))


_add("G4_range_batches", q_range_batches, lambda: with_ctes(headers_ctes() + """,
bd AS (SELECT grp, min(article_number) - 50 AS low, max(article_number) + 1500 AS high FROM headers GROUP BY grp),
al AS (SELECT grp, article_number AS a FROM headers UNION SELECT grp, low - 1 FROM bd UNION SELECT grp, high + 1 FROM bd),
gp AS (SELECT grp, a + 1 AS lo, lead(a) OVER (PARTITION BY grp ORDER BY a) - 1 AS hi FROM al),
bt AS (SELECT grp, unnest(range(lo, hi + 1, 1000)) AS start, hi FROM gp WHERE lo <= hi)""", """
SELECT CAST(row_number() OVER (PARTITION BY grp ORDER BY start) AS INTEGER) AS turn, grp, start, least(start + 999, hi) AS stop FROM bt"""))


def q_next_batches(spark, sf_dir):
    """Each group's next batch after its cursor, which stands at three different places (one at the end)."""
    h = K.headers(spark, sf_dir).groupBy("grp").agg(F.max("article_number").alias("high"))
    at = F.length("grp") % 3
    last = F.when(at == 0, F.col("high")).when(at == 1, F.col("high") - 40)
    return R.next_batches(h.withColumn("last_article", last))


_add("G4_next_batches", q_next_batches, lambda: with_ctes(headers_ctes() + """,
st AS (SELECT grp, max(article_number) AS high FROM headers GROUP BY grp),
la AS (SELECT grp, high, CASE length(grp) % 3 WHEN 0 THEN high WHEN 1 THEN high - 40 ELSE 0 END AS last FROM st)""", """
SELECT grp, last + 1 AS start, last + least(high - last, 1000) AS stop FROM la WHERE high > last"""))


def q_read_range(spark, sf_dir):
    """A1: header records read back for one planned range of each of two groups."""
    from ..sources.headers import read_headers
    path = table_path(spark, f"headers-{uuid.uuid4().hex[:8]}")
    K.headers(spark, sf_dir).write.parquet(path)
    a = read_headers(spark, path, "parquet", "alt.binaries.misc", 1000, 30000)
    return a.unionByName(read_headers(spark, path, "parquet", "alt.binaries.hdtv", None, 20000)).select("grp", "article_number", "message_id")


_add("A1_read_headers", q_read_range, lambda: with_ctes(headers_ctes(), """
SELECT grp, article_number, message_id FROM headers
WHERE (grp = 'alt.binaries.misc' AND article_number BETWEEN 1000 AND 30000) OR (grp = 'alt.binaries.hdtv' AND article_number <= 20000)"""))


# ---------------------------------------------------------------- progress log

def _log(spark, sf_dir):
    """A change log made of the event stream: every event moves a group's cursor, some hide it, a few reset or switch the mode."""
    ev, i = load_table(spark, sf_dir, "events"), F.col("event_id")
    kind = (F.when(i % 4999 == 7, "reset").when(i % 7001 == 9, "curated").when(i % 6007 == 11, "mode").when(i % 97 == 5, "irrelevant").otherwise("advance"))
    g = F.concat(F.lit("g"), (F.col("user_id") % 40).cast("string"))
    keep = F.transform(F.sequence(F.lit(0), F.lit(39), F.lit(2)), lambda n: F.concat(F.lit("g"), n.cast("string")))
    return ev.select(i.cast("long").alias("seq"), kind.alias("kind"), F.when(kind.isin("advance", "irrelevant"), g).alias("grp"),
                     F.when(kind == "advance", i * 3).cast("long").alias("article"), F.when((kind == "reset") & (i % 2 == 1), keep).alias("keep"),
                     F.when(kind == "mode", F.lit("all")).alias("mode"))


def q_progress_log(spark, sf_dir):
    """K2: state of the groups after a log with marks, resets that keep a list, and mode switches."""
    return PG.group_state(_log(spark, sf_dir))


_LOG_SQL = """
ev AS (SELECT event_id AS i, CASE WHEN event_id % 4999 = 7 THEN 'reset' WHEN event_id % 7001 = 9 THEN 'curated' WHEN event_id % 6007 = 11 THEN 'mode'
         WHEN event_id % 97 = 5 THEN 'irrelevant' ELSE 'advance' END AS kind, user_id % 40 AS u FROM events),
md AS (SELECT i, kind, lag(kind) OVER (ORDER BY i) AS before FROM ev WHERE kind IN ('curated', 'mode')),
rs AS (SELECT i, i % 2 = 1 AS keeps FROM ev WHERE kind = 'reset' UNION ALL SELECT i, false FROM md WHERE kind = 'curated' AND before IS DISTINCT FROM 'curated'),
gr AS (SELECT DISTINCT u FROM ev WHERE kind IN ('advance', 'irrelevant')),
cu AS (SELECT u, coalesce((SELECT max(i) FROM rs WHERE NOT (keeps AND gr.u % 2 = 0)), -1) AS since FROM gr),
lv AS (SELECT ev.* FROM ev JOIN cu USING (u) WHERE ev.i > since AND kind IN ('advance', 'irrelevant')),
st AS (SELECT 'g' || u AS grp, CAST(coalesce(max(i * 3) FILTER (WHERE kind = 'advance'), 0) AS BIGINT) AS last_article, arg_max(kind, i) = 'irrelevant' AS irrelevant
       FROM lv GROUP BY u)"""
_add("K2_progress_log", q_progress_log, lambda: f"WITH {_LOG_SQL} SELECT * FROM st")


def q_keyed_release(spark, sf_dir):
    """K4 + K3: headers streamed as two files through keyed state; a tenth of the first file's headers come again with the second."""
    src, root = (table_path(spark, f"keyed-{k}-{uuid.uuid4().hex[:8]}") for k in ("src", "state"))
    h = K.unparsed(spark, sf_dir)
    half = F.col("article_number") % 2 == 0
    for part in (h.where(half), h.where(~half | (F.col("article_number") % 10 == 0))):
        ST.stage_header_files(part, f"{src}/{uuid.uuid4().hex[:8]}", 1)
        RS.keyed_ingest(spark, src, root, buckets=8, shards=2).awaitTermination()
    rel = ingest.size_gate(RS.releases(spark, root))
    return rel.select("norm_title", "category_id", "size_bytes", "part_count", "has_parts", K.ts_text(F.col("posted_at")).alias("posted_at"))


_add("K4_keyed_release", q_keyed_release, lambda: O.REGISTRY["K1_stream_ingest"]())


def q_group_filters(spark, sf_dir):
    """Groups of the log that may be polled: not ignored, not irrelevant, not held back by a probe in the future."""
    state = PG.group_state(_log(spark, sf_dir))
    probe = F.when(F.col("last_article") % 5 == 0, F.to_timestamp(F.lit("2002-01-01 00:00:00"))).when(
        F.col("last_article") % 5 == 1, F.to_timestamp(F.lit("2001-01-01 00:00:00")))
    p = state.select(F.col("grp").alias("name"), "irrelevant", probe.alias("next_probe"))
    ignored = load_table(spark, sf_dir, "nation").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("name")).where("name LIKE '%7'")
    return G.group_filters(p.select("name"), p, ignored, K.AS_OF, curated_mode=False)


_add("C9_group_filters", q_group_filters, lambda: f"""WITH {_LOG_SQL}
SELECT grp AS name FROM st WHERE NOT irrelevant AND last_article % 5 <> 0
  AND grp NOT IN (SELECT 'g' || n_nationkey FROM nation WHERE n_nationkey % 10 = 7)""")


def q_select_groups(spark, sf_dir):
    """What each mode selects, for a curated, a configured and a discovered list."""
    none = Q._curated(spark).limit(0)
    found = Q._discovered(spark, sf_dir)
    some = found.where("name LIKE '%hd%'").withColumn("pos", F.lit(0))
    cases = {"curated": ("curated", Q._curated(spark), some), "configured": ("configured", none, some), "nothing": ("configured", none, none),
             "auto": ("auto", none, none)}
    out = None
    for case, (mode, curated, configured) in cases.items():
        one = G.select_groups(mode, curated, configured, found, Q._curated(spark)).select(F.lit(case).alias("case"), "name")
        out = one if out is None else out.unionByName(one)
    return out


_add("A17_select_groups", q_select_groups, lambda: with_ctes(headers_ctes() + f""",
cu AS (SELECT name FROM {O._curated_sql()}), di AS (SELECT DISTINCT grp AS name FROM headers)""", """
SELECT 'curated' AS case, name FROM cu UNION ALL SELECT 'configured', name FROM di WHERE name LIKE '%hd%'
UNION ALL SELECT 'auto', name FROM cu WHERE name IN (SELECT name FROM di)"""))


# ---------------------------------------------------------------- metrics

def _timed(spark, sf_dir):
    m = Q._metrics(spark, sf_dir)
    return m.withColumn("duration_ms", F.col("processed") * 5 + F.col("batch") % 7).withColumn("database_ms", F.col("inserted") * 3 + F.col("batch") % 4)


def q_batch_rates(spark, sf_dir):
    """E5: averages and ETA for each group and batch."""
    return MT.with_rates(_timed(spark, sf_dir)).select("grp", "batch", "average_batch_ms", "average_database_latency_ms", "eta_seconds")


_TIMED = """,
tm AS (SELECT *, processed * 5 + batch % 7 AS duration_ms, inserted * 3 + batch % 4 AS database_ms FROM m)"""
_add("E5_batch_rates", q_batch_rates, lambda: with_ctes(O._metrics_ctes() + _TIMED, """
SELECT grp, batch, round(duration_ms / processed, 3) AS average_batch_ms, round(database_ms / processed, 3) AS average_database_latency_ms,
  CASE WHEN duration_ms > 0 AND remaining > 0 THEN CAST(floor(remaining / (processed / (duration_ms / 1000))) AS BIGINT) END AS eta_seconds FROM tm"""))


def q_global_eta(spark, sf_dir):
    """Processed, remaining and ETA over all groups."""
    return MT.global_eta(_timed(spark, sf_dir))


_add("E6_global_eta", q_global_eta, lambda: with_ctes(O._metrics_ctes() + _TIMED + """,
sm AS (SELECT batch, sum(processed) AS p, sum(remaining) AS r, sum(duration_ms) AS d FROM tm GROUP BY batch)""", """
SELECT batch, CAST(p AS BIGINT) AS processed, CAST(r AS BIGINT) AS remaining,
  CASE WHEN d > 0 AND p > 0 AND r > 0 THEN CAST(floor(r / (p / (d / 1000))) AS BIGINT) ELSE 0 END AS eta_seconds FROM sm"""))


def q_many_labels(spark, sf_dir):
    """Counters with three labels, one of them missing at times."""
    ev = load_table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("user"), (F.col("user_id") % 3).cast("string"), F.lit("k"), F.get_json_object("props", "$.k"),
                          F.lit("big"), F.when(F.col("value") > 50, F.lit("yes")))
    return MT.counters(ev, "event_type", labels)


_add("E7_many_labels", q_many_labels, lambda: """
SELECT event_type || '{' || CASE WHEN value > 50 THEN 'big=yes,' ELSE '' END || coalesce('k=' || json_extract_string(props, '$.k') || ',', '')
  || 'user=' || (user_id % 3) || '}' AS key, count(*) AS value FROM events GROUP BY 1""")


# ---------------------------------------------------------------- maintenance

def q_remove_by_id(spark, sf_dir):
    """What is left after the takedown of a list of releases."""
    rel = ingest.materialize(K.releases(spark, sf_dir), "takedown")
    return M.remove_by_id(rel, rel.where("id % 7 = 3").select("id"))[0].select("norm_title", "category_id")


_add("I9_remove_by_id", q_remove_by_id, lambda: with_ctes(releases_ctes(), "SELECT norm_title, category_id FROM releases WHERE id % 7 <> 3"))


def q_adult(spark, sf_dir):
    """Releases of adult categories, by category."""
    r = K.releases(spark, sf_dir)
    return r.groupBy("category_id").agg(F.count(F.when(CAT.is_adult_category(F.col("category_id")), 1)).alias("adult"), F.count(F.lit(1)).alias("n"))


_add("B15_adult_categories", q_adult, lambda: with_ctes(releases_ctes(), """
SELECT category_id, count(*) FILTER (WHERE category_id BETWEEN 6000 AND 6999) AS adult, count(*) AS n FROM releases GROUP BY category_id"""))


def q_backfill_auto(spark, sf_dir):
    """I8 in auto mode, written back: a third of the releases lost their segments, an eleventh got a title that no header has."""
    p, pa = K.parsed(spark, sf_dir), K.parsed_all(spark, sf_dir)
    segs = ingest.collect_segments(p)
    rel = ingest.materialize(ingest.build_releases(p, segments=segs), "backfill_releases")
    lost = rel.where("id % 3 = 0").select("norm_title").distinct()
    renamed = F.when(F.col("id") % 11 == 0, F.concat(F.lit("renamed "), "norm_title")).otherwise(F.col("norm_title"))
    cut = rel.withColumn("norm_title", renamed).withColumns({"part_count": F.lit(0), "size_bytes": F.lit(1).cast("long")})
    out, _, _ = BF.backfill_job(cut, segs.join(lost, "norm_title", "left_anti"), pa, auto=True)
    return out.select("id", "norm_title", "part_count", "size_bytes")


_add("I8_backfill_auto", q_backfill_auto, lambda: with_ctes(O._backfill_ctes() + """,
lost AS (SELECT DISTINCT norm_title FROM releases WHERE id % 3 = 0),
cut AS (SELECT id, has_parts, CASE WHEN id % 11 = 0 THEN 'renamed ' || norm_title ELSE norm_title END AS norm_title FROM releases),
left_ AS (SELECT DISTINCT norm_title FROM segments WHERE norm_title NOT IN (SELECT norm_title FROM lost)),
tgt2 AS (SELECT id FROM cut WHERE has_parts AND norm_title NOT IN (SELECT norm_title FROM left_)),
fill2 AS (SELECT * FROM filled WHERE id IN (SELECT id FROM tgt2) AND id % 11 <> 0)""", """
SELECT cut.id, cut.norm_title, coalesce(f.part_count, 0) AS part_count, coalesce(f.size_bytes, 1) AS size_bytes
FROM cut LEFT JOIN fill2 f ON f.id = cut.id WHERE cut.id NOT IN (SELECT id FROM tgt2) OR f.id IS NOT NULL"""))


def q_backfill_bucketed(spark, sf_dir):
    """D3 + E4 over co-bucketed parts and releases; titles of more than 50 parts are dealt over salts."""
    layout = BB.write_parts(K.parsed_all(spark, sf_dir), K.deal(spark), hot=50)
    return BB.backfill(spark, BB.write_targets(K.releases(spark, sf_dir), layout), layout)[0]


_add("D3_backfill_bucketed", q_backfill_bucketed, lambda: O.REGISTRY["D3_backfill_match"]())


def q_unresolved_bucketed(spark, sf_dir):
    """D4 over co-bucketed tables: every fifth title is one that no header has, half of the others lose their group."""
    rel = K.releases(spark, sf_dir)
    stale = F.when(F.col("id") % 5 == 0, F.concat(F.lit("renamed "), "norm_title")).otherwise(F.col("norm_title"))
    t = rel.select("id", stale.alias("norm_title"), F.when(F.col("id") % 2 == 0, F.col("source_group")).alias("source_group"))
    layout = BB.write_parts(K.parsed_all(spark, sf_dir), K.deal(spark))
    return BB.backfill(spark, BB.write_targets(t, layout), layout, Q._curated(spark))[2]


_add("D4_unresolved_bucketed", q_unresolved_bucketed, lambda: O.REGISTRY["D4_backfill_unresolved"]())


def q_getnzb(spark, sf_dir):
    """Manifests of requested releases, half of which have no segments yet: segments told for each release."""
    p, pa = K.parsed(spark, sf_dir), K.parsed_all(spark, sf_dir)
    segs = ingest.collect_segments(p)
    rel = ingest.materialize(ingest.build_releases(p, segments=segs), "nzb_releases")
    asked = rel.where("id % 4 = 1 AND has_parts").select("id")
    lost = rel.where("id % 8 = 1").select("norm_title").distinct()
    nzb = BF.getnzb(rel, segs.join(lost, "norm_title", "left_anti"), pa, asked)
    n = F.length("nzb") - F.length(F.replace("nzb", F.lit("<segment "), F.lit("<segment")))
    return nzb.groupBy("id").agg(F.sum(n).cast("long").alias("n_segments"))


_add("J6_getnzb_backfilled", q_getnzb, lambda: with_ctes(O._backfill_ctes() + """,
asked AS (SELECT id, norm_title FROM releases WHERE id % 4 = 1 AND has_parts),
lost AS (SELECT DISTINCT norm_title FROM releases WHERE id % 8 = 1),
have AS (SELECT norm_title, message_id FROM segments WHERE norm_title NOT IN (SELECT norm_title FROM lost)
         UNION SELECT norm_title, message_id FROM bsegs WHERE id IN (SELECT id FROM asked WHERE norm_title IN (SELECT norm_title FROM lost)))""", """
SELECT asked.id, count(*) AS n_segments FROM asked JOIN have USING (norm_title) GROUP BY asked.id"""))


def q_expand_categories(spark, sf_dir):
    """H4 as a join: each release's category and its parent, expanded for a table of requests."""
    rel = K.releases(spark, sf_dir)
    cats = S.category_dimension(spark)
    req = rel.select(F.col("category").alias("req_id"), F.array("category", F.concat(F.substring("category", 1, 1), F.lit("000")), F.lit("99")).alias("ids")).distinct()
    return S.expand_categories_df(cats, req).select("req_id", F.array_join("ids", ",").alias("ids"))


def _expand_sql() -> str:
    from .. import config as C
    vals = ", ".join(f"('{i}', '{n}', {p})" for p, (i, n) in enumerate(C.DEFAULT_CATEGORIES))
    return with_ctes(releases_ctes() + f""",
cats AS (SELECT *, split_part(name, '/', 1) AS parent FROM (VALUES {vals}) t(id, name, pos)),
rq AS (SELECT DISTINCT category AS req_id FROM releases),
ex AS (SELECT req_id, 0 AS p, req_id AS cid FROM rq UNION ALL SELECT req_id, 1, req_id[1] || '000' FROM rq UNION ALL SELECT req_id, 2, '99' FROM rq),
kd AS (SELECT ex.req_id, p, coalesce(k.id, cid) AS id, coalesce(k.pos, 0) AS q FROM ex LEFT JOIN cats c ON c.id = ex.cid
       LEFT JOIN cats k ON k.parent = c.name AND NOT contains(c.name, '/')),
fs AS (SELECT req_id, id, min((p, q)) AS o FROM kd GROUP BY ALL)""", "SELECT req_id, string_agg(id, ',' ORDER BY o, id) AS ids FROM fs GROUP BY req_id")


_add("H4_expand_categories", q_expand_categories, _expand_sql)


# ---------------------------------------------------------------- configured hints

#: Entries of a hint file: new tokens, a default token with another key, two bad entries.
_HINT_FILE = [("repost", "movies_hd", 1), ("misc", "pc_0day", 2), ("hdtv", "tv_hd", 3), ("games", "console_psp", 4), ("", "tv", 5), ("misc", "no_such_key", 6)]


def _hinted(spark, sf_dir):
    """The hint file's rejects, and the parse of all headers under its hints."""
    path = table_path(spark, f"hints-{uuid.uuid4().hex[:12]}")
    entries = spark.createDataFrame(_HINT_FILE, "token string, key string, pos int")
    entries.agg(F.to_json(F.sort_array(F.collect_list(F.struct("pos", "token", "key"))))).coalesce(1).write.text(path)
    good, bad = policies.read_hints(spark, path)
    return bad, ingest.parsed_table(K.headers(spark, sf_dir), hints=policies.hints_from(spark, good))


def q_hinted_parse(spark, sf_dir):
    """A16 into B14, C2: headers parsed under configured group hints."""
    return _hinted(spark, sf_dir)[1].select("grp", "article_number", "message_id", "size", "norm_title", "category", "category_id", "extension")


def q_hinted_releases(spark, sf_dir):
    """A16 through E1 and A5: releases and sizes by category and group under configured hints, with the number of rejected entries."""
    bad, parsed = _hinted(spark, sf_dir)
    return ingest.fold_releases(parsed).groupBy("grp", "category_id").agg(
        F.count(F.lit(1)).alias("titles"), F.sum("size_sum").alias("size"), F.lit(bad.count()).cast("long").alias("rejects"))


def _hinted_ctes():
    return parsed_ctes(hints=C.Hints([*C.DEFAULT_GROUP_HINTS, *((t, k) for t, k, _ in _HINT_FILE[:4])]))


_add("A16_hinted_parse", q_hinted_parse, lambda: with_ctes(_hinted_ctes(), """
SELECT grp, article_number, message_id, size, norm_title, category, category_id, extension FROM parsed"""))
_add("A16_hinted_releases", q_hinted_releases, lambda: with_ctes(_hinted_ctes() + """,
folded AS (
  SELECT grp, (arg_min(struct_pack(c := category_id), (article_number, message_id, bytes))).c AS category_id, sum(size) AS size
  FROM parsed GROUP BY grp, dedupe_key)""", """
SELECT grp, category_id, count(*) AS titles, CAST(sum(size) AS BIGINT) AS size, CAST(2 AS BIGINT) AS rejects
FROM folded GROUP BY grp, category_id"""))
