"""Oracle SQL (DuckDB) for the registered queries, keyed like ``queries.REGISTRY``."""

from __future__ import annotations

from .oracle_sql import headers_ctes, parsed_ctes, releases_ctes, search_tokens_sql, ts_text, with_ctes  # noqa: F401


def headers_ctes_only() -> str:
    return headers_ctes()

AS_OF = "2001-12-31 00:00:00"


def _pub_date(col: str) -> str:
    return f"strftime(coalesce({col}, TIMESTAMP '{AS_OF}'), '%a, %d %b %Y %H:%M:%S +0000')"


def sql_parse_headers() -> str:
    return with_ctes(parsed_ctes(), f"""
SELECT grp, article_number, message_id, size, norm_title, array_to_string(tags, '|') AS tags, language, category,
  category_id, extension, seg_number, seg_id, dedupe_key, {ts_text('posted_at')} AS posted_at
FROM parsed""")


def sql_fold_releases() -> str:
    return with_ctes(releases_ctes(), f"""
SELECT grp, dedupe_key, category, category_id, language, extension, array_to_string(tags, ',') AS tags,
  size_sum, n_headers, {ts_text('posted_at')} AS posted_at
FROM candidates""")


def sql_collect_segments() -> str:
    return with_ctes(releases_ctes(), """
SELECT norm_title, s.number AS number, message_id, s."group" AS "group", s.size AS size FROM segments""")


def sql_build_releases() -> str:
    return with_ctes(releases_ctes(), f"""
SELECT norm_title, category, category_id, language, tags, extension, source_group, size_bytes,
  {ts_text('posted_at')} AS posted_at, has_parts, part_count, bucket, CAST(posted_year AS INTEGER) AS posted_year,
  array_to_string(search_tokens, ' ') AS search_tokens
FROM releases""")


def _page_sql(where: str = "", sort: str = "posted_at", limit: int = 100, offset: int = 0) -> str:
    cond = "has_parts AND size_bytes > 0" + (f" AND {where}" if where else "")
    return with_ctes(releases_ctes(), f"""
SELECT norm_title, category, category_id, size_bytes, {ts_text('posted_at')} AS posted_at,
  {_pub_date('posted_at')} AS pub_date
FROM releases WHERE {cond}
ORDER BY {sort} DESC NULLS FIRST, norm_title, category_id
LIMIT {limit} OFFSET {offset}""")


def sql_search_newest() -> str:
    return _page_sql()


REGISTRY = {
    "B_parse_headers": sql_parse_headers,
    "E1_fold_releases": sql_fold_releases,
    "E2_collect_segments": sql_collect_segments,
    "A5_build_releases": sql_build_releases,
    "J1_search_newest": sql_search_newest,
}


# ---------------------------------------------------------------- search variants
from .. import config as C  # noqa: E402
from ..operators.search import query_tokens  # noqa: E402
from .oracle_sql import min_size_sql, q  # noqa: E402
from .queries import PRUNE_POLICY  # noqa: E402


def _tokens_where(text: str) -> str:
    toks = list(dict.fromkeys(query_tokens(text)))
    return " AND ".join(f"list_contains(search_tokens, {q(t)})" for t in toks) or "false"


def _cats(ids) -> str:
    return "category IN (" + ", ".join(q(i) for i in ids) + ")"


def _ids(parent):
    return [i for i, n in C.DEFAULT_CATEGORIES if n.split("/", 1)[0] == parent]


REGISTRY.update({
    "C5_search_text": lambda: _page_sql(_tokens_where("Widget, small!"), sort="size_bytes"),
    "C6_title_contains": lambda: _page_sql("norm_title ILIKE '%gear%'", sort="norm_title"),
    "C8_tag_prefix_page2": lambda: _page_sql("tags LIKE 's%'", limit=50, offset=50),
    "J2_tvsearch": lambda: _page_sql(_cats(_ids("TV"))),
    "J3_movie": lambda: _page_sql(_cats(_ids("Movies"))),
    "J4_music": lambda: _page_sql(_cats(_ids("Audio"))),
    "J5_book": lambda: _page_sql(_cats(_ids("EBook"))),
})


def _items_cte(where: str, limit: int = 100) -> str:
    return releases_ctes() + f""",
page AS (
  SELECT * FROM releases WHERE has_parts AND size_bytes > 0 AND {where}
  ORDER BY posted_at DESC NULLS FIRST, norm_title, category_id LIMIT {limit}
),
items AS (
  SELECT coalesce(norm_title, '') AS title, CAST(id AS VARCHAR) AS guid, {_pub_date('posted_at')} AS "pubDate",
    coalesce(category, '') AS category,
    '/api?t=getnzb&id=' || url_encode(CAST(id AS VARCHAR)) || '&apikey=' || url_encode('k y') AS link,
    CAST(size_bytes AS VARCHAR) AS size
  FROM page WHERE size_bytes > 0
)"""


def sql_movie_placeholder() -> str:
    body = f"""
SELECT title, guid, "pubDate", category, link, size FROM items
UNION ALL
SELECT 'Indexer Test Item', '0', {_pub_date('CAST(NULL AS TIMESTAMP)')}, '2060', '/api?t=getnzb&id=0', '1'
WHERE (SELECT count(*) FROM items) = 0"""
    return with_ctes(_items_cte("category IN ('2060')"), body)


def sql_feed_items() -> str:
    return with_ctes(_items_cte("true"), 'SELECT title, guid, "pubDate", category, link, size FROM items')


def sql_caps() -> str:
    vals = ", ".join(f"({q(i)}, {q(n)})" for i, n in C.DEFAULT_CATEGORIES)
    return with_ctes(releases_ctes() + f""",
cats AS (SELECT * FROM (VALUES {vals}) t(id, name))""", """
SELECT id, name, split_part(name, '/', 1) AS parent FROM cats WHERE id IN (SELECT category FROM releases)""")


def _rel_cols_sql(where: str) -> str:
    return with_ctes(releases_ctes(), f"""
SELECT norm_title, category_id, size_bytes, extension, source_group, {ts_text('posted_at')} AS posted_at
FROM releases WHERE coalesce({where}, false)""")


def sql_prune_sizes() -> str:
    ms = min_size_sql("norm_title", "category_id", PRUNE_POLICY)
    return _rel_cols_sql(f"(({ms}) > 0 AND coalesce(size_bytes, 0) < ({ms})) OR coalesce(size_bytes, 0) > {PRUNE_POLICY.max_size}")


def sql_prune_partitions() -> str:
    drop = f"bucket <> {q(C.OTHER_BUCKET)} AND posted_year IS NOT NULL AND posted_year < 1998"
    trim = f"bucket <> {q(C.OTHER_BUCKET)} AND NOT ({drop}) AND posted_at IS NOT NULL AND posted_at < TIMESTAMP '1998-05-15'"
    return with_ctes(releases_ctes(), f"""
SELECT bucket, CAST(posted_year AS INTEGER) AS posted_year, CASE WHEN coalesce({drop}, false) THEN 'drop' ELSE 'trim' END AS action,
  count(*) AS rows_deleted
FROM releases WHERE coalesce({drop}, false) OR coalesce({trim}, false) GROUP BY ALL""")


def sql_drop_empty() -> str:
    buckets = ", ".join(f"({q(b)})" for b, _, _ in C.CATEGORY_BUCKETS)
    return with_ctes(releases_ctes(), f"""
SELECT b.bucket, CAST(y.posted_year AS INTEGER) AS posted_year
FROM (VALUES {buckets}) b(bucket) CROSS JOIN (SELECT range AS posted_year FROM range(1990, 2006)) y
WHERE NOT EXISTS (SELECT 1 FROM releases r WHERE r.bucket = b.bucket AND r.posted_year = y.posted_year)
  AND NOT (b.bucket = 'movies' AND y.posted_year = 1990)""")


def sql_category_audit() -> str:
    from .oracle_sql import category_sql, generic_tags_sql, hint_key_sql
    pseudo = ("trim(concat_ws(' ', coalesce(norm_title, ''), array_to_string(list_transform(list_filter("
              "string_split(coalesce(tags, ''), ','), lambda t: t <> ''), lambda t: '[' || t || ']'), ' ')))")
    return with_ctes(releases_ctes() + f""",
aud0 AS MATERIALIZED (SELECT category_id, {pseudo} AS text, {hint_key_sql("coalesce(source_group, 'None')")} AS hint FROM releases),
aud1 AS MATERIALIZED (SELECT category_id, hint, lower(text) AS low, {generic_tags_sql("text")} AS gt FROM aud0),
aud AS (SELECT category_id, {category_sql("low", "gt", "hint", "NULL")} AS expected FROM aud1)""", """
SELECT category_id, count(*) AS checked,
  CAST(sum(CASE WHEN expected IS NULL OR category_id = CAST(expected AS INTEGER) THEN 0 ELSE 1 END) AS BIGINT) AS mismatches
FROM aud GROUP BY category_id""")


REGISTRY.update({
    "H5_movie_placeholder": sql_movie_placeholder,
    "A13_feed_items": sql_feed_items,
    "J7_caps": sql_caps,
    "I1_prune_filetypes": lambda: _rel_cols_sql(
        "extension IS NOT NULL AND lower(extension) NOT IN (" + ", ".join(q(e) for e in C.prune_extensions()) + ")"),
    "I2_prune_sizes": sql_prune_sizes,
    "I3_prune_old": lambda: _rel_cols_sql(f"posted_at < TIMESTAMP '{AS_OF}' - INTERVAL 1500 DAY"),
    "I4_prune_partitions": sql_prune_partitions,
    "I5_prune_group": lambda: _rel_cols_sql("source_group = 'alt.binaries.misc'"),
    "I6_prune_non_curated": lambda: _rel_cols_sql(
        "source_group IS NULL OR source_group = '' OR source_group NOT IN ('alt.binaries.movies', 'alt.binaries.tv')"),
    "A6_partition_counts": lambda: with_ctes(releases_ctes(), """
SELECT bucket, CAST(posted_year AS INTEGER) AS posted_year, count(*) AS n FROM releases GROUP BY ALL"""),
    "E10_partition_years": lambda: with_ctes(releases_ctes(), """
SELECT DISTINCT bucket, CAST(posted_year AS INTEGER) AS posted_year FROM releases WHERE posted_year IS NOT NULL"""),
    "A8_drop_empty_partitions": sql_drop_empty,
    "E8_category_audit": sql_category_audit,
    "E9_segment_summary": lambda: with_ctes(releases_ctes(), """
SELECT norm_title, count(*) AS segments, arg_min(message_id, (s.number, message_id)) AS first_message_id,
  arg_max(message_id, (s.number, message_id)) AS last_message_id
FROM segments GROUP BY norm_title"""),
})


# ---------------------------------------------------------------- backfill
def _backfill_ctes(lookback: int = 0) -> str:
    lb = "" if lookback <= 0 else f"AND article_number > (SELECT max(article_number) FROM parsed_all x WHERE x.grp = parsed_all.grp) - {lookback}"
    return releases_ctes() + """,
tg AS (
  SELECT id, norm_title, source_group AS grp,
    lower(CASE WHEN regexp_matches(norm_title, '^(.*):(\\d{4}-\\d{2}-\\d{2})$')
      THEN regexp_extract(norm_title, '^(.*):(\\d{4}-\\d{2}-\\d{2})$', 1) ELSE norm_title END) AS title,
    CASE WHEN regexp_matches(norm_title, '^(.*):(\\d{4}-\\d{2}-\\d{2})$')
      THEN regexp_extract(norm_title, '^(.*):(\\d{4}-\\d{2}-\\d{2})$', 2) END AS day
  FROM releases
),
parts AS (
  SELECT grp, lower(norm_title) AS title, strftime(posted_at, '%Y-%m-%d') AS day, seg_number AS number,
    arg_min(struct_pack(message_id := seg_id, size := size), (article_number, message_id, bytes)) AS p
  FROM parsed_all WHERE size > 0 AND seg_id IS NOT NULL """ + lb + """ GROUP BY ALL
),
bsegs AS (
  SELECT t.id, t.norm_title, p.number, p.p.message_id AS message_id, p.p.size AS size
  FROM tg t JOIN parts p ON t.grp = p.grp AND t.title = p.title AND t.day IS NOT DISTINCT FROM p.day
),
filled AS (
  SELECT id, norm_title, CAST(count(*) AS INTEGER) AS part_count, CAST(sum(size) AS BIGINT) AS size_bytes
  FROM bsegs GROUP BY id, norm_title
)"""


REGISTRY.update({
    "D3_backfill_match": lambda: with_ctes(_backfill_ctes(), "SELECT id, norm_title, part_count, size_bytes FROM filled"),
    "D4_backfill_unresolved": lambda: with_ctes(releases_ctes() + """,
tgt AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'renamed ' || norm_title ELSE norm_title END AS norm_title, id % 2 = 0 AS own_group, source_group FROM releases),
seen AS (SELECT DISTINCT grp, lower(norm_title) AS title, strftime(posted_at, '%Y-%m-%d') AS day FROM parsed_all WHERE size > 0 AND seg_id IS NOT NULL),
tk AS (SELECT *, lower(regexp_replace(norm_title, ':(\\d{4}-\\d{2}-\\d{2})$', '')) AS title,
         nullif(regexp_extract(norm_title, ':(\\d{4}-\\d{2}-\\d{2})$', 1), '') AS day FROM tgt)""", """
SELECT id, norm_title FROM tk WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.title = tk.title AND seen.day IS NOT DISTINCT FROM tk.day
  AND (NOT own_group OR seen.grp = tk.source_group))"""),
    "G5_lookback": lambda: with_ctes(releases_ctes() + """,
hi AS (SELECT grp, max(article_number) AS hi FROM parsed_all GROUP BY grp)""", """
SELECT p.grp, count(*) AS headers, min(article_number) AS first_article
FROM parsed_all p JOIN hi ON p.grp = hi.grp WHERE article_number > hi - 10000 GROUP BY p.grp"""),
})


# ---------------------------------------------------------------- outputs
def _esc(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _status_ctes(cap: int) -> str:
    return releases_ctes() + f""",
st AS (
  SELECT norm_title, count(*) AS n_segments,
    sum(CASE WHEN s.number IS NULL OR s.size IS NULL OR message_id IS NULL OR message_id = ''
             OR regexp_matches(message_id, '[<>]') THEN 1 ELSE 0 END) AS n_invalid
  FROM segments GROUP BY norm_title
),
status AS (
  SELECT r.id, r.norm_title, r.category_id, coalesce(st.n_segments, 0) AS n_segments,
    CASE WHEN coalesce(st.n_segments, 0) = 0 THEN 'no_segments' WHEN st.n_invalid > 0 THEN 'invalid'
         WHEN st.n_segments > {cap} THEN 'over_limit' ELSE 'ok' END AS status
  FROM rel1 r LEFT JOIN st ON r.norm_title = st.norm_title
  WHERE NOT r.has_parts OR r.size_bytes >= {min_size_sql("r.norm_title", "r.category_id")}
)"""


def sql_manifest() -> str:
    seg = ("'<segment bytes=\"' || CAST(s.size AS VARCHAR) || '\" number=\"' || CAST(s.number AS VARCHAR) || '\">' || "
           + _esc("message_id") + " || '</segment>'")
    return with_ctes(_status_ctes(10 ** 9) + f""",
ok AS (SELECT id, norm_title FROM status WHERE status = 'ok'),
sg AS MATERIALIZED (SELECT ok.id, s.number AS number, CAST(floor(s.number / 1000) AS INTEGER) AS part, g.message_id, s."group" AS grp, {seg} AS x
       FROM segments g JOIN ok ON g.norm_title = ok.norm_title),
gr AS (SELECT id, grp, min((number, message_id)) AS o FROM sg WHERE coalesce(grp, '') <> '' GROUP BY id, grp),
gl AS (SELECT id, string_agg('<group>' || {_esc('grp')} || '</group>', '' ORDER BY o) AS groups FROM gr GROUP BY id),
la AS (SELECT id, max(part) AS last FROM sg GROUP BY id)""", f"""
SELECT la.id, -1 AS part, '<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10) || '<nzb xmlns="http://www.newzbin.com/DTD/2003/nzb"><file subject="'
  || CAST(la.id AS VARCHAR) || '"><groups>' || coalesce(groups, '') || '</groups><segments>' AS nzb FROM la LEFT JOIN gl USING (id)
UNION ALL
SELECT sg.id, part, string_agg(x, '' ORDER BY number, message_id) || CASE WHEN part = last THEN '</segments></file></nzb>' ELSE '' END
FROM sg JOIN la USING (id) GROUP BY sg.id, part, last""")


def _legacy_ctes() -> str:
    """Entries of the legacy fixture, by its own rules: list form for odd counts, old kinds by title length."""
    return releases_ctes() + """,
lg AS (
  SELECT norm_title, row_number() OVER (PARTITION BY norm_title ORDER BY s.number, message_id) - 1 AS pos,
    s.number AS number, message_id, s."group" AS grp, s.size AS size,
    count(*) OVER (PARTITION BY norm_title) % 2 = 1 AS list_form, length(norm_title) % 5 AS kind
  FROM segments),
en AS (
  SELECT *, CASE WHEN list_form THEN false ELSE kind IN (0, 4) END AS valid,
    CASE WHEN list_form THEN kind <> 4 ELSE kind <> 2 END AS convertible,
    CASE WHEN NOT list_form AND kind = 3 THEN 0 ELSE size END AS out_size
  FROM lg)"""


def sql_decode_segments() -> str:
    return with_ctes(_legacy_ctes(), """
SELECT norm_title, CAST(pos AS INTEGER) AS pos, CASE WHEN convertible THEN CAST(number AS BIGINT) END AS number,
  CASE WHEN convertible THEN message_id END AS message_id, CASE WHEN convertible THEN coalesce(grp, '') END AS "group",
  CASE WHEN convertible THEN out_size END AS size, valid, convertible FROM en""")


def sql_repair_segments() -> str:
    return with_ctes(_legacy_ctes(), """
SELECT norm_title, CAST(pos AS INTEGER) AS pos, CAST(number AS BIGINT) AS number, message_id, coalesce(grp, '') AS "group", out_size AS size
FROM en WHERE norm_title IN (SELECT norm_title FROM en GROUP BY norm_title HAVING NOT bool_and(valid) AND bool_and(convertible))""")


def _table_sql(bucket: bool) -> str:
    return with_ctes(releases_ctes(), f"""
SELECT norm_title, category_id, size_bytes, part_count, has_parts, {ts_text('posted_at')} AS posted_at{', bucket' if bucket else ''} FROM releases""")


def sql_renormalize() -> str:
    from .oracle_sql import normalize_sql
    return with_ctes(parsed_ctes() + f""",
st AS MATERIALIZED (
  SELECT (grp, article_number, message_id, size, subject) AS id, lower(regexp_replace(subject, '\\s*\\(\\d+/\\d+\\).*$', '')) AS raw,
    strftime(posted_at, '%Y-%m-%d') AS day, category, language, tags, source_group, size, posted_at FROM parsed),
rn AS MATERIALIZED (SELECT *, {normalize_sql("raw")} || coalesce(':' || day, '') AS new_title FROM st),
tg AS (SELECT new_title, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags
       FROM (SELECT new_title, unnest(string_split(array_to_string(tags, ','), ',')) AS tag FROM rn) WHERE tag <> '' GROUP BY new_title)""", f"""
SELECT rn.new_title, arg_min(category, id) FILTER (coalesce(category, '') <> '') AS category, arg_min(language, id) FILTER (coalesce(language, '') <> '') AS language,
  arg_min(source_group, id) FILTER (coalesce(source_group, '') <> '') AS source_group, CAST(sum(size) AS BIGINT) AS size_bytes, count(*) AS merged_rows,
  coalesce(any_value(tg.tags), '') AS tags, {ts_text('min(posted_at)')} AS posted_at
FROM rn LEFT JOIN tg USING (new_title) GROUP BY rn.new_title""")


def sql_language_profile() -> str:
    return """
WITH d AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' AS s FROM documents),
g AS MATERIALIZED (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, s[i:i + 2] AS gram FROM (
  SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM d WHERE length(s) >= 3)) WHERE NOT contains(gram, '  ') GROUP BY ALL),
lg AS MATERIALIZED (SELECT lang, gram, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE lang IS NOT NULL AND doc_id % 4 <> 0 GROUP BY ALL),
k AS (SELECT count(DISTINCT gram) AS kinds FROM lg),
t AS (SELECT lang, sum(n) + any_value(kinds) AS base FROM lg, k GROUP BY lang),
p AS (SELECT lang, gram, ln((n + 1) / base) - ln(1 / base) AS gain FROM lg JOIN t USING (lang)),
z AS (SELECT doc_id, sum(n) AS size FROM g GROUP BY doc_id),
sc AS (SELECT doc_id, lang, sum(n * gain) + any_value(size) * ln(1 / any_value(base)) AS score
       FROM g JOIN p USING (gram) JOIN t USING (lang) JOIN z USING (doc_id) GROUP BY doc_id, lang)
SELECT documents.doc_id, documents.lang, b.predicted FROM documents LEFT JOIN (
  SELECT doc_id, arg_min(lang, (-score, lang)) AS predicted FROM sc GROUP BY doc_id) b USING (doc_id)"""


def sql_size_lookup() -> str:
    return with_ctes(headers_ctes_only() + """,
sz AS (SELECT '<' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '@x>' AS message_id,
         max(CAST(trunc(l_quantity) AS BIGINT) * 1000) AS size FROM lineitem WHERE l_partkey % 100 = 0 GROUP BY 1)""", """
SELECT grp, count(*) AS headers, count(*) FILTER (bytes <= 0) AS without_bytes,
  count(*) FILTER (CASE WHEN bytes > 0 THEN bytes ELSE coalesce(sz.size, 0) END > 0) AS with_size,
  CAST(sum(CASE WHEN bytes > 0 THEN bytes ELSE coalesce(sz.size, 0) END) AS BIGINT) AS size
FROM headers LEFT JOIN sz USING (message_id) GROUP BY grp""")


REGISTRY.update({
    "B19_decode_segments": sql_decode_segments,
    "I7_repair_segments": sql_repair_segments,
    "A5_upsert_increment": lambda: _table_sql(True),
    "K1_stream_ingest": lambda: _table_sql(False),
    "E3_renormalize_merge": sql_renormalize,
    "B9_language_profile": sql_language_profile,
    "B2_size_lookup": sql_size_lookup,
})


REGISTRY.update({
    "A11_segment_status": lambda: with_ctes(_status_ctes(3), "SELECT id, norm_title, category_id, n_segments, status FROM status"),
    "A10_manifest": sql_manifest,
})


# ---------------------------------------------------------------- groups / metrics
from .queries import CURATED  # noqa: E402


def _group_list_sql(valid: bool) -> str:
    pat = q(C.GROUP_NAME_PATTERN)
    body = f"""
WITH t AS (
  SELECT n.n_nationkey AS src_pos,
    'alt.binaries.' || lower(n.n_name) || ', alt.binaries.' || lower(r.r_name) || chr(10) AS text
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
a AS (SELECT src_pos, string_split_regex(text, '[,\\n]') AS arr FROM t),
p AS (SELECT src_pos, i - 1 AS idx, trim(arr[i]) AS name FROM a, LATERAL (SELECT unnest(generate_series(1, len(arr))) AS i))
"""
    if valid:
        return body + f"""SELECT name, arg_min(src_pos, (src_pos, idx)) AS src_pos, arg_min(idx, (src_pos, idx)) AS idx
FROM p WHERE name <> '' AND regexp_matches(name, {pat}) GROUP BY name"""
    return body + f"SELECT name, src_pos, idx FROM p WHERE name <> '' AND NOT regexp_matches(name, {pat})"


def _curated_sql() -> str:
    return "(VALUES " + ", ".join(f"({q(g)}, {i})" for i, g in enumerate(CURATED)) + ") c(name, pos)"


def _metrics_ctes() -> str:
    return releases_ctes() + """,
proc AS (SELECT grp, CAST(floor(article_number / 1000) AS BIGINT) AS batch, count(*) AS processed,
         max(article_number) AS cursor FROM parsed_all GROUP BY ALL),
fst AS (SELECT grp, dedupe_key, min(CAST(floor(article_number / 1000) AS BIGINT)) AS batch FROM parsed GROUP BY ALL),
ins AS (SELECT grp, batch, count(*) AS inserted FROM fst GROUP BY ALL),
hw AS (SELECT grp, max(article_number) AS high_water FROM parsed_all GROUP BY grp),
m AS (
  SELECT p.grp, p.batch, processed, coalesce(inserted, 0) AS inserted, processed - coalesce(inserted, 0) AS deduplicated,
    cursor, high_water, greatest(high_water - cursor, 0) AS remaining,
    CASE WHEN high_water > 0 THEN CAST(floor(cursor * 100 / high_water) AS BIGINT) END AS percent_complete
  FROM proc p LEFT JOIN ins i ON p.grp = i.grp AND p.batch = i.batch JOIN hw ON p.grp = hw.grp
)"""


def _counters(where: str) -> str:
    k = "json_extract_string(props, '$.k')"
    return f"""SELECT CASE WHEN {k} IS NULL THEN event_type ELSE event_type || '{{k=' || {k} || '}}' END AS key,
  count(*) AS value FROM events {where} GROUP BY 1"""


REGISTRY.update({
    "A15_group_list_clean": lambda: _group_list_sql(True),
    "A15_group_list_rejects": lambda: _group_list_sql(False),
    "H1_group_intersection": lambda: with_ctes(headers_ctes_only(), f"""
SELECT name, pos FROM {_curated_sql()} WHERE name IN (SELECT grp FROM headers)"""),
    "H2_group_missing": lambda: with_ctes(headers_ctes_only(), f"""
SELECT name, row_number() OVER (ORDER BY name) AS rank FROM {_curated_sql()} WHERE name NOT IN (SELECT grp FROM headers)"""),
    "E5_batch_metrics": lambda: with_ctes(_metrics_ctes(), "SELECT * FROM m"),
    "E6_ingest_summary": lambda: with_ctes(_metrics_ctes(), """
SELECT batch, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(inserted) AS BIGINT) AS inserted,
  CAST(sum(remaining) AS BIGINT) AS remaining, count(*) AS groups FROM m GROUP BY batch"""),
    "E7_changed_counters": lambda: f"""
WITH prev AS ({_counters("WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")}), cur AS ({_counters("")})
SELECT cur.key, cur.value FROM cur LEFT JOIN prev ON cur.key = prev.key WHERE cur.value IS DISTINCT FROM prev.value""",
    "E11_rate_window_counts": lambda: f"""
SELECT {ts_text("date_trunc('hour', ts)")} AS window_start, user_id, count(*) AS n, count(*) > 1 AS over_limit
FROM events GROUP BY date_trunc('hour', ts), user_id""",
    "E12_ingest_freshness": lambda: with_ctes(releases_ctes(), f"""
SELECT grp, {ts_text('max(posted_at)')} AS last_run, date_diff('second', max(posted_at), TIMESTAMP '{AS_OF}') AS age_seconds,
  max(posted_at) IS NULL OR date_diff('second', max(posted_at), TIMESTAMP '{AS_OF}') > 600 AS stale
FROM parsed_all GROUP BY grp"""),
})

REGISTRY["K6_rate_window_stream"] = REGISTRY["E11_rate_window_counts"]

REGISTRY.update({
    "K2_group_progress": lambda: with_ctes(headers_ctes_only(), """
SELECT grp, max(article_number) AS last_article FROM headers GROUP BY grp"""),
    "K5_poll_seconds": lambda: with_ctes(_metrics_ctes() + """,
sm AS (SELECT batch, sum(processed) AS p, sum(remaining) AS r FROM m GROUP BY batch)""", """
SELECT batch, CAST(CASE WHEN r <= 0 THEN 60.0 WHEN p <= 0 THEN 5.0 ELSE 5 + 55 * (1 - r / (p + r)) END AS DOUBLE) AS poll_seconds FROM sm"""),
    "I2_prune_sizes_written": lambda: with_ctes(releases_ctes(), f"""
SELECT bucket, CAST(posted_year AS INTEGER) AS posted_year, count(*) AS n FROM releases
WHERE NOT coalesce((({min_size_sql("norm_title", "category_id", PRUNE_POLICY)}) > 0 AND coalesce(size_bytes, 0) < ({min_size_sql("norm_title", "category_id", PRUNE_POLICY)}))
  OR coalesce(size_bytes, 0) > {PRUNE_POLICY.max_size}, false) GROUP BY ALL"""),
    "I4_prune_partitions_written": lambda: with_ctes(releases_ctes(), f"""
SELECT bucket, CAST(posted_year AS INTEGER) AS posted_year, count(*) AS n FROM releases
WHERE NOT coalesce(bucket <> {q(C.OTHER_BUCKET)} AND posted_at < TIMESTAMP '1998-05-15', false) GROUP BY ALL"""),
})


# ---------------------------------------------------------------- feeds, upgrade, logs
def _html(c: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


def sql_feed_xml() -> str:
    elements = " || ".join(f"'<{e}>' || {_html(f'\"{e}\"')} || '</{e}>'" for e in ("title", "guid", "pubDate", "category", "link"))
    return with_ctes(_items_cte("true") + """,
it AS (SELECT * REPLACE (CASE WHEN size LIKE '%1000' THEN 'n/a' ELSE size END AS size) FROM items)""", f"""
SELECT 0 AS part, '<rss version="2.0"><channel><title>a &lt;feed&gt; &amp; more</title><link>/</link><description>feed</description><language>en</language><pubDate>Mon, 31 Dec 2001 00:00:00 +0000</pubDate>' AS xml
UNION ALL
SELECT row_number() OVER (ORDER BY title, guid), '<item>' || {elements}
  || CASE WHEN regexp_matches(size, '^[0-9]+$') AND CAST(size AS BIGINT) > 0
     THEN '<enclosure url="' || {_html('link')} || '" type="application/x-nzb" length="' || size || '"/>' ELSE '' END
  || '<attr name="size" value="' || size || '"/>' || CASE WHEN category <> '' THEN '<attr name="category" value="' || category || '"/>' ELSE '' END || '</item>' FROM it
UNION ALL SELECT 2147483647, '</channel></rss>'""")


REGISTRY.update({
    "A13_feed_xml": sql_feed_xml,
    "A9_conform_releases": lambda: with_ctes(releases_ctes(), """
SELECT norm_title, CASE WHEN id % 7 = 0 THEN category || 'x' ELSE category END AS category,
  CASE WHEN id % 7 <> 0 THEN CAST(category AS INTEGER) END AS category_id, CASE WHEN id % 3 = 0 THEN language ELSE 'und' END AS language,
  '' AS tags, false AS has_parts, CASE WHEN id % 2 = 0 THEN part_count ELSE 0 END AS part_count, CAST(NULL AS VARCHAR) AS extension,
  CAST(NULL AS VARCHAR) AS posted_at FROM releases"""),
    "B26_redact_log": lambda: """
WITH l AS (SELECT event_id, event_type, repeat(coalesce(props, ''), CAST(event_id % 40 AS INTEGER)) AS q FROM events)
SELECT event_id, '[redacted]' AS cookie, event_type AS kind, CAST(length(q) AS INTEGER) AS query_length,
  md5(CASE WHEN length(q) > 256 THEN left(q, 256) || '…' ELSE q END) AS shown FROM l""",
})
