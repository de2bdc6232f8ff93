"""DuckDB oracle SQL for the registered queries.

Built from the same configuration constants as the Spark column functions,
as plain SQL over the driver's tables, so the correctness gate compares two
independent evaluations (Spark/Java regex vs DuckDB/RE2) of one definition.
Only ASCII inputs reach the regexes, where both dialects agree.
"""

from __future__ import annotations

import re

from .. import config as C
from ..functions import tags as tg
from ..sources.headers import FIXTURE_GROUPS, REPOST_GROUP


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _alts(xs) -> str:
    return "|".join(re.escape(x) for x in xs)


def _contains_any(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(n)})" for n in needles) + ")"


# ---------------------------------------------------------------- headers

def _subject_sql() -> str:
    ln = "CAST(l_linenumber AS VARCHAR)"
    name = "replace(p_name, ' ', '.')"
    tag = "'[' || p_type || '] '"
    part = f"'.part0' || {ln} || '.rar (' || {ln} || '/7)'"
    return f"""CASE l_orderkey % 16
      WHEN 1 THEN {tag} || {name} || '.S01E02.720p' || {part} || ' yEnc'
      WHEN 2 THEN '[FRENCH] ' || {name} || {part} || ' yEnc'
      WHEN 3 THEN {name} || '-Greatest-2021-FLAC-320' || {part}
      WHEN 4 THEN {name} || '-Title-2020-EPUB-1234567890' || {part}
      WHEN 5 THEN {tag} || {name} || {part} || ' repost yEnc'
      WHEN 7 THEN {tag} || p_name || ' (' || {ln} || '/7)'
      WHEN 8 THEN 'Studio.' || {name} || '.2022.1080p' || {part}
      WHEN 9 THEN '[tv] ' || {name} || {part} || ' yEnc'
      ELSE {tag} || {name} || {part} || ' yEnc' END"""


def headers_ctes() -> str:
    groups = "[" + ", ".join(q(g) for g in FIXTURE_GROUPS) + "]"
    return f"""
hj AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice, o.o_orderdate, p.p_name, p.p_type
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
),
hb AS (
  SELECT 'alt.binaries.' || ({groups})[CAST(l_suppkey % 8 AS INTEGER) + 1] AS grp,
    CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS article_number,
    '<' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) || '.' || CAST(l_partkey AS VARCHAR)
      || '.' || CAST(l_suppkey AS VARCHAR) || '@x>' AS message_id,
    {_subject_sql()} AS subject,
    CASE WHEN l_partkey % 50 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(l_extendedprice) AS BIGINT) * 1000 END AS bytes,
    CASE WHEN l_orderkey % 16 = 6 THEN NULL
      ELSE strftime(date_trunc('quarter', o_orderdate), '%a, %d %b %Y %H:%M:%S +0000') END AS date,
    l_suppkey % 8 AS gi
  FROM hj
),
headers AS (
  SELECT grp, article_number, message_id, subject, bytes, date FROM hb
  UNION ALL
  SELECT {q(REPOST_GROUP)}, article_number * 8 + gi, message_id, subject, bytes, date FROM hb WHERE article_number % 20 = 0
)"""


# ---------------------------------------------------------------- column SQL

def clean(col: str) -> str:
    return f"replace(replace({col}, chr(0), ''), chr(65533), '')"


def normalize_sql(col: str) -> str:
    s = f"translate({col}, '._', '  ')"
    s = f"regexp_replace({s}, '\\[[^\\[\\]]+\\]', '', 'g')"
    s = f"regexp_replace({s}, '(?i)\\byenc\\b', '', 'g')"
    s = f"regexp_replace({s}, '[\\(\\[]\\s*\\d+\\s*/\\s*\\d+\\s*[\\)\\]]', '', 'g')"
    s = f"regexp_replace({s}, {q('(?i)' + _alts([t for t, _ in C.LANGUAGE_TOKENS]))}, '', 'g')"
    s = f"regexp_replace({s}, '(?i)\\b(?:repost|sample)\\b', '', 'g')"
    s = f"regexp_replace({s}, '(?i)\\bpart\\s*\\d+\\b', '', 'g')"
    s = f"regexp_replace({s}, '(?i)\\b(rar|par2|zip)\\b', '', 'g')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    s = f"regexp_replace({s}, '^[- ]+|[- ]+$', '', 'g')"
    return f"lower({s})"


def generic_tags_sql(col: str) -> str:
    parts = f"flatten(list_transform(regexp_extract_all({col}, '\\[([^\\[\\]]+)\\]', 1), lambda g: string_split_regex(g, '[\\s,]+')))"
    return f"list_filter(list_transform({parts}, lambda t: lower(trim(t))), lambda t: t <> '')"


def _grp(col: str, pattern: str, idx: int, dots: bool = True) -> str:
    v = f"regexp_extract({col}, {q(pattern)}, {idx})"
    if dots:
        v = f"translate({v}, '.', ' ')"
    return f"nullif({v}, '')"


def extract_columns_sql(col: str) -> str:
    """Every regex of the tag extractors once, as columns gt, m1..m5, b1..b5, st, sx, x1..x3."""
    low = f"lower({col})"
    M, B, S, T = tg.MUSIC_RE, tg.BOOK_RE, tg.STUDIO_RE, tg.SITE_RE
    out = [f"{low} AS low", f"{generic_tags_sql(col)} AS gt"]
    for name, pattern, gate in (("m", M, C.AUDIO_EXTENSIONS), ("b", B, C.BOOK_EXTENSIONS)):
        ok = _contains_any(low, [e.lower() for e in gate])
        out += [f"CASE WHEN {ok} THEN {_grp(col, pattern, k)} END AS {name}{k}" for k in range(1, 6)]
    out += [f"{_contains_any(low, C.STUDIO_GATES)} AS gx", f"regexp_matches({col}, {q(S)}) AS st", f"regexp_matches({col}, {q(T)}) AS si",
            f"{_grp(col, S, 1)} AS s1", f"{_grp(col, S, 2, False)} AS s2", f"{_grp(col, S, 3, False)} AS s3",
            f"{_grp(col, T, 1)} AS t1", f"{_grp(col, T, 2, False)} AS t2"]
    return ",\n    ".join(out)


def subject_tags_sql() -> str:
    """The combined tag list from the columns of ``extract_columns_sql``."""
    b = {k: f"CASE WHEN b3 IS NOT NULL THEN {'upper(b4)' if k == 4 else f'b{k}'} END" for k in range(1, 6)}
    with_m = f"[m1, m2, coalesce({b[3]}, m3), coalesce({b[4]}, upper(m4)), m5, {b[1]}, {b[2]}, {b[5]}]"
    without_m = f"[{b[1]}, {b[2]}, {b[3]}, {b[4]}, {b[5]}]"
    xs = ("CASE WHEN gx THEN [CASE WHEN st THEN s1 WHEN si THEN t1 END, CASE WHEN st THEN s2 WHEN si THEN t2 END, "
          "CASE WHEN st THEN s3 END] ELSE CAST([] AS VARCHAR[]) END")
    slots = f"CASE WHEN m3 IS NOT NULL THEN {with_m} ELSE {without_m} END"
    return f"list_concat(gt, list_filter(list_transform(list_concat({slots}, {xs}), lambda v: lower(v)), lambda v: v IS NOT NULL AND v <> ''))"


def language_sql(col: str) -> str:
    cleaned = f"trim(regexp_replace(regexp_replace(regexp_replace({col}, '(?i)http\\S+|www\\.\\S+', ' ', 'g'), '[^A-Za-z\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    whens = " ".join(f"WHEN contains(upper({col}), {q(t)}) THEN {q(c)}" for t, c in C.LANGUAGE_TOKENS)
    return f"coalesce(CASE {whens} WHEN coalesce({col}, '') = '' THEN NULL WHEN {cleaned} <> '' THEN 'en' END, 'und')"


def _adult_refine(s: str) -> str:
    K = C.CATEGORY_KEYS
    return (f"CASE WHEN contains({s}, 'dvd') THEN {q(K['xxx_dvd'])} WHEN contains({s}, 'wmv') THEN {q(K['xxx_wmv'])} "
            f"WHEN contains({s}, 'xvid') THEN {q(K['xxx_xvid'])} WHEN contains({s}, 'x264') OR contains({s}, 'h264') "
            f"THEN {q(K['xxx_x264'])} ELSE {q(K['xxx'])} END")


def _lookup(col: str, table: dict[str, str]) -> str:
    """Value of a key by its place in two lists; NULL for other keys."""
    keys, values = ("[" + ", ".join(q(x) for x in xs) + "]" for xs in (table.keys(), table.values()))
    return f"({values})[list_position({keys}, {col})]"


def hint_key_sql(group: str, hints: C.Hints | None = None) -> str:
    """Category key that the group's name hints at; no group gives none."""
    hints = hints or C.Hints()
    return _lookup(f"regexp_extract(lower({group}), {q(_alts([t for t, _ in hints.pairs]))}, 0)", hints.token_map())


def category_sql(s: str, gt: str, hint: str, default: str) -> str:
    """Category id from the lower-cased subject, its bracket tags and the group's hint key (column names)."""
    K = C.CATEGORY_KEYS
    keys_list = "[" + ", ".join(q(k) for k in K) + "]"
    tag_key = f"(list_filter({gt}, lambda t: list_contains({keys_list}, t)))[1]"
    adult_re = _alts(C.DEFAULT_ADULT_KEYWORDS)
    tv = f"(regexp_matches({s}, 's\\d{{1,2}}e\\d{{1,2}}') OR contains({s}, 'season') OR contains({s}, 'episode'))"
    return f"""coalesce(CASE
      WHEN {hint} = 'xxx' THEN {_adult_refine(s)}
      ELSE coalesce({_lookup(hint, K)}, {_lookup(tag_key, K)}) END, CASE
      WHEN contains({s}, '[movies]') OR contains({s}, '[movie]') THEN {q(K['movies'])}
      WHEN contains({s}, '[tv]') THEN {q(K['tv'])}
      WHEN contains({s}, '[music]') OR contains({s}, '[audio]') THEN {q(K['audio'])}
      WHEN contains({s}, '[books]') OR contains({s}, '[book]') OR contains({s}, '[ebook]') THEN {q(K['ebook'])}
      WHEN contains({s}, '[xxx]') THEN {q(K['xxx'])}
      WHEN regexp_matches({s}, {q(adult_re)}) THEN {_adult_refine(s)}
      WHEN {tv} AND (contains({s}, 'sport') OR contains({s}, 'sports')) THEN {q(K['tv_sport'])}
      WHEN {tv} AND {_contains_any(s, ['1080p', '720p', 'x264', 'x265', 'hd'])} THEN {q(K['tv_hd'])}
      WHEN {tv} AND {_contains_any(s, ['xvid', 'dvdrip', 'sd'])} THEN {q(K['tv_sd'])}
      WHEN {tv} THEN {q(K['tv'])}
      WHEN {_contains_any(s, ['bluray', 'blu-ray'])} THEN {q(K['movies_bluray'])}
      WHEN contains({s}, '3d') THEN {q(K['movies_3d'])}
      WHEN {_contains_any(s, ['1080p', '720p', 'x264', 'x265', 'hdrip', 'webrip', 'hd'])} THEN {q(K['movies_hd'])}
      WHEN {_contains_any(s, ['dvdrip', 'xvid', 'cam', 'ts', 'sd'])} THEN {q(K['movies_sd'])}
      WHEN contains({s}, 'audiobook') OR contains({s}, 'audio book') THEN {q(K['audio_audiobook'])}
      WHEN {_contains_any(s, ['flac', 'lossless'])} THEN {q(K['audio_lossless'])}
      WHEN {_contains_any(s, ['mp3', 'aac', 'm4a'])} THEN {q(K['audio_mp3'])}
      WHEN contains({s}, 'video') AND contains({s}, 'music') THEN {q(K['audio_video'])}
      WHEN {_contains_any(s, ['album', 'single', 'music'])} THEN {q(K['audio'])}
      WHEN {_contains_any(s, ['cbz', 'cbr', 'comic'])} THEN {q(K['comics'])}
      WHEN {_contains_any(s, ['epub', 'mobi', 'pdf', 'ebook', 'isbn'])} THEN {q(K['ebook'])}
    END, {default})"""


def category_id_sql(col: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({col}, '^\\s*[+-]?[0-9]+\\s*$') THEN try_cast(trim({col}) AS INTEGER) END, 7000)"


def bucket_sql(col: str) -> str:
    whens = " ".join(f"WHEN {col} BETWEEN {lo} AND {hi} THEN {q(n)}" for n, lo, hi in C.CATEGORY_BUCKETS)
    return f"CASE {whens} ELSE {q(C.OTHER_BUCKET)} END"


def allowed_sql(cat_id: str) -> str:
    def arr(xs):
        return "[" + ", ".join(q(x) for x in xs) + "]"
    return (f"CASE WHEN {cat_id} BETWEEN 2000 AND 2999 THEN {arr(C.ALLOWED_MOVIE_EXTENSIONS)} "
            f"WHEN {cat_id} BETWEEN 5000 AND 5999 THEN {arr(C.ALLOWED_TV_EXTENSIONS)} "
            f"WHEN {cat_id} BETWEEN 6000 AND 6999 THEN {arr(C.ALLOWED_ADULT_EXTENSIONS)} END")


def min_size_sql(title: str, cat_id: str, policy: C.SizePolicy | None = None) -> str:
    policy = policy or C.SizePolicy()
    whens = []
    for k, v in policy.exact.items():
        whens.append(f"WHEN {title} = {q(k)} THEN CAST({int(v)} AS BIGINT)")
    for pat, v in policy.patterns:
        whens.append(f"WHEN regexp_matches({title}, {q(pat)}) THEN CAST({int(v)} AS BIGINT)")
    base = f"coalesce(CAST(floor({cat_id} / 1000) AS INTEGER) * 1000, 7000)"
    for b, v in policy.category_floor.items():
        whens.append(f"WHEN {base} = {b} THEN CAST({int(v)} AS BIGINT)")
    return "CASE " + " ".join(whens) + " ELSE CAST(0 AS BIGINT) END"


def search_tokens_sql(col: str) -> str:
    return f"list_filter(string_split_regex(lower({col}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def ts_text(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


# ---------------------------------------------------------------- pipeline CTEs

def parsed_ctes(gated: bool = True, hints: C.Hints | None = None) -> str:
    date_s = "trim(regexp_replace(date, '^\\s*[A-Za-z]{3},\\s*', ''))"
    gate = "WHERE size > 0 AND (allowed IS NULL OR (extension IS NOT NULL AND coalesce(list_contains(allowed, extension), false)))" if gated else ""
    return headers_ctes() + f""",
p0 AS MATERIALIZED (
  SELECT grp, article_number, bytes, coalesce(bytes, 0) AS size,
    trim({clean("coalesce(message_id, '')")}) AS message_id,
    {clean("coalesce(subject, '')")} AS subject,
    {clean("grp")} AS source_group,
    try_strptime({date_s}, '%d %b %Y %H:%M:%S +0000') AS posted_at
  FROM headers
),
pg AS MATERIALIZED (SELECT grp, {hint_key_sql("grp", hints)} AS hint FROM (SELECT DISTINCT grp FROM p0)),
px AS MATERIALIZED (
  SELECT p0.*, pg.hint,
    {extract_columns_sql("subject")}
  FROM p0 LEFT JOIN pg ON pg.grp = p0.grp
),
pt AS MATERIALIZED (
  SELECT *, {subject_tags_sql()} AS every_tag, {category_sql("low", "gt", "hint", q(C.CATEGORY_KEYS['other']))} AS category
  FROM px
),
p1 AS MATERIALIZED (
  SELECT grp, article_number, bytes, size, message_id, subject, source_group, posted_at, category,
    {clean(normalize_sql("subject"))} AS norm_title,
    list_filter(every_tag, lambda x, i: list_position(every_tag, x) = i) AS tags,
    {language_sql("subject")} AS language,
    nullif(lower(regexp_extract(subject, '\\.([A-Za-z0-9]{{2,4}})\\b', 1)), '') AS extension,
    coalesce(try_cast(nullif(regexp_extract(subject, '\\((\\d+)/\\d+\\)', 1), '') AS INTEGER), 1) AS seg_number,
    nullif(regexp_replace(message_id, '^[<>]+|[<>]+$', '', 'g'), '') AS seg_id
  FROM pt
),
p2 AS MATERIALIZED (
  SELECT *,
    CASE WHEN posted_at IS NULL THEN norm_title ELSE norm_title || ':' || strftime(posted_at, '%Y-%m-%d') END AS dedupe_key,
    {category_id_sql("category")} AS category_id
  FROM p1
),
p3 AS (SELECT *, {allowed_sql("category_id")} AS allowed FROM p2),
parsed_all AS MATERIALIZED (SELECT * EXCLUDE (allowed) FROM p3),
parsed AS MATERIALIZED (SELECT * EXCLUDE (allowed) FROM p3 {gate})"""


def releases_ctes(policy: C.SizePolicy | None = None) -> str:
    ordk = "(article_number, message_id, bytes)"
    return parsed_ctes() + f""",
cand_a AS (
  SELECT grp, dedupe_key,
    arg_min(struct_pack(category := category, category_id := category_id, language := language,
      extension := extension, source_group := source_group, tags := tags), {ordk}) AS f,
    CAST(sum(size) AS BIGINT) AS size_sum, count(*) AS n_headers, min(posted_at) AS posted_at
  FROM parsed GROUP BY grp, dedupe_key
),
cand_t AS (
  SELECT grp, dedupe_key, list_sort(list(DISTINCT tag)) AS tag_union
  FROM (SELECT grp, dedupe_key, unnest(tags) AS tag FROM parsed) GROUP BY grp, dedupe_key
),
candidates AS MATERIALIZED (
  SELECT a.grp, a.dedupe_key, f.category AS category, f.category_id AS category_id, f.language AS language,
    f.extension AS extension, f.source_group AS source_group,
    CASE WHEN n_headers = 1 THEN f.tags ELSE coalesce(t.tag_union, CAST([] AS VARCHAR[])) END AS tags,
    size_sum, n_headers, posted_at
  FROM cand_a a LEFT JOIN cand_t t ON a.grp = t.grp AND a.dedupe_key = t.dedupe_key
),
segments AS MATERIALIZED (
  SELECT dedupe_key AS norm_title, seg_id AS message_id,
    arg_min(struct_pack(number := seg_number, "group" := source_group, size := size), (grp, {ordk})) AS s
  FROM parsed WHERE seg_id IS NOT NULL GROUP BY dedupe_key, seg_id
),
seg_tot AS (
  SELECT norm_title, CAST(sum(s.size) AS BIGINT) AS seg_total, count(*) AS seg_count FROM segments GROUP BY norm_title
),
rel0 AS (
  SELECT dedupe_key AS norm_title, category_id,
    arg_min(struct_pack(category := category, language := language, tags := tags, extension := extension,
      source_group := source_group, size_sum := size_sum), grp) AS f,
    max_by(posted_at, CASE WHEN posted_at IS NOT NULL THEN grp END) AS posted_at
  FROM candidates GROUP BY dedupe_key, category_id
),
rel1 AS MATERIALIZED (
  SELECT CAST(('0x' || substr(md5(coalesce(r.norm_title, '') || chr(31) || CAST(r.category_id AS VARCHAR)), 1, 15)) AS BIGINT) AS id,
    r.norm_title, f.category AS category, r.category_id, f.language AS language,
    array_to_string(f.tags, ',') AS tags, f.extension AS extension, f.source_group AS source_group,
    coalesce(t.seg_total, CASE WHEN f.size_sum > 0 THEN f.size_sum END) AS size_bytes,
    r.posted_at, coalesce(t.seg_count, 0) > 0 AS has_parts, CAST(coalesce(t.seg_count, 0) AS INTEGER) AS part_count
  FROM rel0 r LEFT JOIN seg_tot t ON r.norm_title = t.norm_title
),
releases AS MATERIALIZED (
  SELECT *, {bucket_sql("category_id")} AS bucket, year(posted_at) AS posted_year,
    {search_tokens_sql("concat_ws(' ', norm_title, tags)")} AS search_tokens
  FROM rel1 WHERE NOT has_parts OR size_bytes >= {min_size_sql("norm_title", "category_id", policy)}
)"""


def with_ctes(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip().lstrip(",") + "\n" + body
