"""Registered queries ``opN_<name>`` and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum as op4
from . import debruijn as op7
from . import decontaminate as op6
from . import jaccard_join as op5
from . import langid as op9
from . import line_quality as op11
from . import order_minhash as op1
from . import pii as op10
from . import ppm as op2
from . import suffix_ranks as op3
from . import url_templates as op8
from . import whitening as op13
from . import zfast_trie as op12
from .common import sha_of_list, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def op6_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in ``documents``: windows of ten words."""
    r = op6.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = op6.hits(F.col("spans"))
    return r.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    sha_of_list(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES["op6_wu_manber"] = op6_wu_manber
_FOLD6 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE["op6_wu_manber"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_FOLD6} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLD6} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
occ AS MATERIALIZED (
  SELECT g.doc_id, g.i, g.m, win.item FROM (
    SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)) g
  JOIN win ON win.m = g.m AND win.s = g.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item COLLATE "C")) AS h
        FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def _not_held_out(times: int, fold: int):
    """Documents whose crc32(doc_id as text) leaves another remainder than ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % times != fold, F.lit(True))


def op9_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents``, learnt from those that are not held out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    r = op9.identify(d, op9.train(d.where(_not_held_out(4, 2))))
    return r.select("doc_id", (~_not_held_out(4, 2)).alias("held_out"), "lang_pred", "score")


QUERIES["op9_hyperdimensional"] = op9_hyperdimensional


def op10_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in ``documents``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = op10.find_pii(d, op10.train(op10.labelled_table(d)))
    return r.select("doc_id", *[op10.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                    F.sha2(op10.told(F.col("base")), 256).alias("base_sha256"), op10.told(F.col("spans")).alias("spans"))


QUERIES["op10_crf"] = op10_crf


def op4_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to weights 5, 2, 1, in training order."""
    m = op4.mix(table(spark, sf_dir, "documents"))
    return (m.withColumn("position", F.get("positions", F.lit(0))).drop("positions")
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


QUERIES["op4_curriculum"] = op4_curriculum
ORACLE["op4_curriculum"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS no_source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, no_source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY no_source, source COLLATE "C") - 1) % 3 + 1 AS INT)] AS weight FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap FROM w),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0)) AS remaining,
             sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS open_weight, coalesce(sum(cap) OVER p, 0) AS capped
      FROM c WINDOW p AS (ORDER BY cap / weight, no_source, source COLLATE "C" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, remaining / open_weight AS level FROM o),
f AS (SELECT arg_min(level, capped) AS final FROM l WHERE level * weight <= cap),
t AS (SELECT source, no_source, source_size, weight, least(cap, coalesce(final * weight, cap))::DOUBLE AS target FROM l, f),
r AS (SELECT d.*, t.source_size, t.weight, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source, d.no_source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
      FROM d JOIN t ON d.source = t.source AND d.no_source = t.no_source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM r),
n AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE passes + CASE WHEN first + size / 2 < target - passes * source_size THEN 1 ELSE 0 END END AS copies,
             least(first / greatest(target, 1.0), 1.0)::DOUBLE AS x FROM k)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies = 0 THEN NULL WHEN weight = 2 THEN x
            WHEN weight = 5 THEN CASE WHEN x <= 0 THEN 0 WHEN x <= 0.625 THEN 2 * x / (1.5 + sqrt(2.25 - 2 * x))
                                      ELSE 0.5 + 2 * (x - 0.625) / (1 + sqrt(1 - 2 * (x - 0.625))) END
            ELSE CASE WHEN x <= 0 THEN 0 WHEN x <= 0.375 THEN 2 * x / (0.5 + sqrt(0.25 + 2 * x))
                      ELSE 0.5 + 2 * (x - 0.375) / (1 + sqrt(1 + 2 * (x - 0.375))) END END AS position
FROM n
"""


def op8_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on ``pages`` by rule, else by path template."""
    return op8.judge(table(spark, sf_dir, "pages"), op8.rules_table(spark))


QUERIES["op8_path_templates"] = op8_path_templates
_RULES8 = ", ".join(f"('{r}', '{v}')" for r, v in op8.RULES)
ORACLE["op8_path_templates"] = rf"""
WITH page AS MATERIALIZED (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule, v) AS (VALUES {_RULES8}),
r AS (SELECT rule, v, split_part(rule, '/', 1) AS fit, substr(rule, instr(rule, '/')) AS start FROM rules),
spots AS (SELECT host, path, count(*) AS pages FROM page GROUP BY ALL),
best AS (SELECT s.host, s.path, max({{'n': length(rule), 'rule': rule, 'v': v}}) AS b FROM spots s JOIN r
         ON (s.host = r.fit OR ends_with(s.host, '.' || r.fit)) AND starts_with(s.path, r.start) GROUP BY ALL),
places AS MATERIALIZED (SELECT s.*, b.rule AS rule, b.v AS rv FROM spots s LEFT JOIN best USING (host, path)),
sg AS (SELECT host, path, pages, CASE WHEN rv = 'block' THEN pages ELSE 0 END AS nb, CASE WHEN rv IS NOT NULL THEN pages ELSE 0 END AS nl,
              list_transform(string_split(path, '/'), lambda s: CASE
                WHEN regexp_matches(regexp_replace(s, '\.[A-Za-z]{{1,5}}$', ''), '^[0-9]+$') THEN '{{n}}' || substr(s, length(regexp_replace(s, '\.[A-Za-z]{{1,5}}$', '')) + 1, 8)
                WHEN regexp_matches(regexp_replace(s, '\.[A-Za-z]{{1,5}}$', ''), '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches(regexp_replace(s, '\.[A-Za-z]{{1,5}}$', ''), '[0-9]')
                  THEN '{{h}}' || substr(s, length(regexp_replace(s, '\.[A-Za-z]{{1,5}}$', '')) + 1, 8)
                ELSE s END) AS kinds FROM places),
seg AS MATERIALIZED (SELECT host, path, pages, nb, nl, depth, kinds[depth + 1] AS kind, array_to_string(kinds[1:depth], '/') AS above
        FROM (SELECT *, unnest(range(0, len(kinds))) AS depth FROM sg)),
br AS (SELECT host, depth, above, kind, sum(pages) AS n, sum(nb) AS b, sum(nl) AS l FROM seg GROUP BY ALL),
ar AS (SELECT host, depth, above, count(*) AS vals, sum(n) AS n_all, sum(b) AS b_all, sum(l) AS l_all FROM br GROUP BY ALL),
fb AS (SELECT depth, above, kind, sum(b) AS gb, sum(l) AS gl FROM br GROUP BY ALL),
fa AS (SELECT depth, above, sum(gb) AS gb_all, sum(gl) AS gl_all FROM fb GROUP BY ALL),
nm AS (SELECT br.host, br.depth, br.above, br.kind, CASE
         WHEN vals > {op8.FAN_OUT} AND n_all < {op8.RARE} * vals THEN '*'
         WHEN vals = 1 THEN br.kind
         WHEN CASE WHEN l_all > 0 THEN l > 0 AND abs(b / l - b_all / l_all) > {op8.Z} * sqrt((b_all / l_all) * (1 - b_all / l_all) / l)
              ELSE gl > 0 AND abs(gb / gl - gb_all / gl_all) > {op8.Z} * sqrt((gb_all / gl_all) * (1 - gb_all / gl_all) / gl) END THEN br.kind
         ELSE '*' END AS name FROM br JOIN ar USING (host, depth, above) JOIN fb USING (depth, above, kind) JOIN fa USING (depth, above)),
t AS MATERIALIZED (SELECT host, path, nb, nl, string_agg(name, '/' ORDER BY depth) AS template
      FROM seg JOIN nm USING (host, depth, above, kind) GROUP BY ALL),
bh AS (SELECT host, template, sum(nb) AS b, sum(nl) AS l FROM t GROUP BY ALL),
ba AS (SELECT template, sum(b) AS gb, sum(l) AS gl FROM bh GROUP BY ALL),
tt AS (SELECT CASE WHEN sum(gl) > 0 THEN sum(gb) / sum(gl) ELSE 0.0 END AS base FROM ba),
sh AS (SELECT host, template, (b + {op8.PRIOR} * ((gb + {op8.PRIOR} * base) / (gl + {op8.PRIOR}))) / (l + {op8.PRIOR}) AS block_share FROM bh JOIN ba USING (template), tt)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN block_share > {op8.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, CAST(block_share AS DOUBLE) AS block_share
FROM page JOIN places USING (host, path) JOIN t USING (host, path) JOIN sh USING (host, template)
"""


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM scores of all ``documents``, learnt from those that are not held out."""
    return op2.score(table(spark, sf_dir, "documents"), held_out=~_not_held_out(7, 2))


QUERIES["op2_ppm"] = op2_ppm


def op7_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` that repeat 13-word windows of earlier documents, removed."""
    r = op7.remove_repeats(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op7_de_bruijn"] = op7_de_bruijn
ORACLE["op7_de_bruijn"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
                   FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (h) WHERE doc_id > first),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u
      ANTI JOIN gone ON gone.doc_id = u.doc_id AND gone.p = u.p GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op3_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` in repeated 400-byte strings, removed."""
    r = op3.remove_repeats(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op3_prefix_doubling"] = op3_prefix_doubling


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts."""
    r = op1.compare_with_next(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), op1.printed(F.col("signature")).alias("fingerprint"),
                    op1.printed(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES["op1_order_minhash"] = op1_order_minhash


def op5_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among ``documents``: 4-word shingles, 85 % of the union."""
    return op5.jaccard_join(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")


QUERIES["op5_divide_skip"] = op5_divide_skip
ORACLE["op5_divide_skip"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(4, len(w)) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS MATERIALIZED (SELECT doc_id, g, n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS df FROM s) JOIN n USING (doc_id) WHERE df > 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.doc_id WHERE c.root < p.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, coalesce(l.n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id) k USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM p GROUP BY a) l USING (doc_id)
"""


def op11_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of ``documents`` from their lines, learnt from the labels of rows that are not held out."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learnt = _not_held_out(3, 1)
    r = op11.assess(d, op11.train(d.where(learnt), labels.where(learnt)))
    return r.select("doc_id", (~learnt).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_bad")


QUERIES["op11_line_crf"] = op11_line_crf


def op12_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prefixes of the rebuilt ``conversations``."""
    return op12.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES["op12_zfast_trie"] = op12_zfast_trie
ORACLE["op12_zfast_trie"] = r"""
WITH t AS (SELECT conv_id AS c, turn, len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS whole,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT c, sha256(whole) AS k, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(whole)) AS pos FROM t),
cv AS MATERIALIZED (SELECT c, c - c % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
          string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)) % 4 AS h
      FROM (SELECT DISTINCT c FROM o)),
rb AS (SELECT cv.c, 0 AS own, pos, k, words FROM cv JOIN o ON o.c = cv.base AND pos <= h
       UNION ALL SELECT c, 1, pos, k, words FROM o JOIN cv USING (c) WHERE pos > h),
dd AS (SELECT c, k, words, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d FROM rb),
px AS (SELECT c, d, words, sha256(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS id FROM dd UNION ALL SELECT c, 0, 0, '' FROM cv),
pf AS MATERIALIZED (SELECT *, lag(id) OVER (PARTITION BY c ORDER BY d) AS parent, max(d) OVER (PARTITION BY c) AS whole FROM px),
nd AS MATERIALIZED (SELECT id, d, min(c) AS conv_id, count(*) AS n, min(parent) AS parent, min(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = whole), '')) AS ends FROM pf GROUP BY id, d),
kd AS MATERIALIZED (SELECT parent AS id, count(*) AS kids FROM nd WHERE parent IS NOT NULL GROUP BY parent),
un AS (SELECT a.id, sum((v.n - 1) * v.words) AS saved, sum(CASE WHEN kd.kids IS NULL THEN 1 ELSE 0 END) AS leaves
       FROM nd v LEFT JOIN kd ON kd.id = v.id JOIN pf a ON a.c = v.conv_id AND a.d <= v.d GROUP BY a.id)
SELECT nd.conv_id, CAST(nd.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nd.n AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, nd.ends AS ends_sha256
FROM nd LEFT JOIN nd up ON up.id = nd.parent LEFT JOIN kd ON kd.id = nd.id JOIN un ON un.id = nd.id
"""


def op13_rank_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` on their 32 leading whitened components."""
    r = op13.whiten(table(spark, sf_dir, "embeddings"))
    return r.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES["op13_rank_one"] = op13_rank_one
