"""URL filters: explicit rules, then a tree of path templates with smoothed labelled purity.

Each host has a tree of path segments. Segments that vary (numbers, hashes,
positions with very many values) become wildcards. Sibling branches whose
labels do not differ significantly from those of all siblings together are
merged into one branch; where a host has no labels, the labels of the same
position over all hosts tell. A template is rejected by the share of blocked pages
among its labelled pages, smoothed by the share of the same template over all
hosts, which is smoothed by that of all labelled pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: A position with more distinct values than this, most of them rare, is a wildcard.
FAN_OUT, RARE = 50, 3.0
#: Standard errors by which a branch must differ from its siblings to stay apart.
Z = 2.0
#: Weight of the prior in labelled pages, and the block share from which a template is rejected.
PRIOR, REJECT = 5.0, 0.5

#: The contract's rules: (rule, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, rule_verdict string")


def host_of(url):
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def segment_class(s):
    """A segment's type: digits become ``{n}``, long mixes of hex digits ``{h}``, a known ending is kept."""
    stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
    ending = F.substring(s, F.length(stem) + 1, 8)
    return (F.when(stem.rlike(r"^[0-9]+$"), F.concat(F.lit("{n}"), ending))
            .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.concat(F.lit("{h}"), ending)).otherwise(s))


def apply_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null without a rule) to distinct (host, path) rows.

    A rule is joined by its host to all suffixes of a host (whole labels), so the work does not grow
    with hosts x rules; the longest rule whose path starts the path wins.
    """
    r = rules.select("rule", "rule_verdict", F.substring_index("rule", "/", 1).alias("fit"),
                     F.expr("substring(rule, instr(rule, '/'))").alias("start"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (places.select("host", "path", F.explode(ends).alias("fit")).join(r, "fit").where("startswith(path, start)")
            .groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best")))
    return places.join(best, ["host", "path"], "left").select(*places.columns, "best.rule", "best.rule_verdict")


def _differs(b: str, n: str, b_all: str, n_all: str):
    """Whether a branch's share of blocked pages is more than ``Z`` standard errors from that of all siblings."""
    pool = F.col(b_all) / F.when(F.col(n_all) > 0, F.col(n_all))
    own = F.when(F.col(n) > 0, F.col(n))
    return F.abs(F.col(b) / own - pool) > Z * F.sqrt(pool * (1 - pool) / own)


def templates(places: DataFrame) -> DataFrame:
    """(host, path, pages, rule_verdict) -> (host, path, template, pages, n_block, n_label).

    Statistics of one tree position are aggregates keyed by host, depth and the types of the
    segments before: all depths in one pass, with partial sums for a hot host.
    """
    block = F.when(F.col("rule_verdict") == "block", F.col("pages")).otherwise(0)
    label = F.when(F.col("rule_verdict").isNotNull(), F.col("pages")).otherwise(0)
    kinds = F.transform(F.split("path", "/"), segment_class)
    p = places.select("host", "path", "pages", block.alias("n_block"), label.alias("n_label"), kinds.alias("kinds"))
    seg = (p.select("*", F.posexplode("kinds").alias("depth", "kind"))
           .withColumn("above", F.array_join(F.slice("kinds", 1, F.col("depth")), "/")).drop("kinds"))
    spot = ["host", "depth", "above"]
    branch = seg.groupBy(*spot, "kind").agg(F.sum("pages").alias("n"), F.sum("n_block").alias("b"), F.sum("n_label").alias("l"))
    around = branch.groupBy(*spot).agg(F.count("*").alias("values"), F.sum("n").alias("n_all"),
                                       F.sum("b").alias("b_all"), F.sum("l").alias("l_all"))
    # the same position over all hosts, for hosts without labels there
    far = branch.groupBy("depth", "above", "kind").agg(F.sum("b").alias("gb"), F.sum("l").alias("gl"))
    far_around = far.groupBy("depth", "above").agg(F.sum("gb").alias("gb_all"), F.sum("gl").alias("gl_all"))
    many = (F.col("values") > FAN_OUT) & (F.col("n_all") < RARE * F.col("values"))
    apart = (F.when(F.col("l_all") > 0, _differs("b", "l", "b_all", "l_all"))
             .otherwise(_differs("gb", "gl", "gb_all", "gl_all")))
    named = (branch.join(around, spot).join(far, ["depth", "above", "kind"]).join(far_around, ["depth", "above"]).select(
        *spot, "kind", F.when(many, "*").when((F.col("values") == 1) | F.coalesce(apart, F.lit(False)), F.col("kind")).otherwise("*").alias("name")))
    whole = (seg.join(named, [*spot, "kind"]).groupBy("host", "path", "pages", "n_block", "n_label")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"]), "/").alias("template")))
    return whole


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each page: ``key``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``block_share``.

    Without a rule the template decides: ``block`` where its smoothed share of blocked pages is above
    ``REJECT``. A null URL, or one without ``://``, has empty host and path, which are judged as any
    other; without any labelled page the share is 0 and all is allowed. Repeated rows are judged row
    by row; an empty table gives an empty result; other columns are not looked at.
    """
    page = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    places = stored(apply_rules(page.groupBy("host", "path").agg(F.count("*").alias("pages")), rules), "places")
    t = stored(templates(places), "templates")
    by_host = t.groupBy("host", "template").agg(F.sum("n_block").alias("b"), F.sum("n_label").alias("l"))
    by_all = by_host.groupBy("template").agg(F.sum("b").alias("gb"), F.sum("l").alias("gl"))
    total = by_all.agg(F.sum("gb").alias("tb"), F.sum("gl").alias("tl"))
    base = F.when(F.col("tl") > 0, F.col("tb") / F.col("tl")).otherwise(0.0)
    share = (F.col("b") + PRIOR * ((F.col("gb") + PRIOR * base) / (F.col("gl") + PRIOR))) / (F.col("l") + PRIOR)
    shares = by_host.join(by_all, "template").join(F.broadcast(total)).select("host", "template", share.alias("block_share"))
    judged = (places.select("host", "path", "rule", "rule_verdict").join(t.select("host", "path", "template"), ["host", "path"])
              .join(shares, ["host", "template"])
              .select("host", "path", "rule", "template", "block_share",
                      F.coalesce("rule_verdict", F.when(F.col("block_share") > REJECT, "block").otherwise("allow")).alias("verdict")))
    return page.join(judged, ["host", "path"]).select(key, "host", "path", "rule", "verdict", "template", "block_share")
