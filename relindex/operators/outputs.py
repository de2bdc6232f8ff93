"""Manifest outputs: segment loading with status (A11), the segment cap
(A12), per-release NZB XML documents (A10) and the bulk ``getnzb`` job (J6);
legacy segment JSON decoding and repair (B19, B20, I7).

A manifest is written as ordered parts of a bounded number of segments, and
legacy lists are decoded to rows, so no row holds a release of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C

NZB_XMLNS = "http://www.newzbin.com/DTD/2003/nzb"
XML_DECL = "<?xml version='1.0' encoding='utf-8'?>\n"


def xml_text(c: Column) -> Column:
    """Escape element text (&, <, >)."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attr(c: Column) -> Column:
    """Escape attribute values (&, <, >, \")."""
    return F.replace(xml_text(c), F.lit('"'), F.lit("&quot;"))


def segment_status(releases: DataFrame, segments: DataFrame, max_segments: int | None = C.NZB_MAX_SEGMENTS) -> DataFrame:
    """A11 + A12 + B20: per release ``status`` in ok / no_segments / invalid /
    over_limit, with the segment count; all aggregates are decomposable."""
    valid = (F.col("number").isNotNull() & F.col("size").isNotNull() & F.col("message_id").isNotNull()
             & ~F.col("message_id").rlike("[<>]") & (F.col("message_id") != ""))
    st = segments.groupBy("norm_title").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum((~valid).cast("int")).alias("n_invalid"),
    )
    r = releases.select("id", "norm_title", "category_id").join(st, "norm_title", "left")
    status = (F.when(F.coalesce(F.col("n_segments"), F.lit(0)) == 0, F.lit("no_segments"))
              .when(F.col("n_invalid") > 0, F.lit("invalid"))
              .when(F.lit(False) if max_segments is None else F.col("n_segments") > max_segments, F.lit("over_limit"))
              .otherwise(F.lit("ok")))
    return r.select("id", "norm_title", "category_id", F.coalesce(F.col("n_segments"), F.lit(0)).alias("n_segments"),
                    status.alias("status"))


#: Segment numbers that one part of a manifest covers.
PART_NUMBERS = 1000


def manifests(releases: DataFrame, segments: DataFrame, max_segments: int | None = None) -> DataFrame:
    """The XML document of each valid release, as parts ``(id, part, nzb)`` that give the
    document when joined in order of ``part``.

    Part -1 opens it with the groups (each once, in order of its first segment), the others hold the
    segments of ``PART_NUMBERS`` numbers each, sorted by number (message id breaks ties), the last one closes
    it. No release is left out for its size unless ``max_segments`` (A12) is given."""
    st = segment_status(releases, segments, max_segments)
    # a release that is given n times has each of its segments n times
    ok = st.where(F.col("status") == "ok").groupBy("id", "norm_title").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    seg = segments.withColumn("part", F.floor(F.col("number") / PART_NUMBERS).cast("int"))
    last = seg.groupBy("norm_title").agg(F.max("part").alias("last"))
    ok = ok.join(last, "norm_title")
    # All releases of a title (one for each category) share its segments: they are collected once for the title, and meet the
    # releases where they were collected. So neither the segments nor the text of a document is dealt out once for each release.
    parts = ok.join(seg.select("norm_title", "part").distinct(), "norm_title").hint("shuffle_hash")
    xml = lambda e: F.concat(F.lit('<segment bytes="'), e["size"], F.lit('" number="'),
                             e["number"].cast("string"), F.lit('">'), xml_text(e["message_id"]), F.lit("</segment>"))
    body = seg.groupBy("norm_title", "part").agg(
        F.collect_list(F.struct("number", "message_id", F.col("size").cast("string").alias("size"))).alias("s"))
    body = body.select("norm_title", "part", F.transform(F.array_sort("s"), xml).alias("s")).join(parts, ["norm_title", "part"])
    text = F.when(F.col("copies") == 1, F.array_join("s", "")).otherwise(
        F.array_join(F.transform("s", lambda x: F.repeat(x, F.col("copies"))), ""))
    body = body.select("id", "part", F.when(F.col("part") == F.col("last"), F.concat(text, F.lit("</segments></file></nzb>")))
                       .otherwise(text).alias("nzb"))
    named = (seg.where(F.coalesce(F.col("group"), F.lit("")) != "").groupBy("norm_title", "group")
             .agg(F.min(F.struct("number", "message_id")).alias("o"))
             .groupBy("norm_title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "group"))), lambda g: F.concat(
                 F.lit("<group>"), xml_text(g["group"]), F.lit("</group>"))), "").alias("groups")))
    head = ok.join(named, "norm_title", "left").select("id", F.lit(-1).alias("part"), F.concat(
        F.lit(XML_DECL + f'<nzb xmlns="{NZB_XMLNS}"><file subject="'), xml_attr(F.col("id").cast("string")), F.lit('"><groups>'),
        F.coalesce("groups", F.lit("")), F.lit("</groups><segments>")).alias("nzb"))
    return head.unionByName(body)


# ---------------------------------------------------------------- legacy JSON

def legacy_segment_json(segments: DataFrame) -> DataFrame:
    """Fixture for B19/I7: the older storage, a JSON text per title; list form
    ``[n, id, group, size]`` for titles with an odd segment count. By the
    length of the title some entries are of old kinds: number as text and
    ``<>`` around the id (rest 1 of 5), a size that is no number (rest 2), a
    missing size (rest 3), three entries only (rest 4, list form)."""
    kind = F.length("norm_title") % 5
    bare = F.to_json(F.struct("number", "message_id", "group", "size"))
    text = F.to_json(F.struct(F.col("number").cast("string").alias("number"), F.concat(F.lit("<"), "message_id", F.lit(">")).alias("message_id"), "group", "size"))
    bad = F.to_json(F.struct("number", "message_id", "group", F.lit("x").alias("size")))
    none = F.to_json(F.struct("number", "message_id", "group"))
    obj = F.when(kind == 1, text).when(kind == 2, bad).when(kind == 3, none).otherwise(bare)
    lst = F.when(kind == 4, F.format_string('[%d,"%s","%s"]', "number", "message_id", "group")).otherwise(
        F.format_string('[%d,"%s","%s",%d]', F.col("number"), F.col("message_id"), F.col("group"), F.col("size")))
    per = segments.groupBy("norm_title").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("number", "message_id", obj.alias("o"), lst.alias("l")))).alias("s"))
    txt = F.when(F.col("n") % 2 == 1, F.transform("s", lambda e: e["l"])).otherwise(F.transform("s", lambda e: e["o"]))
    return per.select("norm_title", F.concat(F.lit("[ "), F.array_join(txt, ","), F.lit("]")).alias("segments"))


#: What an entry of the canonical form looks like: these keys and types, no others.
CANONICAL = "OBJECT<group: STRING, message_id: STRING, number: BIGINT, size: BIGINT>"


def decode_segments(legacy: DataFrame) -> DataFrame:
    """B19 + B20: JSON text -> one row per entry.

    ``valid``: the entry is an object with exactly the four keys, whole numbers
    and an id without ``<>``. ``convertible``: number and size are numbers or
    the text of one (a missing or null size of an object is 0), the entry is an
    object or a list of four at least; then number, message_id (without the
    surrounding ``<>``), group and size are given, else they are NULL. Text
    that does not parse, or is no list, yields no rows."""
    v = legacy.select("norm_title", F.try_parse_json(F.col("segments")).alias("j"))
    v = v.where(F.col("j").isNotNull() & F.schema_of_variant("j").startswith("ARRAY"))
    e = v.select("norm_title", F.expr("posexplode(cast(j as array<variant>))").alias("pos", "v"))
    e = e.withColumn("kind", F.schema_of_variant("v"))
    is_obj, is_list = F.col("kind").startswith("OBJECT"), F.col("kind").startswith("ARRAY")

    def get(name: str, idx: int, typ: str) -> Column:
        return F.when(is_obj, F.try_variant_get("v", f"$.{name}", typ)).when(is_list, F.try_variant_get("v", f"$[{idx}]", typ))

    def whole(name: str, idx: int) -> Column:
        text = get(name, idx, "string")
        return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("long"))

    size_text = get("size", 3, "string")
    number = F.when(is_obj & get("number", 0, "string").isNull(), F.lit(0).cast("long")).otherwise(whole("number", 0))
    size = F.when(is_obj & (F.coalesce(size_text, F.lit("")) == ""), F.lit(0).cast("long")).otherwise(whole("size", 3))
    raw_id = F.coalesce(get("message_id", 1, "string"), F.lit(""))
    out = e.select("norm_title", "pos", "kind", number.alias("number"), raw_id.alias("raw_id"),
                   F.coalesce(get("group", 2, "string"), F.lit("")).alias("group"), size.alias("size"))
    ok = F.col("number").isNotNull() & F.col("size").isNotNull()
    return out.select(
        "norm_title", "pos", F.when(ok, F.col("number")).alias("number"),
        F.when(ok, F.regexp_replace("raw_id", r"^[<>]+|[<>]+$", "")).alias("message_id"),
        F.when(ok, F.col("group")).alias("group"), F.when(ok, F.col("size")).alias("size"),
        ((F.col("kind") == CANONICAL) & ~F.col("raw_id").rlike("[<>]")).alias("valid"), ok.alias("convertible"))


def repair_segments(legacy: DataFrame) -> DataFrame:
    """The entries of the lists to rewrite, as rows in canonical form: lists
    with an entry that is not valid, all of whose entries convert. Other lists
    are left alone. Per title only two flags are aggregated."""
    d = decode_segments(legacy)
    todo = (d.groupBy("norm_title").agg(F.bool_and("valid").alias("fine"), F.bool_and("convertible").alias("can"))
            .where("NOT fine AND can").select("norm_title"))
    return d.join(todo, "norm_title", "left_semi").select("norm_title", "pos", "number", "message_id", "group", "size")
