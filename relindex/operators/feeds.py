"""Feed documents (A13), schema upgrade of stored releases (A9) and request-log redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

#: The element order of a feed item and the attributes of the extended form.
ITEM_ELEMENTS = ["title", "guid", "pubDate", "category", "link"]
EXTENDED_ATTRIBUTES = ["imdbid", "size", "category"]

#: Columns of a stored release that older tables lack, with their defaults.
RELEASE_DEFAULTS = {"language": "und", "tags": "", "has_parts": False, "part_count": 0, "extension": None, "posted_at": None}


def escape(c: Column) -> Column:
    """Text for XML elements and attributes: & < > and both quotes."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def item_xml(items: DataFrame, extended: bool = False) -> Column:
    """One ``<item>``. The enclosure is there only for a size that is all digits and above 0; the
    extended form adds an attribute for each value that is not empty."""
    size = F.coalesce(F.col("size"), F.lit(""))
    parts = [F.concat(F.lit(f"<{e}>"), escape(F.coalesce(F.col(e), F.lit(""))), F.lit(f"</{e}>")) for e in ITEM_ELEMENTS]
    enclosure = F.when(size.rlike("^[0-9]+$") & size.rlike("[1-9]"), F.concat(
        F.lit('<enclosure url="'), escape(F.col("link")), F.lit('" type="application/x-nzb" length="'), escape(size), F.lit('"/>'))).otherwise("")
    attrs = [F.when(F.coalesce(F.col(a), F.lit("")) != "", F.concat(F.lit(f'<attr name="{a}" value="'), escape(F.col(a)), F.lit('"/>'))).otherwise("")
             for a in EXTENDED_ATTRIBUTES if extended and a in items.columns]
    return F.concat(F.lit("<item>"), *parts, enclosure, *attrs, F.lit("</item>"))


def feed_xml(items: DataFrame, order: list[Column], channel_date: str, title: str, link: str = "/", description: str = "feed",
             language: str | None = None, feed_url: str | None = None, extended: bool = False) -> DataFrame:
    """An RSS 2.0 document as parts ``(part, xml)``, 0 the opening, then one for each item in
    ``order``, the last one the end. ``items`` is a page of a search (at most ``MAX_LIMIT`` rows)."""
    esc = lambda s: F.first(escape(F.lit(s)))
    head = ['<rss version="2.0"' + (' xmlns:atom="http://www.w3.org/2005/Atom"' if feed_url else "") + "><channel>"]
    tags = [("title", title), ("link", link), ("description", description)] + ([("language", language)] if language else [])
    cols = [F.lit(head[0])]
    for name, value in tags:
        cols += [F.lit(f"<{name}>"), esc(value), F.lit(f"</{name}>")]
    if feed_url:
        cols += [F.lit('<atom:link href="'), esc(feed_url), F.lit('" rel="self" type="application/rss+xml"/>')]
    cols += [F.lit("<pubDate>"), esc(channel_date), F.lit("</pubDate>")]
    one = items.sparkSession.range(1)
    opening = one.agg(F.concat(*cols).alias("xml")).select(F.lit(0).alias("part"), "xml")
    body = items.withColumn("part", F.row_number().over(Window.orderBy(*order))).select("part", item_xml(items, extended).alias("xml"))
    end = one.select(F.lit(2 ** 31 - 1).alias("part"), F.lit("</channel></rss>").alias("xml"))
    return opening.unionByName(body).unionByName(end)


def conform_releases(stored: DataFrame) -> DataFrame:
    """An older release table in today's columns: missing columns are added, NULLs take their
    defaults, and a category text of digits only gives a missing ``category_id``."""
    out = stored
    if "category_id" not in out.columns:
        out = out.withColumn("category_id", F.lit(None).cast("int"))
    numeric = F.when(F.col("category").rlike("^[0-9]+$"), F.col("category").try_cast("int"))
    out = out.withColumn("category_id", F.coalesce("category_id", numeric))
    types = {"language": "string", "tags": "string", "has_parts": "boolean", "part_count": "int", "extension": "string", "posted_at": "timestamp"}
    for name, default in RELEASE_DEFAULTS.items():
        own = F.col(name) if name in stored.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(own.cast(types[name]), F.lit(default).cast(types[name])))
    return out


def redact_log(log: DataFrame, headers: str = "headers", query: str = "query", shown: int = C.MAX_QUERY_LENGTH) -> DataFrame:
    """A request log for display: values of credential headers (any case) are hidden, and
    ``query_shown`` is the query cut to ``shown`` characters with a mark; the query itself stays."""
    hidden = F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(C.REDACTED_HEADERS), F.lit("[redacted]")).otherwise(v))
    cut = F.when(F.length(query) > shown, F.concat(F.substring(query, 1, shown), F.lit("…"))).otherwise(F.col(query))
    return log.withColumn(headers, hidden).withColumn(f"{query}_shown", cut)
