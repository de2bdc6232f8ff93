"""Date, key and link column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC2822_OUT = "EEE, dd MMM yyyy HH:mm:ss Z"


#: Named zones of mail dates (RFC 2822) and their offsets.
NAMED_ZONES: dict[str, str] = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


#: A date in the usual form: four-digit year, seconds and numeric zone, which needs no mending.
USUAL_DATE = r"^(?:\s*[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})\z"


def usual_date(date_text: Column) -> Column:
    """The part of a date in the usual form that ``parse_posted`` reads; empty (or NULL) for any other."""
    return F.regexp_extract(date_text, USUAL_DATE, 1)


def parse_posted(date_text: Column, iso: bool = False, usual: Column | None = None) -> Column:
    """RFC-2822 text (optional day name and seconds, numeric or named zone,
    two-digit years 69-99 and 00-68) -> UTC timestamp; anything unparsable ->
    NULL. ISO text only with ``iso`` (stored values, not header dates).
    ``usual`` is ``usual_date`` of the text if the caller has it as a column."""
    usual = usual_date(date_text) if usual is None else usual
    return F.when(usual != "", F.try_to_timestamp(usual, F.lit("d MMM yyyy HH:mm:ss Z"))).when(date_text.isNotNull(), _mended(date_text, iso))


def _mended(date_text: Column, iso: bool) -> Column:
    s = F.trim(F.regexp_replace(date_text, r"^\s*[A-Za-z]{3},\s*", ""))
    s = F.regexp_replace(s, r"\s+\([^)]*\)$", "")  # trailing "(UTC)" comment
    zone = F.upper(F.regexp_extract(s, r"\s([A-Za-z]{1,4})$", 1))
    pairs = [x for k, v in NAMED_ZONES.items() for x in (F.lit(k), F.lit(v))]
    offset = F.try_element_at(F.create_map(*pairs), zone)
    s = F.when(offset.isNotNull(), F.concat(F.regexp_replace(s, r"[A-Za-z]{1,4}$", ""), offset)).otherwise(s)
    short = F.regexp_extract(s, r"^\d{1,2} [A-Za-z]{3} (\d{2}) ", 1)
    century = F.when(short.try_cast("int") > 68, "19").otherwise("20")
    s = F.when(short != "", F.concat(F.regexp_extract(s, r"^(\d{1,2} [A-Za-z]{3} )", 1), century,
                                     F.regexp_extract(s, r"^\d{1,2} [A-Za-z]{3} (.*)$", 1))).otherwise(s)
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z"]
    if iso:
        forms += ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in forms])


def day_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def dedupe_key(title: Column, ts: Column) -> Column:
    """``title:YYYY-MM-DD``, or the bare title without a date."""
    return F.when(ts.isNull(), title).otherwise(F.concat(title, F.lit(":"), day_bucket(ts)))


def split_key(stored: Column) -> Column:
    """struct(title, day) from a stored ``title:YYYY-MM-DD`` key."""
    pat = r"^(.*):(\d{4}-\d{2}-\d{2})$"
    has = F.regexp_like(stored, F.lit(pat))
    return F.struct(
        F.when(has, F.regexp_extract(stored, pat, 1)).otherwise(stored).alias("title"),
        F.when(has, F.regexp_extract(stored, pat, 2)).alias("day"),
    )


def pub_date(ts: Column, as_of: str) -> Column:
    """RFC-2822 text; NULL -> the given ``as_of`` instant (repeatable "now")."""
    return F.date_format(F.coalesce(ts, F.to_timestamp(F.lit(as_of))), RFC2822_OUT)


def url_quote(c: Column) -> Column:
    """Percent-encode everything but unreserved characters (``quote(x, safe='')``)."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def item_link(release_id: Column, api_key: str | None = None) -> Column:
    """``/api?t=getnzb&id=<quoted id>`` plus an optional key."""
    link = F.concat(F.lit("/api?t=getnzb&id="), url_quote(release_id.cast("string")))
    if api_key:
        link = F.concat(link, F.lit("&apikey="), url_quote(F.lit(api_key)))
    return link
