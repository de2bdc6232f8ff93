"""Category inference and category-derived columns, compiled from the
configuration into one ``CASE`` ladder plus map literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import extract_tags


def _map_lit(d: dict[str, str]) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _has_any(s: Column, needles) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | s.contains(n)
    return cond


def _adult_refine(s: Column) -> Column:
    K = C.CATEGORY_KEYS
    return (
        F.when(s.contains("dvd"), F.lit(K["xxx_dvd"]))
        .when(s.contains("wmv"), F.lit(K["xxx_wmv"]))
        .when(s.contains("xvid"), F.lit(K["xxx_xvid"]))
        .when(s.contains("x264") | s.contains("h264"), F.lit(K["xxx_x264"]))
        .otherwise(F.lit(K["xxx"]))
    )


def _first_token(tokens: list[str]) -> str:
    """The alternatives ``t1|t2|...`` grouped by first character: those of another one cannot match at the same place,
    so the leftmost match is the same, and a place that begins no token is passed at once."""
    if not all(tokens):
        return "|".join(re.escape(t) for t in tokens)
    heads: dict[str, list[str]] = {}
    for t in tokens:
        heads.setdefault(t[0], []).append(re.escape(t[1:]))
    starts = "".join(rf"\x{{{ord(h):x}}}" for h in heads)
    return f"(?=[{starts}])(?:" + "|".join(f"{re.escape(h)}(?:{'|'.join(rest)})" for h, rest in heads.items()) + ")"


def group_hint(group: Column, hints: C.Hints | None = None) -> Column:
    """The category key that the first hint token in a group's name stands for; NULL without."""
    hints = hints or C.Hints()
    token = F.regexp_extract(F.lower(group), _first_token([t for t, _ in hints.pairs]), 0)
    return F.try_element_at(_map_lit(hints.token_map()), F.nullif(token, F.lit("")))


def infer_category(subject: Column, group: Column, hints: C.Hints | None = None,
                   adult_keywords: tuple[str, ...] = C.DEFAULT_ADULT_KEYWORDS, tags: Column | None = None,
                   low: Column | None = None, hint: Column | None = None) -> Column:
    """(subject, group) -> category id text, or NULL when nothing matches.

    ``low`` (lower-cased subject), ``hint`` (``group_hint``) and ``tags`` are
    computed here unless the caller has them as columns: the ladder reads them
    in nearly every branch, and a branch computes an expression anew.
    """
    K = C.CATEGORY_KEYS
    s = F.lower(subject) if low is None else low
    hint_key = group_hint(group, hints) if hint is None else hint
    key_ids = _map_lit(K)
    tags = extract_tags(subject) if tags is None else tags
    tag_key = F.try_element_at(F.filter(tags, lambda t: t.isin([*K])), F.lit(1))
    tv = s.contains("season") | s.contains("episode") | F.regexp_like(s, F.lit(r"s\d{1,2}e\d{1,2}"))

    return (
        F.when(group.isNotNull() & (group != "") & (hint_key == "xxx"), _adult_refine(s))
        .when(group.isNotNull() & (group != "") & hint_key.isNotNull(), F.try_element_at(key_ids, hint_key))
        .when(tag_key.isNotNull(), F.try_element_at(key_ids, tag_key))
        .when(s.contains("[movies]") | s.contains("[movie]"), F.lit(K["movies"]))
        .when(s.contains("[tv]"), F.lit(K["tv"]))
        .when(s.contains("[music]") | s.contains("[audio]"), F.lit(K["audio"]))
        .when(s.contains("[books]") | s.contains("[book]") | s.contains("[ebook]"), F.lit(K["ebook"]))
        .when(s.contains("[xxx]"), F.lit(K["xxx"]))
        .when(_has_any(s, adult_keywords or ("",)), _adult_refine(s))
        .when(tv, F.when(s.contains("sport"), F.lit(K["tv_sport"]))
              .when(_has_any(s, ["1080p", "720p", "x264", "x265", "hd"]), F.lit(K["tv_hd"]))
              .when(_has_any(s, ["xvid", "dvdrip", "sd"]), F.lit(K["tv_sd"]))
              .otherwise(F.lit(K["tv"])))
        .when(_has_any(s, ["bluray", "blu-ray"]), F.lit(K["movies_bluray"]))
        .when(s.contains("3d"), F.lit(K["movies_3d"]))
        .when(_has_any(s, ["1080p", "720p", "x264", "x265", "hdrip", "webrip", "hd"]), F.lit(K["movies_hd"]))
        .when(_has_any(s, ["dvdrip", "xvid", "cam", "ts", "sd"]), F.lit(K["movies_sd"]))
        .when(s.contains("audiobook") | s.contains("audio book"), F.lit(K["audio_audiobook"]))
        .when(_has_any(s, ["flac", "lossless"]), F.lit(K["audio_lossless"]))
        .when(_has_any(s, ["mp3", "aac", "m4a"]), F.lit(K["audio_mp3"]))
        .when(s.contains("video") & s.contains("music"), F.lit(K["audio_video"]))
        .when(_has_any(s, ["album", "single", "music"]), F.lit(K["audio"]))
        .when(_has_any(s, ["cbz", "cbr", "comic"]), F.lit(K["comics"]))
        .when(_has_any(s, ["epub", "mobi", "pdf", "ebook", "isbn"]), F.lit(K["ebook"]))
    )


def category_or_other(cat: Column) -> Column:
    """Ingest default: no inference -> ``7000``."""
    return F.coalesce(F.nullif(cat, F.lit("")), F.lit(C.CATEGORY_KEYS["other"]))


def category_id(category: Column) -> Column:
    """Text category -> int id; non-numeric text -> 7000 (text kept separately)."""
    return F.coalesce(
        F.when(category.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(category).try_cast("int")),
        F.lit(7000),
    )


def is_adult_category(cat: Column) -> Column:
    """int(cat) in [6000, 7000); unparsable -> false."""
    v = F.coalesce(F.nullif(cat.cast("string"), F.lit("")), F.lit("0")).try_cast("int")
    return F.coalesce((v >= 6000) & (v < 7000), F.lit(False))


def category_bucket(cat_id: Column) -> Column:
    """Category id range -> partition bucket name."""
    expr = None
    for name, lo, hi in C.CATEGORY_BUCKETS:
        cond = cat_id.between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(C.OTHER_BUCKET))


def allowed_extensions_for(cat_id: Column) -> Column:
    """Movies / TV / adult -> allow-list array, else NULL (no gate)."""
    return (
        F.when(cat_id.between(2000, 2999), F.array(*[F.lit(e) for e in C.ALLOWED_MOVIE_EXTENSIONS]))
        .when(cat_id.between(5000, 5999), F.array(*[F.lit(e) for e in C.ALLOWED_TV_EXTENSIONS]))
        .when(cat_id.between(6000, 6999), F.array(*[F.lit(e) for e in C.ALLOWED_ADULT_EXTENSIONS]))
    )


def extension_ok(cat_id: Column, extension: Column) -> Column:
    """Whether the extension is in the allow-list of its category (B25); without a list any one is, none too."""
    def of(allowed: list[str]) -> Column:
        return F.coalesce(extension.isin(allowed), F.lit(False))

    return (
        F.when(cat_id.between(2000, 2999), of(C.ALLOWED_MOVIE_EXTENSIONS))
        .when(cat_id.between(5000, 5999), of(C.ALLOWED_TV_EXTENSIONS))
        .when(cat_id.between(6000, 6999), of(C.ALLOWED_ADULT_EXTENSIONS))
        .otherwise(F.lit(True))
    )


def min_size(title: Column, cat_id: Column, policy: C.SizePolicy | None = None) -> Column:
    """Exact override (of the dated key, else of the bare title) -> first matching regex -> category floor -> 0."""
    policy = policy or C.SizePolicy()
    expr = None
    if policy.exact:
        m = F.create_map(*[x for k, v in policy.exact.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))])
        own = F.coalesce(F.try_element_at(m, title), F.try_element_at(m, F.regexp_replace(title, r":\d{4}-\d{2}-\d{2}$", "")))
        expr = F.when(own.isNotNull(), own)
    for pat, size in policy.patterns:
        cond = F.regexp_like(title, F.lit(pat))
        v = F.lit(int(size)).cast("long")
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    base = F.coalesce(F.floor(cat_id / 1000).cast("int") * 1000, F.lit(7000))
    floor = None
    for b, size in policy.category_floor.items():
        cond = base == b
        v = F.lit(int(size)).cast("long")
        floor = F.when(cond, v) if floor is None else floor.when(cond, v)
    floor = floor.otherwise(F.lit(0).cast("long")) if floor is not None else F.lit(0).cast("long")
    return floor if expr is None else expr.otherwise(floor)
