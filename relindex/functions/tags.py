"""Scene-style tag extractors (music, book, studio/site) and the combined
subject tag list. Each extractor is a set of ``regexp_extract`` calls on one
constant pattern, which Spark compiles once per task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import extract_tags

_AUDIO = "|".join(C.AUDIO_EXTENSIONS)
_BOOK = "|".join(C.BOOK_EXTENSIONS)

# a run that matches from its middle matches from its start, so only starts of runs are tried
MUSIC_RE = rf"(?i)(?<![^-])([^-]++)-([^-]++)-(\d{{4}})-({_AUDIO})(?:-(\d{{3}}))?"
BOOK_RE = rf"(?i)(?<![^-])([^-]++)-([^-]++)-(\d{{4}})-({_BOOK})(?:-(\d{{10,13}}))?"
STUDIO_RE = r"(?i)(?<![A-Za-z0-9])([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+)\.(\d{4})\.(\d{3,4}p)"
SITE_RE = r"(?i)(?<![A-Za-z0-9])([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+)\.(\d{4}\.\d{2}\.\d{2})"


def _found(subject: Column, pattern: str, gate: Column | None) -> Column:
    """The part of the subject that the pattern matches (no pattern matches an empty one), searched once and only
    behind the gate; its groups are then read from this short text. Empty or NULL without a match."""
    hit = F.regexp_extract(subject, pattern, 0)
    return hit if gate is None else F.when(gate, hit)


def _spaced(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit(" "))


def music_gate(low: Column) -> Column:
    return _any_contains(low, [e.lower() for e in C.AUDIO_EXTENSIONS])


def book_gate(low: Column) -> Column:
    return _any_contains(low, [e.lower() for e in C.BOOK_EXTENSIONS])


def studio_gate(low: Column) -> Column:
    return _any_contains(low, C.STUDIO_GATES)


def music_match(subject: Column, gate: Column | None = None) -> Column:
    return _found(subject, MUSIC_RE, gate)


def book_match(subject: Column, gate: Column | None = None) -> Column:
    return _found(subject, BOOK_RE, gate)


def studio_match(subject: Column, gate: Column | None = None) -> Column:
    return _found(subject, STUDIO_RE, gate)


def site_match(subject: Column, gate: Column | None = None) -> Column:
    return _found(subject, SITE_RE, gate)


def _dashed(hit: Column, names: list[str]) -> Column:
    """Struct of the groups of ``MUSIC_RE`` or ``BOOK_RE`` in a match: no group holds the dash between them."""
    parts = F.split(F.when(hit != "", hit), "-")
    return F.struct(*[(F.upper(_spaced(F.get(parts, F.lit(i)))) if n == "format" else _spaced(F.get(parts, F.lit(i)))).alias(n)
                      for i, n in enumerate(names)])


def music_parts(hit: Column) -> Column:
    """B10 from the match of ``music_match``."""
    return _dashed(hit, ["artist", "album", "year", "format", "bitrate"])


def book_parts(hit: Column) -> Column:
    """B11 from the match of ``book_match``."""
    return _dashed(hit, ["author", "title", "year", "format", "isbn"])


def music_tags(subject: Column, gate: Column | None = None) -> Column:
    """struct(artist, album, year, format, bitrate); NULL fields when
    absent. With ``gate`` the regex only runs where the cheap substring test passed."""
    return music_parts(music_match(subject, gate))


def book_tags(subject: Column, gate: Column | None = None) -> Column:
    """struct(author, title, year, format, isbn)."""
    return book_parts(book_match(subject, gate))


def studio_site_tags(subject: Column, gate: Column | None = None) -> Column:
    """``Studio.Name.YYYY.1080p`` first, else ``Site.Name.YYYY.MM.DD``."""
    studio = studio_match(subject, gate)
    none = F.coalesce(studio, F.lit("")) == ""
    return studio_site_parts(studio, site_match(subject, none if gate is None else gate & none))


def studio_site_parts(studio: Column, site: Column) -> Column:
    """B12 from the matches of both patterns (NULL or empty: none); ``site`` counts where there is no ``studio``."""
    is_studio, is_site = F.coalesce(studio, F.lit("")) != "", F.coalesce(site, F.lit("")) != ""

    def name(hit: Column, n: int) -> Column:  # all but the last ``n`` parts between dots
        return _spaced(F.substring(hit, F.lit(1), F.length(hit) - F.length(F.substring_index(hit, ".", -n)) - 1))

    return F.struct(
        F.when(is_studio, name(studio, 2)).alias("studio"),
        F.when(~is_studio & is_site, name(site, 3)).alias("site"),
        F.when(is_studio, F.substring_index(F.substring_index(studio, ".", -2), ".", 1))
        .when(is_site, F.substring_index(site, ".", -3))
        .alias("date"),
        F.when(is_studio, F.substring_index(studio, ".", -1)).alias("resolution"),
    )


def _any_contains(lower: Column, needles: list[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | lower.contains(n)
    return cond


def combine_tags(subject: Column, generic: Column, m: Column, b: Column, x: Column, low: Column | None = None) -> Column:
    """B13 from precomputed parts: generic bracket tags, then extractor values
    (each behind its substring gate), lowered, order-preserving distinct.

    Slot order reproduces an insertion-ordered dict in which a later
    extractor overrides a shared key (``year``, ``format``) in place.
    """
    low = F.lower(subject) if low is None else low
    use_m = m["year"].isNotNull() & music_gate(low)
    use_b = b["year"].isNotNull() & book_gate(low)
    use_x = x["date"].isNotNull() & studio_gate(low)

    def g(flag: Column, v: Column) -> Column:
        return F.when(flag, F.lower(v))

    with_music = F.array(
        F.lower(m["artist"]), F.lower(m["album"]),
        F.coalesce(g(use_b, b["year"]), F.lower(m["year"])),
        F.coalesce(g(use_b, b["format"]), F.lower(m["format"])),
        F.lower(m["bitrate"]),
        g(use_b, b["author"]), g(use_b, b["title"]), g(use_b, b["isbn"]),
    )
    without_music = F.array(
        g(use_b, b["author"]), g(use_b, b["title"]), g(use_b, b["year"]),
        g(use_b, b["format"]), g(use_b, b["isbn"]),
    )
    slots = F.when(use_m, with_music).otherwise(without_music)
    xslots = F.when(use_x, F.array(F.lower(F.coalesce(x["studio"], x["site"])), F.lower(x["date"]), F.lower(x["resolution"]))).otherwise(
        F.array().cast("array<string>")
    )
    nothing = F.array(F.lit(None).cast("string"), F.lit(""))
    found = F.concat(generic, F.array_except(F.concat(slots, xslots), nothing))
    return F.array_distinct(F.when(use_m | use_b | use_x, found).otherwise(generic))


def subject_tags(subject: Column) -> Column:
    """B13 on a raw subject column."""
    return combine_tags(subject, extract_tags(subject), music_tags(subject), book_tags(subject),
                        studio_site_tags(subject))
