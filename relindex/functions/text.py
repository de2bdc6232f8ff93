"""Subject-line column functions (clean, normalize, tags, extension, segment
number, language). Every function maps ``Column -> Column`` with native
expressions so the whole header projection stays inside whole-stage codegen.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def _lit_regex(alts: list[str]) -> str:
    return "|".join(re.escape(a) for a in alts)


def clean_text(c: Column) -> Column:
    """B1: drop NUL and the replacement character (undecodable input)."""
    return F.when(c.contains("\u0000") | c.contains("\ufffd"), F.translate(c, "\u0000\ufffd", "")).otherwise(c)


def plain_ascii(c: Column) -> Column:
    """Whether a text is ASCII: there a pattern finds the same with and without the (slow) flag ``U``."""
    return F.octet_length(c) == F.length(c)


_BRACKETS = r"\[[^\[\]]+\]"
_COUNTER = r"[\(\[]\s*\d+\s*/\s*\d+\s*[\)\]]"
_TAG = r"\[([^\[\]]+)\]"


def _dotless(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("."), F.lit(" ")), F.lit("_"), F.lit(" "))


def _without_noise(subject: Column) -> Column:
    s = F.regexp_replace(_dotless(subject), _BRACKETS, "")
    s = F.regexp_replace(s, r"(?iU)\byenc\b", "")
    s = F.regexp_replace(s, "(?U)" + _COUNTER, "")
    s = F.regexp_replace(s, "(?iU)" + _lit_regex([t for t, _ in C.LANGUAGE_TOKENS]), "")
    s = F.regexp_replace(s, r"(?iU)\b(?:repost|sample)\b", "")
    s = F.regexp_replace(s, r"(?iU)\bpart\s*\d+\b", "")
    s = F.regexp_replace(s, r"(?iU)\b(rar|par2|zip)\b", "")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit("- "))


def _where(c: Column, needles: list[str], pattern: str, to: str = "", first: str | None = None) -> Column:
    """``pattern`` replaced (after ``first`` is removed), searched for only in a text that holds one of the ``needles`` (every match has one)."""
    text = c if first is None else F.regexp_replace(c, first, "")
    return F.when(reduce(or_, [c.contains(n) for n in needles]), F.regexp_replace(text, pattern, to)).otherwise(c)


_TOKENS = [t.lower() for t, _ in C.LANGUAGE_TOKENS]

#: B3 on a lower-case ASCII text without dots, one step after the other. A volume number and an archive's ending are
#: whole words apart from each other, so they go in one step.
_ASCII_STEPS = [
    lambda c: _where(c, ["["], _BRACKETS),
    lambda c: _where(c, ["yenc"], r"\byenc\b"),
    lambda c: _where(c, ["/"], _COUNTER),
    lambda c: _where(c, [*_TOKENS, "repost", "sample"], r"\b(?:repost|sample)\b", first=_lit_regex(_TOKENS)),
    lambda c: _where(c, ["part", "rar", "par2", "zip"], r"\b(?:part\s*\d+|rar|par2|zip)\b"),
    lambda c: F.trim(_where(c, ["  ", "\t", "\n", "\x0b", "\f", "\r"], r"\s+", " "), F.lit("- ")),
]


def with_title(df: DataFrame, subject: str, low: str, name: str) -> DataFrame:
    """The column ``name``: B3 and B1 (``clean_text`` of ``normalize_subject``) from the columns ``subject`` (cleaned) and ``low`` (lower-cased).

    ASCII texts take the steps as columns of their own, so that each reads the one before once computed and skips
    its search where nothing can match; the others take the whole chain."""
    out = df.withColumn(name, F.when(plain_ascii(F.col(subject)), _dotless(F.col(low))))
    for step in _ASCII_STEPS:
        out = out.withColumn(name, step(F.col(name)))
    return out.withColumn(name, F.coalesce(F.col(name), clean_text(normalize_subject(F.col(subject)))))


def normalize_subject(subject: Column, lowercase: bool = True) -> Column:
    """The ordered noise-removal chain; returns the cleaned title."""
    s = _without_noise(subject)
    return F.lower(s) if lowercase else s


def extract_tags(subject: Column) -> Column:
    """Bracket contents split on whitespace/comma, lowered, order kept, duplicates kept."""
    groups = F.regexp_extract_all(subject, F.lit(_TAG), 1)
    # one text of all contents: a split by one character needs no pattern, and empty parts go
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.array_join(groups, ",")), r"(?U)[\s,]+", ","), ","), "")


def file_extension(subject: Column) -> Column:
    """First ``.xx``-``.xxxx`` alnum run followed by a word boundary, lowered."""
    return F.nullif(F.lower(F.regexp_extract(subject, r"\.([A-Za-z0-9]{2,4})\b", 1)), F.lit(""))


def segment_number(subject: Column) -> Column:
    """``n`` of the first ``(n/m)``, else 1."""
    n = F.regexp_extract(subject, r"\((\d+)/\d+\)", 1)
    return F.coalesce(n.try_cast("int"), F.lit(1))


def clean_language_text(subject: Column) -> Column:
    """Drop URLs, then everything but ASCII letters and whitespace; collapse spaces."""
    s = F.regexp_replace(subject, r"(?i)http\S+|www\.\S+", " ")
    s = F.regexp_replace(s, r"(?U)[^A-Za-z\s]+", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def detect_language(subject: Column, enabled: bool = True, upper: Column | None = None) -> Column:
    """Explicit token first (dict order), else ``en`` when letters remain, else NULL.

    ``upper`` is the upper-cased subject if the caller has it as a column. Only a text with a link can lose letters to
    the cleaning, so the others are asked for a letter as they are."""
    if not enabled:
        return F.lit(None).cast("string")
    up = F.upper(subject) if upper is None else upper
    expr = None
    for token, code in C.LANGUAGE_TOKENS:
        cond = up.contains(token)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    letters = F.when(up.contains("HTTP") | up.contains("WWW."), clean_language_text(subject) != "").otherwise(
        F.regexp_like(subject, F.lit("[A-Za-z]")))
    expr = expr.when(F.coalesce(subject, F.lit("")) == "", F.lit(None))
    expr = expr.when(letters, F.lit("en"))
    return expr.otherwise(F.lit(None).cast("string"))


def search_tokens(text: Column) -> Column:
    """Token list of the ``simple`` text configuration: lower-case runs of letters/digits."""
    toks = F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+")
    return F.filter(toks, lambda t: t != "")
