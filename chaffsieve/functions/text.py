"""Text functions over columns. Lengths are UTF-16 code units, blanks are those of ECMAScript.

Patterns keep to what both Java and RE2 understand, so that the SQL twins can use the same strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks, as the inside of a character class.
WS = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same as characters.
WS_CHARS = "\t\n\x0b\x0c\r                  　﻿"
#: Lines that are boilerplate by their beginning.
BOILERPLATE_PREFIXES = (
    "Continue after ad",
    "Share",
    "Release Time:",
    "## Frequently Asked Questions",
    "Table of contents",
    "On this page",
    "Related articles",
    "Read next",
    "Go deeper with GlobalData",
    "Access deeper industry intelligence",
)
#: The same after `normalized_line`, lower case and `without_trailing_marks`.
PREFIX_KEYS = tuple(p.lstrip("# ").rstrip(":").lower() for p in BOILERPLATE_PREFIXES)
SHORT_LINE, TITLE_RESIDUAL, TITLE_LINE = 40, 40, 20

TRIM = rf"^[{WS}]+|[{WS}]+\z"
LINE_MARKS = rf"^[#*{WS}-]+"
TRAILING_MARKS = rf"[\p{{P}}\p{{S}}{WS}]+\z"
BYLINE = rf"^[{WS}]*(by|via|from)([^A-Za-z0-9_]|\z)|^[{WS}]*[-–—|·]"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapsed(c: Column) -> Column:
    """Every run of blanks as one blank. Patterns with the long class of blanks cost far more than a translation."""
    plain = F.translate(c, WS_CHARS, " " * len(WS_CHARS))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, "  +", " ")).otherwise(plain)


def utf16_length(c: Column) -> Column:
    return F.shiftright(F.octet_length(F.encode(c, "UTF-16BE")), 1)


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{WS}]")


def normalized_line(c: Column) -> Column:
    """Without leading list and heading marks; case and inner blanks stay."""
    return trimmed(F.regexp_replace(c, LINE_MARKS, ""))


def without_trailing_marks(c: Column) -> Column:
    return F.regexp_replace(c, TRAILING_MARKS, "")


def line_key(c: Column) -> Column:
    return without_trailing_marks(F.lower(normalized_line(c)))


def matches_prefix(c: Column, keys: tuple[str, ...] = PREFIX_KEYS) -> Column:
    """The whole line, or the beginning of a short one up to a word's end."""
    key = line_key(c)
    short = (utf16_length(key) <= SHORT_LINE) & key.rlike(prefix_pattern(keys))
    # One look at the line's beginning spares most lines the rest.
    return c.rlike(rf"(?iu)^[#*{WS}-]*({'|'.join(keys)})") & (key.isin(*keys) | short)


def prefix_pattern(keys: tuple[str, ...] = PREFIX_KEYS) -> str:
    return f"^({'|'.join(keys)})([^a-z0-9]|\\z)"


def normalized_title(c: Column) -> Column:
    bare = trimmed(F.regexp_replace(trimmed(c), "^[#*-]+", ""))
    return F.lower(collapsed(bare))


def is_title_only(c: Column, title: Column) -> Column:
    return normalized_title(c) == normalized_title(title)


def repeats_title(c: Column, title: Column) -> Column:
    """The title, or a long beginning of it that leaves out only a short byline."""
    line, whole = normalized_title(c), normalized_title(title)
    rest = F.substring(whole, F.length(line) + F.lit(1), F.length(whole))
    cut = (
        F.startswith(whole, line)
        & rest.rlike(BYLINE)
        & (utf16_length(rest) <= TITLE_RESIDUAL)
        & (utf16_length(rest) < utf16_length(line))
        & (utf16_length(line) >= TITLE_LINE)
    )
    return (line != "") & (whole != "") & ((line == whole) | cut)


def without_heading_mark(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, "^ {0,3}#{1,6}[ \\t]+", ""))


def may_hold_code(c: Column) -> Column:
    """Texts in which a line-by-line pass could find code; all others have none."""
    return c.rlike(r"`|~~~|\t|    ")


def normalized_prose(c: Column) -> Column:
    """Heading marks go, bold marks at word bounds go, blanks collapse."""
    bare = F.when(F.contains(c, F.lit("#")), F.regexp_replace(c, rf"(?m)^[{WS}]*#{{1,6}}[{WS}]+", "")).otherwise(c)
    # ECMAScript's \w and dot: no line end inside the bold span.
    bold = rf"(?<![A-Za-z0-9_])\*\*([^{WS}](?:[^\n\r  ]*?[^{WS}])?)\*\*(?![A-Za-z0-9_])"
    plain = F.when(F.contains(bare, F.lit("**")), F.regexp_replace(bare, bold, "$1")).otherwise(bare)
    return trimmed(collapsed(plain))


def lines_of(c: Column) -> Column:
    return F.split(c, "\\r?\\n", -1)


def is_empty_takeaways(c: Column, title: Column) -> Column:
    """Two lines with words: the page title as heading, and the bare section name."""
    lines = F.filter(F.transform(lines_of(c), trimmed), lambda x: x != "")
    first, second = F.get(lines, 0), F.get(lines, 1)
    heading = trimmed(F.substring(first, F.lit(3), F.length(first)))
    section = trimmed(F.regexp_replace(F.regexp_replace(second, rf"^#{{1,6}}[{WS}]+", ""), r"^\*\*(.*?)\*\*\z", "$1"))
    named = (title == heading) | F.startswith(title, F.concat(heading, F.lit(" - "))) | F.startswith(
        title, F.concat(heading, F.lit(" | "))
    )
    return F.coalesce((F.size(lines) == 2) & first.startswith("# ") & named & (F.lower(section) == "key takeaways"), F.lit(False))


def needs_line_pass(c: Column, title: Column) -> Column:
    """Whether boilerplate lines or repeats of the title could go, or code regions matter. False for most texts: their
    lines need no look at all. It may be true for texts of which nothing goes."""
    listed = c.rlike(rf"(?ium)^[#*{WS}-]*({'|'.join(PREFIX_KEYS)})")
    word = F.substring(F.substring_index(normalized_title(title), " ", 1), 1, TITLE_LINE)
    twice = F.length(c) - F.length(F.replace(F.lower(c), word, F.lit(""))) >= 2 * F.length(word)
    return listed | (c.contains("\n") & (word != "") & twice)


def plain_stripped(c: Column) -> Column:
    """What stripping leaves of a text that needs no pass over its lines."""
    return trimmed(F.regexp_replace(c, "\\r\\n", "\n"))
