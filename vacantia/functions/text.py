"""Text column functions. All of them stay on the JVM side (no Python UDF)."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Every character Unicode counts as whitespace, plus the ASCII separators 1C-1F.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# the same as a pattern; ranges keep the character test short
SPACE_CLASS = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RARE_BREAKS = r"[\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
RARE_BLANKS = r"[\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
# the characters of both, by themselves
RARE_ASCII = tuple(x for x in SPACES if x not in "\t\n " and x.isascii())
RARE_OTHERS = tuple(x for x in SPACES if not x.isascii())
BREAK_CLASS = r"[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def spaced(pattern: str) -> str:
    """Fill the whitespace class into a pattern written with ``{s}``."""
    return pattern.replace("{s}", SPACE_CLASS)


def computed_once(c: Column) -> Column:
    """Keep a large expression from being copied into filters above it.

    Catalyst moves a filter below a projection by substituting the projected
    expressions into it, unless the projection has a non-deterministic column. For the
    long rule ladders that copy is evaluated a second time per row and outgrows what
    can be compiled, so such columns are marked with a condition that is always true.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def filled(template: str, *values: Column) -> Column:
    """A fixed text with a column in place of each ``{}``; NULL if one is NULL."""
    first, *rest = template.split("{}")
    return F.concat(F.lit(first), *[x for value, part in zip(values, rest, strict=True) for x in (value, F.lit(part))])


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def or_default(c: Column, default: Column | str) -> Column:
    """``c`` unless it is NULL or the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def url_key(url: Column) -> Column:
    """Identity of a posting: SHA-256 of its trimmed, lower-cased URL."""
    return F.sha2(F.lower(strip(url)), 256)


def cache_key(company: Column, title: Column, location: Column) -> Column:
    def norm(c: Column) -> Column:
        return F.regexp_replace(F.lower(strip(text_or_empty(c))), SPACE_CLASS + "+", " ")

    return F.concat_ws("|", norm(company), norm(title), norm(location))


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(lowered: Column, phrases: Sequence[str]) -> Column:
    """Does the (already lower-cased) text contain any phrase as a substring?"""
    return _any(F.contains(lowered, F.lit(p.lower())) for p in phrases)


def matches_any(c: Column, phrases: Sequence[str]) -> Column:
    return contains_any(F.lower(text_or_empty(c)), phrases)


def phrase_hits(lowered: Column, phrases: Sequence[str]) -> Column:
    """How many list entries occur in the (already lower-cased) text."""
    ones = (F.contains(lowered, F.lit(p.lower())).cast("int") for p in phrases)
    return reduce(lambda a, b: a + b, ones, F.lit(0))


def first_phrase(lowered: Column, phrases: Sequence[str]) -> Column:
    """The first list entry (in list order) that occurs, else NULL."""
    if not phrases:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(p.lower())), F.lit(p)) for p in phrases])


def contains_word(lowered: Column, phrase: str) -> Column:
    """Whole-word match. The substring test is far cheaper and rejects most rows first."""
    low = phrase.lower()
    return F.contains(lowered, F.lit(low)) & F.rlike(lowered, F.lit(rf"(?U)\b{re.escape(low)}\b"))


def first_word(lowered: Column, phrases: Sequence[str], shown: Callable[[str], str] = str) -> Column:
    """``shown`` of the first list entry that occurs as a whole word, else NULL."""
    if not phrases:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(contains_word(lowered, p), F.lit(shown(p))) for p in phrases])


def quoted(c: Column) -> Column:
    """Quoted form of a text value as it appears in reasons; NULL reads ``None``."""
    body = c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    has_single, has_double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.isNull(), F.lit("None")).when(has_single & ~has_double, double).otherwise(single)


def clean_lines(c: Column) -> Column:
    """Collapse blanks, trim every line and drop the empty ones.

    Most texts hold none of the rare characters, which substring tests tell far faster than the
    patterns for them. The text is bound to a name, so that it is computed once for the test and the steps.
    """
    return F.element_at(F.transform(F.array(c), _cleaned_lines), 1)


def _cleaned_lines(c: Column) -> Column:
    beyond_ascii = F.octet_length(c) != F.length(c)
    rare = contains_any(c, RARE_ASCII) | (beyond_ascii & contains_any(c, RARE_OTHERS))
    double = F.contains(c, F.lit("  ")) | F.contains(c, F.lit("\t"))
    return F.when(rare, _all_lines(c)).when(double, _plain_lines(F.regexp_replace(c, "[ \t]+", " "))).otherwise(_plain_lines(c))


def _all_lines(c: Column) -> Column:
    """A chain of small steps: rare line ends become line feeds, rare blanks at line ends go, the rest is as below."""
    c = F.regexp_replace(c, "[ \t]{2,}|\t", " ")
    c = F.regexp_replace(c, RARE_BREAKS, "\n")
    c = F.regexp_replace(c, f"{RARE_BLANKS}{SPACE_CLASS}*\n", "\n")
    return _plain_lines(c)


def _plain_lines(c: Column) -> Column:
    c = F.replace(c, F.lit(" \n"), F.lit("\n"))
    return strip(F.regexp_replace(c, f"\n{SPACE_CLASS}+", "\n"))


def strip_html(c: Column) -> Column:
    """Cheap markup-to-text for bodies that arrive as HTML fragments."""
    c = text_or_empty(c)
    for tag in ("</p>", "<br>", "<br/>", "<br />", "</li>", "</div>"):
        c = F.replace(c, F.lit(tag), F.lit("\n"))
    c = F.regexp_replace(c, "<[^>]+>", "")
    for entity, char in (
        ("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'),
    ):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return clean_lines(c)


def split_title(c: Column) -> Column:
    """``Company: Title`` at the first ": " -> struct(company, title)."""
    c = text_or_empty(c)
    at = F.instr(c, ": ")
    return F.struct(
        F.when(at > 0, strip(F.substring(c, F.lit(1), at - 1))).otherwise(F.lit("Unknown")).alias("company"),
        F.when(at > 0, strip(F.substring(c, at + 2, F.length(c)))).otherwise(strip(c)).alias("title"),
    )
