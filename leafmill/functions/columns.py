"""The engine's scalar functions as column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..answers import is_cjk_language
from ..prompts import LANGUAGES

#: Web and mail addresses, in Java's dialect with Unicode classes.
ADDRESS = r"(?U)(?:https?://|ftp://|www\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
PLACEHOLDER = r"<\s*(/?)\s*[xX](\d+)\s*(/?)\s*>"
CJK = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af]"
LOWER_WORD = "(?<![A-Za-z])[a-z]{2,}(?![A-Za-z])"
SPACE = " \t\n\r\f"
LINK = r"""(?:href|src)\s*=\s*["']([^"']+)["']|url\(\s*["']?([^"')]+)"""


def squeeze(text: Column) -> Column:
    """Runs of HTML white space as one space, none at the ends; a no-break space is none."""
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f]+", " "), F.lit(SPACE))


def without_addresses(text: Column) -> Column:
    """Addresses as single spaces. Texts without a sign of any are passed by the costly pattern."""
    may = text.contains("@") | text.contains("://") | text.contains("www.")
    return F.when(may, F.regexp_replace(text, ADDRESS, " ")).otherwise(text)


def has_words(text: Column) -> Column:
    """Whether there is a letter outside of addresses; false for null."""
    return F.coalesce(without_addresses(text).rlike(LETTER), F.lit(False))


def strip_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def plain(source: Column) -> Column:
    """A source without placeholders and addresses; what the echo test reads. Worth a column of its own where it is read twice."""
    return without_addresses(F.regexp_replace(source, PLACEHOLDER, " "))


def looks_untranslated(source: Column, text: Column, target: str, plain_source: Column | None = None) -> Column:
    """Whether a sizeable piece of prose came back in the source language."""
    bare = plain(source) if plain_source is None else plain_source
    words = _count(bare, r"(?U)\S+")
    if not is_cjk_language(target):
        same = F.array_join(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1), " ") == F.array_join(F.regexp_extract_all(source, F.lit(r"(?U)(\S+)"), 1), " ")
        return (words >= 8) & same
    # The cheap conditions come first: most answers hold Chinese, Japanese or Korean, or none at all.
    chinese = text.rlike(CJK)
    long = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(f"({LOWER_WORD})"), 1)), lambda w: F.length(w) >= 4)
    kept = F.array_intersect(long, F.regexp_extract_all(F.lower(text), F.lit(f"({LOWER_WORD})"), 1))
    half = chinese & ~source.rlike(PLACEHOLDER) & (words <= 10) & (F.size(kept) > 0) & (F.size(kept) < F.size(long))
    echo = ~chinese & ~bare.rlike(CJK) & (_count(bare, "[A-Za-z]") >= 30) & (_count(bare, LOWER_WORD) >= 5)
    return half | echo


def references(text: Column) -> Column:
    """The links of a text file as written, but for outside ones, fragments, data and mail."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({LINK})"), 1), lambda x: F.coalesce(F.nullif(F.regexp_extract(x, LINK, 1), F.lit("")), F.regexp_extract(x, LINK, 2)))
    return F.filter(found, lambda x: (x != "") & ~x.contains("://") & ~x.startswith("#") & ~x.startswith("data:") & ~x.startswith("mailto:"))


def kind_of_status(status: Column) -> Column:
    return F.when(status.isin(401, 402, 403, 404), "fatal").when(status.isNull() | (status >= 500) | status.isin(408, 409, 425, 429), "retry").otherwise("request")


def language_name(code: Column) -> Column:
    key = F.translate(F.lower(F.trim(code)), "_", "-")
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(names, key), F.element_at(names, F.substring_index(key, "-", 1)), code)


def retry_reason(truncated: Column, faults: Column) -> Column:
    return F.when(truncated, "truncated").when(F.exists(faults, lambda x: F.size(x) > 0), "invalid").otherwise("missing")


def document_title(segments: Column, path: Column) -> Column:
    """The first heading, else the title, without placeholders; else the base name."""

    def first(kind):
        return F.get(F.filter(segments, lambda s: s.kind == kind), F.lit(0)).source

    return F.coalesce(strip_placeholders(F.coalesce(first("heading"), first("title"))), F.substring_index(path, "/", -1))


def request_payload(segments: Column) -> Column:
    """The segments as a request names them; only headings and titles have a kind."""
    return F.to_json(F.transform(segments, lambda s: F.struct(s.id.alias("id"), F.when(s.kind.isin("heading", "title"), "heading").alias("kind"), s.source.alias("text"))))


def shortened(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def issue_text(kind: Column, seg: Column, last: Column, detail: Column) -> Column:
    where = F.when(seg.isNull(), "whole document").when(last != seg, F.concat(F.lit("segments "), seg, F.lit("–"), last)).otherwise(F.concat(F.lit("segment "), seg))
    said = F.when(kind == "placeholder", F.concat(F.lit("placeholders don't add up ("), detail, F.lit("); the words are kept without inline markup")))
    said = said.when(kind == "missing", F.when(detail == "truncated", "the answer was cut off; the source stays").otherwise("no answer; the source stays"))
    said = said.when(kind == "untranslated", "came back as it was; perhaps not translated").when(kind == "request", F.concat(F.lit("the request was refused; the source stays ("), detail, F.lit(")")))
    said = said.when(kind == "parse", F.concat(F.lit("not well-formed; left as it was ("), detail, F.lit(")"))).otherwise(F.concat_ws(" ", kind, detail))
    return F.concat(where, F.lit(": "), said)
