"""Byte-exact text functions. Content is decoded as Latin-1, so one character is one byte and offsets agree."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes before a match, bytes in all, and the cap of an excerpt.
EXCERPT_BEFORE, EXCERPT_BYTES, EXCERPT_CAP = 80, 240, 512


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def latin1(content: Column) -> Column:
    """Bytes as text of as many characters."""
    return F.decode(content, "ISO-8859-1")


def ascii_lower(text: Column) -> Column:
    """A to Z made small, all else kept."""
    return F.translate(text, CAPITALS, SMALL)


def word_set(text: Column) -> Column:
    """Distinct words of lower-cased text: runs of letters, digits and underscores."""
    return F.array_distinct(F.filter(F.split(ascii_lower(text), "[^a-z0-9_]+"), lambda w: w != ""))


def line_of(text: Column, position: Column, base: Column | int = 0) -> Column:
    """Line of the 1-based ``position``; ``base`` lines lie before the text."""
    before = F.substring(text, F.lit(1), position - 1)
    base = F.lit(base) if isinstance(base, int) else base
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + base + 1).cast("int")


def beyond_java(text: Column) -> Column:
    """Whether ``text`` has code points that Java counts as two characters."""
    return text.rlike(r"[\x{10000}-\x{10FFFF}]")


def code_points(text: Column, position: Column) -> Column:
    """A 1-based ``position`` counted in Java's characters, counted in code points."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-16BE"), F.lit(1), 2 * (position - 1)), "UTF-16BE")) + 1


def excerpt(text: Column, position: Column) -> Column:
    """The bytes around a match, unprintable ones replaced."""
    start = F.greatest(position - EXCERPT_BEFORE, F.lit(1))
    return F.substring(F.regexp_replace(F.substring(text, start, F.lit(EXCERPT_BYTES)), r"[^\x09\x0A\x20-\x7E]", "?"), 1, EXCERPT_CAP)


def glob_regex(pattern: str) -> str:
    """A case-insensitive Java pattern for a glob whose ``*`` also crosses ``/``; a directory's content matches too."""
    body, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            body += ".*"
        elif c == "?":
            body += "."
        elif end > 0:
            body += "[" + pattern[i + 1 : end].replace("\\", "\\\\").replace("!", "^", 1) + "]"
            i = end
        else:
            body += re.escape(c)
        i += 1
    return f"(?is)^{body}(/.*)?$"


def extension(path: Column) -> Column:
    return ascii_lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters' frequencies; 0 for an empty text."""
    n = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    sum_ = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(let(share(c), lambda p: p * F.log2(p))))
    return F.when(F.length(text) > 0, sum_).otherwise(0.0)


def case_transitions(text: Column) -> Column:
    """Switches between small and capital among adjacent letters."""
    return F.regexp_count(text, F.lit("(?<=[a-z])[A-Z]")) + F.regexp_count(text, F.lit("(?<=[A-Z])[a-z]"))


def truncated(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def preview(items: Column, n: int = 3) -> Column:
    """The first ``n`` items joined, and how many more there are."""
    rest = F.size(items) - n
    return F.concat(F.concat_ws(", ", F.slice(items, 1, n)), F.when(rest > 0, F.concat(F.lit(" (+"), rest.cast("string"), F.lit(")"))).otherwise(""))


def clean_line(text: Column, n: int = 120) -> Column:
    """One trimmed line of printable text."""
    return F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F]+", " ")), 1, n)


def normal_path(path: Column) -> Column:
    """Forward slashes, none doubled, none in front."""
    return F.ltrim(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), F.lit("/"))


def https_only(url: Column) -> Column:
    return F.when(url.ilike("https://%"), url).otherwise("")


def human_bytes(n: Column) -> Column:
    out = F.format_string("%.1f GB", n / float(1 << 30))
    out = F.when(n < 1 << 30, F.format_string("%.1f MB", n / float(1 << 20))).otherwise(out)
    out = F.when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def human_seconds(n: Column) -> Column:
    h, m, s = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))
