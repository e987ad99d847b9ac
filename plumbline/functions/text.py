"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x20\x7F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{2013}-\x{2015}\x{2E3A}\x{2E3B}]"


def count_words(text: Column) -> Column:
    """Words by the published rule: hyphen runs separate, invisible marks don't, a word has a letter or digit."""
    plain = F.when(F.contains(text, F.lit("--")), F.regexp_replace(text, "-{2,}", " ")).otherwise(text)
    # from a run's first letter or digit to its end: once for each word, in one pass; invisible marks never end a run.
    # ASCII goes first, by one look into a table, where the whole classes are a chain of ranges
    ends = SEPARATORS[1:-1]
    return F.when(text.isNotNull(), F.regexp_count(plain, F.lit(rf"(?:[0-9A-Za-z]|[\p{{L}}\p{{N}}])[\x21-\x7E]*+(?:[^{ends}\x21-\x7E][\x21-\x7E]*+)*+")).cast("bigint"))


def normalize_identifier(x: Column) -> Column:
    """Without leading section signs and white space, trimmed, upper case."""
    return F.upper(strip_identifier(x))


def strip_identifier(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"^[\s§]+", ""))


NODE_TYPES = ("title", "subtitle", "chapter", "subchapter", "part", "subpart", "subject_group", "section", "appendix")
_DIVISIONS = {"DIV1": "title", "DIV2": "subtitle", "DIV3": "chapter", "DIV4": "subchapter", "DIV5": "part", "DIV6": "subpart", "DIV7": "subject_group", "DIV8": "section", "DIV9": "appendix"}
_TYPES = {"TITLE": "title", "SUBTITLE": "subtitle", "CHAPTER": "chapter", "SUBCHAP": "subchapter", "SUBCHAPTER": "subchapter", "PART": "part", "SUBPART": "subpart", "SUBJGRP": "subject_group", "SECTION": "section", "APPENDIX": "appendix"}


def node_type(element: Column, type_attribute: Column) -> Column:
    """By the TYPE attribute where it is known, else by the element's name."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs(_TYPES), F.upper(type_attribute)), F.try_element_at(pairs(_DIVISIONS), F.upper(element)))


def is_reserved(head: Column) -> Column:
    return F.coalesce(head.rlike(r"(?i)\[\s*reserved\s*\]"), F.lit(False))


def register_citations(text: Column) -> Column:
    """Distinct ``n FR n`` citations in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+\s+FR\s+\d+)"), 1))


def strip_label(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^\s*(?:authority|source|citation)\s*:\s*", "")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def diff_lines(text: Column) -> Column:
    """Lines with white space collapsed, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def slug(text: Column) -> Column:
    """Characters unsafe in a path become one hyphen each run."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")


def range_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first).otherwise(F.concat(first, F.lit("--"), last))


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral; null for what isn't one."""
    digits = F.transform(F.split(F.upper(text), ""), lambda c: F.try_element_at(F.create_map(*[F.lit(x) for kv in dict(I=1, V=5, X=10, L=50, C=100, D=500, M=1000).items() for x in kv]), c))
    step = lambda acc, x: F.struct((acc["sum"] + F.when(acc["last"] < x, x - 2 * acc["last"]).otherwise(x)).alias("sum"), x.alias("last"))
    value = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step)["sum"]
    return F.when(text.rlike(r"(?i)^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(text) > 0), value)


def chunks(text: Column) -> Column:
    """Runs of digits and of other characters."""
    return F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)


def natural_key(text: Column) -> Column:
    """A string whose order is the natural one: digit runs by value."""
    return F.array_join(F.transform(chunks(text), lambda c: F.when(c.rlike(r"^\d+$"), F.lpad(c, 12, "0")).otherwise(F.lower(c))), "")


def sanitize(text: Column) -> Column:
    """Without NUL characters; what isn't valid UTF-8 is replaced."""
    return F.replace(F.make_valid_utf8(text), F.lit("\x00"), F.lit("�"))


def wrap_fragment(heading: Column, body: Column) -> Column:
    return F.concat(F.lit("<article><h1>"), escape_html(heading), F.lit("</h1>"), body, F.lit("</article>"))


def format_int(n: Column) -> Column:
    """Grouped by thousands; a dash for unknown."""
    return F.coalesce(F.format_number(n, 0), F.lit("—"))


def format_compact(n: Column, billions: bool = True) -> Column:
    """K, M or B with one decimal; without ``billions`` M goes on."""
    x = n.cast("double")
    scaled = lambda d, s: F.concat(F.format_string("%.1f", x / d), F.lit(s))
    shown = F.when(n.isNull(), "—")
    if billions:
        shown = shown.when(x >= 1e9, scaled(1e9, "B"))
    return shown.when(x >= 1e6, scaled(1e6, "M")).when(x >= 1e3, scaled(1e3, "K")).otherwise(n.cast("string"))


def redact_email(text: Column) -> Column:
    return F.regexp_replace(text, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")


def like_pattern(q: Column) -> Column:
    """A contains-pattern with the wildcards of ``q`` escaped by a backslash."""
    return F.concat(F.lit("%"), F.regexp_replace(q, r"([\\%_])", r"\\$1"), F.lit("%"))


def contains_folded(text: Column, q: Column | str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(q) if isinstance(q, str) else q))
