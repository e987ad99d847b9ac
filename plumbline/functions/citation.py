"""Scopes, citations and their canonical strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("subtitle", "chapter", "subchapter", "part")


def blank(x: Column) -> Column:
    return F.when(x != "", x)


def to_scope(title: Column, **levels: Column) -> Column:
    """A scope struct; empty levels are absent."""
    return F.struct(title.cast("int").alias("title"), *[blank(levels.get(k, F.lit(None).cast("string"))).alias(k) for k in LEVELS])


def ref_key(scope: Column) -> Column:
    """``title-4/chapter-I/part-60``; absent and empty levels are left out."""
    return F.concat_ws("/", F.concat(F.lit("title-"), scope["title"].cast("string")), *[F.concat(F.lit(f"{k}-"), blank(scope[k])) for k in LEVELS])


def parse_ref_key(key: Column) -> Column:
    """The scope of a key: each segment is split at its first hyphen, unknown levels are skipped; null without a title."""
    pairs = F.transform(F.split(key, "/"), lambda s: F.struct(F.substring_index(s, "-", 1).alias("k"), s.substr(F.instr(s, "-") + 1, F.length(s)).alias("v")))
    value = lambda name: F.try_element_at(F.transform(F.filter(pairs, lambda p: p["k"] == name), lambda p: p["v"]), F.lit(1))
    title = value("title").try_cast("int")
    return F.when(title.isNotNull(), F.struct(title.alias("title"), *[blank(value(k)).alias(k) for k in LEVELS]))


def narrowest_level(scope: Column) -> Column:
    return F.coalesce(*[F.when(blank(scope[k]).isNotNull(), F.lit(k)) for k in reversed(LEVELS)], F.lit("title"))


def narrowest_identifier(scope: Column) -> Column:
    return F.coalesce(*[blank(scope[k]) for k in reversed(LEVELS)], scope["title"].cast("string"))


def child_citation(parent: Column, kind: Column, identifier: Column, ordinal: Column) -> Column:
    """``parent/type-id``, or ``parent/type-@n`` for a child without an identifier."""
    return F.concat_ws("/", blank(parent), F.concat(kind, F.lit("-"), F.coalesce(blank(identifier), F.concat(F.lit("@"), ordinal.cast("string")))))


def display(scope: Column) -> Column:
    names = {"subtitle": "subtitle", "chapter": "chapter", "subchapter": "subchapter", "part": "part"}
    return F.concat_ws(" ", F.concat(scope["title"].cast("string"), F.lit(" CFR")), *[F.concat(F.lit(f"{n} "), blank(scope[k])) for k, n in names.items()])


def link(base: str, scope: Column) -> Column:
    return F.concat_ws("/", F.lit(base), ref_key(scope))


def section_link(base: str, date: Column, title: Column, section: Column) -> Column:
    return F.concat_ws("/", F.lit(base), F.date_format(date, "yyyy-MM-dd"), F.concat(F.lit("title-"), title.cast("string")), F.concat(F.lit("section-"), section))


_WORD, _NUMBER = r"([0-9a-z]{1,8})", r"([0-9]{1,4}[a-z]?)"
_FORMS = (
    r"(?i)^(?:(\d{1,2})\s*cfr\s*(?:(?:§\s*)?(\d{1,4}[a-z]?\.[0-9a-z]{1,12}(?:-[0-9a-z]{1,12}){0,4})"
    rf"|(?:part|pt\.?)\s*{_NUMBER}|(?:chapter|ch\.?)\s*{_WORD}|(?:subchapter|subch\.?)\s*{_WORD}|subtitle\s*{_WORD}|{_NUMBER})|title[\s-]*(\d{{1,2}})"
    rf"|title-(\d{{1,2}})(?:/subtitle-{_WORD})?(?:/chapter-{_WORD})?(?:/subchapter-{_WORD})?(?:/part-{_NUMBER})?)$"
)
#: The pattern's groups that a level may come from.
_GROUPS = {"title": (1, 8, 9), "section": (2,), "part": (3, 7, 13), "chapter": (4, 11), "subchapter": (5, 12), "subtitle": (6, 10)}


def parse_query(q: Column) -> Column:
    """(title, a column a level, level, identifier) of a citation typed by a reader, or of a scope's key; null for any other text.

    ``level`` and ``identifier`` are what it resolves to: the narrowest one named,
    and the title for a section, whose citation carries no part. Titles are 1 to
    50, at most 64 characters are read; letters of all but parts and sections are upper case.
    """
    q = F.trim(q)
    # all groups by one match
    groups = F.split(F.regexp_replace(q, _FORMS, "\x01".join(f"${k}" for k in range(1, 14))), "\x01")

    def struct(g: Column) -> Column:
        value = {k: blank(F.concat(*[F.element_at(g, i) for i in at])) for k, at in _GROUPS.items()}
        value |= {k: F.upper(value[k]) for k in ("chapter", "subchapter", "subtitle")}
        level = F.coalesce(*[F.when(value[k].isNotNull(), F.lit(k)) for k in reversed(LEVELS)], F.lit("title"))
        title = value["title"].cast("int")
        ident = F.coalesce(*[value[k] for k in reversed(LEVELS)], title.cast("string"))
        return F.struct(title.alias("title"), *[value[k].alias(k) for k in (*LEVELS, "section")], level.alias("level"), ident.alias("identifier"))

    cited = q.rlike(_FORMS) & F.length(q).between(1, 64)
    found = F.filter(F.transform(F.when(cited, F.array(groups)), struct), lambda x: x["title"].between(1, 50))
    return F.try_element_at(found, F.lit(1))


def ancestors(citation: Column) -> Column:
    """All prefixes of a path, itself included, shortest first."""
    parts = F.split(citation, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def within(citation: Column, root: str) -> Column:
    """The node or one below it; pushed to the scan as a prefix."""
    return (citation == root) | citation.startswith(root + "/")


def is_section(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[0-9A-Za-z][0-9A-Za-z.()-]{0,63}$"), F.lit(False))


def is_title(n: Column) -> Column:
    return F.coalesce(n.between(1, 50), F.lit(False))


def is_issue_date(x: Column, first: str = "2017-01-01") -> Column:
    """A real calendar day of the form YYYY-MM-DD, not before ``first``."""
    day = F.try_to_date(x, "yyyy-MM-dd")
    return F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(day, "yyyy-MM-dd") == x) & (day >= F.lit(first).cast("date")), F.lit(False))


def diff_key(title: Column, section: Column, old: Column, new: Column) -> Column:
    return F.concat_ws("/", F.lit("diff"), title.cast("string"), F.translate(section, "/ ", "__"), F.concat(old, F.lit(".."), new))


LEAVES = ("section", "appendix")


def is_leaf(node_type: Column) -> Column:
    return node_type.isin(*LEAVES)


def is_container(node_type: Column, part_id: Column) -> Column:
    """A node whose own text is measured: a part, or anything but a leaf inside one."""
    return ~is_leaf(node_type) & ((node_type == "part") | part_id.isNotNull())


def pretty(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("/"), F.lit(" › ")), F.lit("-"), F.lit(" "))
