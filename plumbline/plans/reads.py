"""The read queries over published tables: lists, pages, search, history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import citation as C
from ..functions import measure as M
from ..functions import scalar as S
from ..functions import text as T
from ..operators import jurisdiction, series, tree

Tables = dict[str, DataFrame]


def agencies(t: Tables, parent: str | None = None, top_only: bool = False, title: int | None = None, q: str | None = None, sort: str = "name", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of organisations with their totals; each filter is optional. An organisation without a total has null words."""
    a = t["agency"].join(t["agency_rollup"].withColumnRenamed("agency_slug", "slug"), "slug", "left").withColumnRenamed("deduplicated", "words")
    if top_only:
        a = a.filter("parent_slug is null")
    if parent is not None:
        a = a.filter(F.col("parent_slug") == parent)
    if title is not None:
        a = a.join(t["agency_cfr_reference"].filter(F.col("title") == title), "slug", "left_semi")
    if q:
        a = a.filter(T.contains_folded(F.col("slug"), q) | T.contains_folded(F.col("display_name"), q) | T.contains_folded(F.col("sortable_name"), q))
    return series.page(a, min(max(limit, 1), 500), offset, *series.agency_sort(sort))


def agency(t: Tables, slug: str) -> DataFrame:
    """An organisation's scopes with their nodes and how many share them."""
    r = t["agency_cfr_reference"].filter(F.col("slug") == slug)
    n = t["structure_node"].select("citation", "words", "status", "reason")
    return r.join(n, F.col("ref_key") == F.col("citation"), "left").join(t["scope_overlap"], "ref_key", "left").select("ref_key", "citation", "words", F.coalesce("status", F.lit("not_computed")).alias("status"), "reason", F.coalesce("agency_count", F.lit(1)).alias("agency_count"), S.parse_slugs(F.col("agency_slugs")).alias("agency_slugs"))


def family(t: Tables, slug: str) -> DataFrame:
    """The parent and children of an organisation."""
    a = t["agency"]
    me = a.filter(F.col("slug") == slug).select(F.col("parent_slug").alias("above"))
    up = a.join(me, F.col("slug") == F.col("above"), "left_semi").select(F.lit("parent").alias("relation"), "slug", "display_name")
    return up.unionByName(a.filter(F.col("parent_slug") == slug).select(F.lit("child").alias("relation"), "slug", "display_name"))


def titles(t: Tables) -> DataFrame:
    """Titles with their words and counts of parts and sections."""
    n = t["structure_node"]
    count = n.withColumn("number", F.regexp_extract("citation", r"^title-(\d+)", 1).try_cast("int")).groupBy("number").agg(F.count_if(F.col("node_type") == "part").alias("parts"), F.count_if(F.col("node_type") == "section").alias("sections"))
    top = n.select(F.col("citation").alias("c"), "words", "status", "reason")
    return t["title"].join(top, F.concat(F.lit("title-"), F.col("number").cast("string")) == F.col("c"), "left").join(count, "number", "left").drop("c").orderBy("number")


def structure(t: Tables, root: str, depth: int | None = None, limit: int = 1000) -> DataFrame:
    """A subtree in document order, and whether it was cut off."""
    n = t["structure_node"].filter(C.within(F.col("citation"), root))
    if depth is not None:
        n = n.filter(F.size(F.split("citation", "/")) <= len(root.split("/")) + depth)
    return series.limited(n, limit, F.col("doc_pos"), F.col("citation"))


def part(t: Tables, title: int, number: str) -> DataFrame:
    """A part with counts of what is below it and the organisations that cover it."""
    n = t["structure_node"].filter((F.col("node_type") == "part") & (F.col("identifier") == number) & F.col("citation").startswith(f"title-{title}/")).orderBy("citation").limit(1)
    inside = t["structure_node"].filter(F.col("citation").startswith(f"title-{title}/"))  # pushed to the scan; the part is then met by an equi-join
    below = tree.with_ancestors(inside.select("citation", "node_type")).join(F.broadcast(n.select(F.col("citation").alias("p"))), F.col("ancestor") == F.col("p")).groupBy("p").agg(*[F.count_if(F.col("node_type") == k).alias(f"{k}s") for k in ("section", "subpart", "appendix")])
    levels = [F.nullif(F.regexp_extract("citation", rf"(?:^|/){k}-([^/]+)", 1), F.lit("")).alias(k) for k in C.LEVELS]
    who = jurisdiction.covering(n.select(F.col("citation").alias("part_key"), F.lit(title).alias("title"), *levels), t["agency_cfr_reference"]).groupBy("part_key").agg(F.array_sort(F.collect_list("slug")).alias("agencies"))
    return n.join(below, F.col("citation") == F.col("p"), "left").join(who, F.col("citation") == F.col("part_key"), "left").drop("p", "part_key")


SEARCHED = ("chapter", "subchapter", "subtitle", "part")


def resolve(t: Tables, q: str) -> DataFrame:
    """The node that a citation names, or no row: a part by its number, else the narrowest level named, a section by its title."""
    node = t["structure_node"]
    want = node.sparkSession.range(1).select(C.parse_query(F.lit(q)).alias("c")).filter("c is not null").select(F.concat(F.lit("title-"), F.col("c.title").cast("string")).alias("w_title"), F.col("c.level").alias("w_level"), F.col("c.identifier").alias("w_id"))
    key = F.split_part("citation", F.lit("/"), F.lit(1))
    hit = node.join(F.broadcast(want), (key == F.col("w_title")) & (F.col("node_type") == F.col("w_level")) & (F.col("identifier") == F.col("w_id")))  # one row
    return hit.drop("w_title", "w_level", "w_id").orderBy("citation").limit(1)


def search(t: Tables, q: str, limit: int = 20, kind: str = "all") -> DataFrame:
    """(kind, id, label), ranked, at most ``limit``: the cited node, then organisations, titles and nodes whose names contain ``q``.

    Organisations are found by any of their names, those whose display name begins
    with ``q`` first; titles by number; of nodes chapters, subchapters, subtitles and
    parts by label, in this order. Sections are found by citation alone.
    """
    none = F.lit(0)
    begins = F.when(F.startswith(F.lower("display_name"), F.lower(F.lit(q))), 0).otherwise(1)
    rank = F.coalesce(*[F.when(F.col("node_type") == x, i) for i, x in enumerate(SEARCHED)])
    has = lambda c: F.coalesce(T.contains_folded(F.col(c), q), F.lit(False))
    number = F.regexp_extract("citation", r"^title-(\d+)", 1).try_cast("int")
    cited = resolve(t, q)
    found = {
        "citation": cited.select(none.alias("r"), none.alias("n"), F.lit("").alias("s"), F.col("citation").alias("id"), "label"),
        "agency": t["agency"].filter(has("name") | has("short_name") | has("display_name")).select(begins.alias("r"), none.alias("n"), F.coalesce("sortable_name", F.lit("")).alias("s"), F.col("slug").alias("id"), F.col("display_name").alias("label")),
        "title": t["title"].filter(has("name")).select(none.alias("r"), F.col("number").alias("n"), F.lit("").alias("s"), F.concat(F.lit("title-"), F.col("number").cast("string")).alias("id"), F.col("name").alias("label")),
        "node": t["structure_node"].filter(F.col("node_type").isin(*SEARCHED) & has("label")).join(F.broadcast(cited.select("citation")), "citation", "left_anti").select(rank.alias("r"), number.alias("n"), F.lit("").alias("s"), F.col("citation").alias("id"), "label"),
    }
    rows = [df.select(F.lit(i).alias("k"), F.lit(name).alias("kind"), "r", "n", "s", "id", "label") for i, (name, df) in enumerate(found.items()) if kind in ("all", name) or name == "citation" and kind != "agency"]
    return reduce(DataFrame.unionByName, rows).orderBy("k", "r", "n", "s", "id").limit(limit).select("kind", "id", "label")


def overlap(t: Tables, sort: str = "agencies", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of shared scopes with their words."""
    n = t["structure_node"].select(F.col("citation").alias("ref_key"), "words")
    return series.page(t["scope_overlap"].join(n, "ref_key", "left"), limit, offset, *series.overlap_sort(sort))


def amendments(t: Tables, title: int | None = None, part: str | None = None, since: str | None = None, until: str | None = None, substantive: bool | None = None, removed: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of amendments, latest first, in a total order, each with a link to its diff."""
    a = t["amendment"]
    for cond in ((F.col("title") == title) if title is not None else None, (F.col("part") == part) if part else None, (F.col("issue_date") >= since) if since else None, (F.col("issue_date") <= until) if until else None, (F.col("substantive") == substantive) if substantive is not None else None, None if removed else ~F.col("removed")):
        if cond is not None:
            a = a.filter(cond)
    return series.page(a, limit, offset, F.desc("issue_date"), F.asc("title"), F.asc("section"), F.desc("amendment_date"))


def corpus(t: Tables) -> DataFrame:
    """One row of totals; a sum of words is null where any of its parts is."""
    n, r = t["structure_node"], t["agency_rollup"]
    kind = lambda k, name: F.count_if(F.col("node_type") == k).alias(name)
    shared = t["scope_overlap"].join(n.select(F.col("citation").alias("ref_key"), "words"), "ref_key", "left")
    history = t["amendment"].agg(F.count("*").alias("amendments")) if "amendment" in t else n.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("amendments"))
    parts = (
        n.agg(F.count("*").alias("nodes"), M.missing(F.col("words")).alias("unknown"), F.count_if(F.col("status") == "reserved_empty").alias("reserved"), F.count_if(C.is_leaf(F.col("node_type"))).alias("leaves"), kind("chapter", "chapters"), kind("part", "parts"), kind("section", "sections")),
        r.agg(F.count("*").alias("agencies"), M.all_or_nothing(F.col("deduplicated")).alias("deduplicated"), M.all_or_nothing(F.col("attributed")).alias("attributed"), F.count_if(F.col("coverage") < 1).alias("partial_agencies")),
        shared.agg(F.count("*").alias("shared_scopes"), M.all_or_nothing(F.col("words")).alias("shared")),
        t["title"].agg(F.count("*").alias("titles"), F.count_if(F.coalesce("reserved", F.lit(False))).alias("titles_reserved")),
        t["agency_cfr_reference"].agg(F.count("*").alias("refs_total")), history,
    )
    return reduce(DataFrame.crossJoin, parts)  # of one row each


def quality(t: Tables, sample: int = 50) -> DataFrame:
    """Unmeasured nodes by status and reason, with at most ``sample`` citations and whether there are more."""
    from pyspark.sql import Window

    w = Window.partitionBy("status", "reason")
    q = t["structure_node"].filter("words is null").withColumn("k", F.row_number().over(w.orderBy("citation"))).withColumn("n", F.count("*").over(w))
    return q.filter(F.col("k") <= sample).groupBy("status", "reason", "n").agg(F.array_sort(F.collect_list("citation")).alias("sample")).withColumn("truncated", F.col("n") > sample).orderBy(F.desc("n"), "status", "reason")


def app_meta(t: Tables) -> DataFrame:
    """One row: what is published, and since when; where nothing is, nulls and schema version 0."""
    m = t["app_meta"].filter("id = 1")
    default = m.sparkSession.range(1).select(F.lit(0).alias("none"))
    names = [c for c in m.columns if c not in ("id", "schema_version")]
    return default.join(m, F.lit(True), "left").select(*names, F.coalesce("schema_version", F.lit(0)).alias("schema_version"))


def word_counts(t: Tables, limit: Column | int = 50, offset: int = 0) -> DataFrame:
    return titles(t).offset(offset).limit(limit)
