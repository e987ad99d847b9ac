"""Claims of organisations on subtrees: resolution, pruning, regions, and shares that add up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citation as C
from ..functions import measure as M
from ..sources.shared import settle
from .tree import nearest_container, with_ancestors

LEVELS = C.LEVELS


def scope_contains(outer: str, inner: str, strict_levels: bool = True) -> Column:
    """The outer scope has the inner one: same title, each of its levels absent or equal (columns ``<prefix>_<level>``)."""
    cond = F.col(f"{outer}_title") == F.col(f"{inner}_title")
    for k in LEVELS:
        cond &= F.col(f"{outer}_{k}").isNull() | (F.coalesce(F.col(f"{outer}_{k}") == F.col(f"{inner}_{k}"), F.lit(False)))
    return cond


def _wide(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}_{k}") for k in keep], F.col("title").alias(f"{prefix}_title"), *[F.col(k).alias(f"{prefix}_{k}") for k in LEVELS])


def resolve(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each distinct scope's node: an equi-join on (title, type, identifier), with absent outer levels as wildcards.

    claims: slug, ref_key, title, subtitle, chapter, subchapter, part. nodes:
    citation, node_type, identifier, title, subtitle, chapter, subchapter, part,
    words. outcome: resolved, dangling (none) or ambiguous (several).
    """
    scopes = claims.select("ref_key", "title", *LEVELS).dropDuplicates(["ref_key"])
    scope = F.struct("title", *LEVELS)
    scopes = scopes.withColumn("r_type", C.narrowest_level(scope)).withColumn("r_id", C.narrowest_identifier(scope))
    n = nodes.select(F.col("citation"), F.col("node_type"), F.col("identifier"), F.col("title").alias("n_title"), *[F.col(k).alias(f"n_{k}") for k in LEVELS], "words")
    on = (scopes["title"] == n["n_title"]) & (scopes["r_type"] == n["node_type"]) & (scopes["r_id"] == n["identifier"])
    for k in LEVELS:
        on &= scopes[k].isNull() | (scopes[k] == n[f"n_{k}"])
    hits = scopes.join(n, on, "left").groupBy("ref_key").agg(F.count("citation").alias("hits"), F.first("citation", ignorenulls=True).alias("citation"), F.first("words", ignorenulls=True).alias("words"))
    outcome = F.when(F.col("hits") == 0, "dangling").when(F.col("hits") == 1, "resolved").otherwise("ambiguous")
    one = F.col("hits") == 1
    return hits.select("ref_key", "hits", outcome.alias("outcome"), F.when(one, F.col("citation")).alias("citation"), F.when(one, F.col("words")).alias("words"))


def prune_contained(claims: DataFrame) -> DataFrame:
    """Claims that no other claim of the same organisation contains."""
    outer = _wide(claims.select("slug", "ref_key", "title", *LEVELS), "o", "slug", "ref_key")
    inner = _wide(claims.select("slug", "ref_key", "title", *LEVELS), "i", "slug", "ref_key")
    gone = inner.join(outer, (F.col("o_slug") == F.col("i_slug")) & (F.col("o_ref_key") != F.col("i_ref_key")) & scope_contains("o", "i"), "left_semi")
    return claims.join(gone.select(F.col("i_slug").alias("slug"), F.col("i_ref_key").alias("ref_key")), ["slug", "ref_key"], "left_anti")


def overlaps(claims: DataFrame) -> DataFrame:
    """Scopes that several organisations claim, with their slugs in order as JSON."""
    g = claims.groupBy("ref_key").agg(F.count_distinct("slug").alias("agency_count"), F.to_json(F.array_sort(F.collect_set("slug"))).alias("agency_slugs"))
    return g.filter("agency_count > 1")


def even_shares(rows: DataFrame, region: str, words: str, *order: Column) -> DataFrame:
    """``share`` of each row: its region's words divided in whole numbers, the remainder to the first of the order."""
    w = Window.partitionBy(region)
    k = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("share", M.even_share(F.col(words), k, rank))


@dataclass
class Division:
    """Results of ``divide``."""

    agencies: DataFrame  # slug, attributed, deduplicated, refs_total, refs_counted, shared_refs, coverage
    regions: DataFrame  # citation, words, exclusive, admins
    overlaps: DataFrame
    corpus: DataFrame  # words: one row


def divide(agencies: DataFrame, claims: DataFrame, nodes: DataFrame) -> Division:
    """Words of claimed subtrees shared between organisations, so that shares add up to the claimed corpus exactly.

    agencies: slug, sortable_name. Dangling claims count nothing; ambiguous ones
    make what depends on them unknown. Order of claimants: sortable name (Unicode
    collation), then slug.
    """
    claims = claims.dropDuplicates(["slug", "ref_key"])
    # small beside the nodes, and read by all that follows
    claims, found = settle(claims), settle(resolve(claims, nodes))
    effective = prune_contained(claims.join(found.filter("outcome <> 'dangling'").select("ref_key"), "ref_key", "left_semi"))
    effective = settle(effective)
    c = effective.select("slug", "ref_key").join(found.select("ref_key", "citation", "words"), "ref_key")
    own = c.groupBy("slug").agg(M.all_or_nothing(F.col("words")).alias("attributed"))
    region = c.filter("citation is not null").groupBy("citation").agg(F.first("words").alias("words"))
    near = nearest_container(region)
    region = region.join(near, "citation")
    inner = region.filter("container is not null").groupBy(F.col("container").alias("citation")).agg(F.sum("words").alias("inner_words"), F.count_if(F.col("words").isNull()).alias("bad"))
    exact = region.join(inner, "citation", "left").withColumn("rest", F.col("words") - F.coalesce("inner_words", F.lit(0)))
    exact = exact.withColumn("exclusive", F.when((F.coalesce("bad", F.lit(0)) == 0) & (F.col("rest") >= 0), F.col("rest")))
    exact = settle(exact.select("citation", "words", "container", "exclusive"))
    # a region is administered by its claimants and by those of every region around it
    claimants = c.filter("citation is not null").select("citation", "slug").distinct()
    around = with_ancestors(region.select("citation")).join(claimants.withColumnRenamed("citation", "a"), F.col("ancestor") == F.col("a")).select("citation", "slug").distinct()
    names = agencies.select("slug", "sortable_name")
    admins = around.join(exact.select("citation", "exclusive"), "citation").join(names, "slug", "left")
    shares = even_shares(admins, "citation", "exclusive", F.expr("collate(coalesce(sortable_name, slug), 'UNICODE')"), F.col("slug"))
    dedup = shares.groupBy("slug").agg(M.all_or_nothing(F.col("share")).alias("dedup"))
    declared = claims.join(found, "ref_key").groupBy("slug").agg(F.count("*").alias("refs_total"), F.count_if((F.col("outcome") == "resolved") & F.col("words").isNotNull()).alias("refs_counted"))
    multi = overlaps(effective)
    shared = effective.join(multi.select("ref_key"), "ref_key").groupBy("slug").agg(F.count("*").alias("shared_refs"))
    a = agencies.select("slug").join(own, "slug", "left").join(dedup, "slug", "left").join(declared, "slug", "left").join(shared, "slug", "left")
    has = c.select("slug").distinct().withColumn("has", F.lit(True))
    a = a.join(has, "slug", "left")
    a = a.select(
        "slug", F.when(F.col("has").isNull(), 0).otherwise(F.col("attributed")).alias("attributed"),
        F.when(F.col("has").isNull(), 0).when(F.col("attributed").isNotNull(), F.col("dedup")).alias("deduplicated"),
        F.coalesce("refs_total", F.lit(0)).alias("refs_total"), F.coalesce("refs_counted", F.lit(0)).alias("refs_counted"), F.coalesce("shared_refs", F.lit(0)).alias("shared_refs"),
        F.when(F.coalesce("refs_total", F.lit(0)) == 0, 1.0).otherwise(F.col("refs_counted") / F.col("refs_total")).alias("coverage"),
    )
    scopes = c.select("ref_key", "words").distinct()
    known = scopes.agg(F.count("*").alias("n"), F.count_if(F.col("words").isNull()).alias("bad"))
    outermost = exact.filter("container is null").agg(F.sum("words").alias("w"))
    corpus = known.crossJoin(outermost).select(F.when((F.col("n") > 0) & (F.col("bad") == 0), F.col("w")).alias("words"))
    listed = admins.groupBy("citation").agg(F.array_sort(F.collect_set("slug")).alias("admins"))
    return Division(a, exact.join(listed, "citation").select("citation", "words", "exclusive", "admins"), multi, corpus)


def subtree_totals(division: Division, family: DataFrame, claims: DataFrame, found: DataFrame) -> DataFrame:
    """Of each organisation and those below it (family: ancestor, descendant): attributed over distinct scopes, and summed shares."""
    d = family.join(division.agencies.select(F.col("slug").alias("descendant"), "deduplicated"), "descendant").groupBy("ancestor").agg(M.all_or_nothing(F.col("deduplicated")).alias("deduplicated"))
    joint = family.join(claims.withColumnRenamed("slug", "descendant"), "descendant").select(F.col("ancestor").alias("slug"), "ref_key", "title", *LEVELS).dropDuplicates(["slug", "ref_key"])
    a = prune_contained(joint).join(found.filter("outcome <> 'dangling'").select("ref_key", "words"), "ref_key").groupBy(F.col("slug").alias("ancestor")).agg(M.all_or_nothing(F.col("words")).alias("attributed"))
    return d.join(a, "ancestor", "left").select(F.col("ancestor").alias("slug"), F.coalesce("attributed", F.when(F.col("deduplicated") == 0, F.lit(0))).alias("attributed"), "deduplicated")


def covering(parts: DataFrame, claims: DataFrame) -> DataFrame:
    """(part_key, slug): organisations with a scope that contains the part, each once."""
    p = parts.select("part_key", F.col("title").alias("p_title"), *[F.col(k).alias(f"p_{k}") for k in LEVELS])
    r = _wide(claims, "r", "slug")
    return p.join(r, (F.col("r_title") == F.col("p_title")) & scope_contains("r", "p")).select("part_key", F.col("r_slug").alias("slug")).distinct()


def related(chapters: DataFrame, claims: DataFrame) -> DataFrame:
    """(chapter_key, ref_key) where either contains the other: two equi-joined containments, no nested loop over both."""
    c = chapters.select("chapter_key", F.col("title").alias("c_title"), *[F.col(k).alias(f"c_{k}") for k in LEVELS])
    r = _wide(claims.dropDuplicates(["ref_key"]), "r", "ref_key")
    one = c.join(r, scope_contains("r", "c")).select("chapter_key", F.col("r_ref_key").alias("ref_key"))
    two = c.join(r, scope_contains("c", "r")).select("chapter_key", F.col("r_ref_key").alias("ref_key"))
    return one.union(two).distinct()


def diagnostics(claims: DataFrame, found: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: distinct scopes, dangling and ambiguous ones, and pairs of regions one inside the other."""
    d = found.agg(F.count("*").alias("distinct_scopes"), F.count_if(F.col("outcome") == "dangling").alias("dangling"), F.count_if(F.col("outcome") == "ambiguous").alias("ambiguous"))
    r = regions.select("citation").distinct()
    nested = with_ancestors(r).filter("ancestor <> citation").join(r.withColumnRenamed("citation", "o"), F.col("ancestor") == F.col("o")).agg(F.count("*").alias("nested_pairs"))
    return d.crossJoin(nested)


def scope_shares(shared: DataFrame) -> DataFrame:
    """(ref_key, slug, share, reason) of shared scopes (ref_key, words, agency_count, agency_slugs as JSON).

    No share is made up: where the words are unknown, or the list isn't as long
    as the count, there is a reason instead.
    """
    from ..functions.scalar import parse_slugs

    s = shared.withColumn("_slugs", parse_slugs(F.col("agency_slugs")))
    reason = F.when(F.col("words").isNull(), "scope not measured").when(F.size("_slugs") != F.col("agency_count"), "claimants don't match their count")
    s = s.withColumn("reason", reason).select("ref_key", "words", "agency_count", "reason", F.posexplode("_slugs").alias("_i", "slug"))
    return s.select("ref_key", "slug", F.when(F.col("reason").isNull(), M.even_share(F.col("words"), F.col("agency_count"), F.col("_i") + 1)).cast("bigint").alias("share"), "reason")
