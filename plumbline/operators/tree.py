"""Trees of nodes keyed by path: flattening, closure, roll-up, nesting."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citation as C
from ..functions import measure as M
from ..sources.shared import settle

FLAT = "citation string, parent_citation string, node_type string, identifier string, label string, reserved boolean, xml_bytes bigint, ordinal int, depth int, doc_pos int"


def flatten_structure(trees: DataFrame, root: str = "") -> DataFrame:
    """Rows of recursive JSON trees (column ``json``) in pre-order: path, parent, sibling ordinal, depth, position."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows: list[tuple] = []
            for text in pdf["json"]:
                stack = [(json.loads(text), root, 0, 0)] if text else []
                pos = 0
                while stack:
                    node, parent, ordinal, depth = stack.pop()
                    ident = node.get("identifier") or None
                    here = "/".join(x for x in (parent, f"{node['type']}-{ident or '@' + str(ordinal)}") if x)
                    rows.append((here, parent or None, node["type"], ident, node.get("label"), bool(node.get("reserved")), node.get("size"), ordinal, depth, pos))
                    pos += 1
                    kids = node.get("children") or []
                    stack += [(c, here, k, depth + 1) for k, c in reversed(list(enumerate(kids)))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FLAT.split(", ")])

    return trees.select("json").mapInPandas(run, FLAT)


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(ancestor, descendant) pairs of a hierarchy of any depth, each vertex with itself; a cycle's vertices are met once.

    Paths double: each round joins what the last one found with all pairs so far, so a chain of n takes log n rounds.
    """
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("p"))
    vertices = e.select("c").union(e.select("p")).filter("c is not null").distinct()
    e = e.filter("p is not null")
    known = settle(e.filter("c <> p").select(F.col("p").alias("ancestor"), F.col("c").alias("descendant")).distinct())
    while True:
        onward = known.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("far"))
        more = known.join(onward, "descendant").select("ancestor", F.col("far").alias("descendant")).filter("ancestor <> descendant")
        step = settle(more.distinct().join(known, ["ancestor", "descendant"], "left_anti"))
        if not step.head(1):
            return vertices.select(F.col("c").alias("ancestor"), F.col("c").alias("descendant")).unionByName(known)
        known = settle(known.unionByName(step))


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """One row for each of a node's path prefixes (``ancestor``), itself included: containment as an equi-join."""
    return nodes.withColumn("ancestor", F.explode(C.ancestors(F.col("citation"))))


def roll_up(nodes: DataFrame) -> DataFrame:
    """(citation, words, status, reason) of every node, from nodes (citation, parent_citation, direct, own, reserved, xml_bytes).

    ``direct`` and ``own`` are structs (words, known) or null: what was measured
    at a node, and a container's text outside its children. Direct wins; then
    children and own text, all or nothing; then, without children, own text,
    reserved (0), declared empty (0), unknown. A direct node hides what is below
    it from the nodes at or above it. No level loop: contributors are exploded
    to their ancestors and summed once. ``fault``, where there is one, is the
    struct (status, reason) of why a leaf couldn't be measured.
    """
    fault = F.col("fault") if "fault" in nodes.columns else F.lit(None).cast("struct<status:string,reason:string>").alias("fault")
    n = settle(nodes.select("citation", "parent_citation", "direct", "own", "reserved", "xml_bytes", fault))  # read several times below, measured once
    parents = n.filter("parent_citation is not null").groupBy("parent_citation").agg(F.count("*").alias("kids")).withColumnRenamed("parent_citation", "pc")
    n = n.join(parents, n["citation"] == parents["pc"], "left").drop("pc").withColumn("kids", F.coalesce("kids", F.lit(0)))
    none = F.struct(F.lit(None).cast("bigint").alias("words"), F.lit(False).alias("known"))
    zero = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(True).alias("known"))
    leaf = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("reserved"), zero).when(F.col("xml_bytes") == 0, zero).otherwise(none)
    part = F.when(F.col("direct").isNotNull(), F.col("direct")).when(F.col("kids") == 0, leaf).otherwise(F.col("own"))
    contributor = n.withColumn("part", part).filter("part is not null")
    direct = n.filter("direct is not null").select(F.col("citation").alias("d"))
    pairs = with_ancestors(contributor.select("citation", "part"))
    # the nearest strict ancestor that is direct hides the contributor at and above itself
    hidden = pairs.filter("ancestor <> citation").join(direct, F.col("ancestor") == F.col("d")).groupBy("citation").agg(F.max(F.length("ancestor")).alias("hide"))
    pairs = pairs.join(hidden, "citation", "left").filter("hide is null or length(ancestor) > hide")
    # of a direct node itself nothing but its direct value counts
    total = pairs.groupBy("ancestor").agg(F.count("*").alias("parts"), F.count_if(~F.col("part.known")).alias("absent"), F.sum("part.words").alias("sum"))
    out = n.join(total, n["citation"] == total["ancestor"], "left")
    shown = F.when(F.col("direct").isNotNull(), F.when(F.col("direct.known"), F.col("direct.words"))).otherwise(F.when(F.col("absent") == 0, F.col("sum")))
    out = out.withColumn("words", shown)
    kids = out.filter("parent_citation is not null").groupBy("parent_citation").agg(F.count_if(F.col("words").isNull()).alias("_bad"), F.count("*").alias("_all")).withColumnRenamed("parent_citation", "_pc")
    out = out.join(kids, out["citation"] == kids["_pc"], "left")
    own_bad = F.when(F.col("own").isNotNull() & ~F.col("own.known"), 1).otherwise(0)
    own_all = F.when(F.col("own").isNotNull(), 1).otherwise(0)
    status = (
        F.when(F.col("direct").isNotNull(), F.when(F.col("direct.known"), "counted").otherwise("not_computed"))
        .when(F.col("kids") > 0, F.when(F.col("words").isNotNull(), "rolled_up").otherwise("not_computed"))
        .when(F.col("own").isNotNull(), F.when(F.col("own.known"), "counted").otherwise("not_computed"))
        .when(F.col("reserved"), "reserved_empty").when(F.col("xml_bytes") == 0, "structurally_empty").otherwise("not_computed")
    )
    lost = F.col("words").isNull() & (F.col("kids") == 0) & F.col("fault").isNotNull()
    status = F.when(lost, F.col("fault.status")).otherwise(status)
    reason = F.when(lost, F.col("fault.reason")).when(F.col("words").isNull(), F.when((F.col("kids") > 0) & F.col("direct").isNull(), F.format_string("%d of %d parts unknown", F.col("_bad") + own_bad, F.col("_all") + own_all)).otherwise(F.concat(F.lit("not measured: "), F.col("citation"))))
    return out.select("citation", "words", status.alias("status"), reason.alias("reason"))


def forest(nodes: DataFrame, levels: int) -> DataFrame:
    """Nested ``children`` arrays, built level by level from the deepest (the schema has a fixed depth)."""
    base = nodes.select("citation", "parent_citation", "depth", "doc_pos")
    below = None
    for d in range(levels, -1, -1):
        level = base.filter(F.col("depth") == d)
        if below is not None:
            kids = below.groupBy("parent_citation").agg(F.sort_array(F.collect_list(F.struct("doc_pos", *[c for c in below.columns if c not in ("doc_pos", "parent_citation")]))).alias("children"))
            level = level.join(kids.withColumnRenamed("parent_citation", "_p"), F.col("citation") == F.col("_p"), "left").drop("_p")
        below = level.drop("depth")
    return below


def nearest_container(regions: DataFrame) -> DataFrame:
    """(citation, container): the longest strict prefix that is a region itself, or null; prefixes meet regions by an equi-join."""
    r = regions.select("citation").distinct()
    pairs = with_ancestors(r).filter("ancestor <> citation").join(r.withColumnRenamed("citation", "outer_citation"), F.col("ancestor") == F.col("outer_citation"))
    near = pairs.groupBy("citation").agg(F.max_by("outer_citation", F.length("outer_citation")).alias("container"))
    return r.join(near, "citation", "left")


def population(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Sums over a population of parents, a missing or unknown child making its parent's sum unknown."""
    got = nodes.groupBy(F.col("parent_citation").alias("citation")).agg(M.all_or_nothing(F.col("words")).alias("words"), M.missing(F.col("words")).alias("missing"))
    return parents.join(got, "citation", "left")
