"""Full and incremental loads, end to end: read, measure, roll up, divide, check, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citation as C
from ..functions import measure as M
from ..functions import text as T
from ..functions.xmltext import FAILED, xml_nodes
from ..operators import jurisdiction, tree
from ..sources.shared import settle
from ..sources.tables import Warehouse
from . import delta

TABLES = ("structure_node", "agency_rollup", "scope_overlap", "agency", "agency_cfr_reference", "title")


def _level(citation, name: str):
    return F.nullif(F.regexp_extract(citation, rf"(?:^|/){name}-([^/]+)", 1), F.lit(""))


def scoped(nodes: DataFrame) -> DataFrame:
    """Nodes with their ancestry as columns, as ``resolve`` wants them."""
    c = F.col("citation")
    out = nodes.withColumn("title", _level(c, "title").cast("int"))
    for k in C.LEVELS:
        out = out.withColumn(k, _level(c, k))
    return out.withColumn("identifier", F.coalesce("identifier", _level(c, "title")))


def measure(structure: DataFrame, xml: DataFrame) -> DataFrame:
    """Nodes of the structure with ``direct`` (leaves) and ``own`` (containers) measurements from parsed XML.

    A node is found by (title, part, type, identifier), exact case before folded.
    The title of an XML node is that of its path in the document, else that of
    the document's file (``title-1/...``, ``title=1/...``, ``title-1.xml``), else
    that of the one title that has its part; without any it measures nothing.
    What the XML doesn't have stays unmeasured: it isn't zero. Leaves of a title
    of which a document couldn't be read have that as their ``fault``.
    """
    title = lambda c: F.nullif(F.regexp_extract(c, r"(?:^|/)title[-_=]([^/.]+)", 1), F.lit(""))
    part = lambda c: F.regexp_extract(c, r"(?:^|/)(part-[^/]+)", 1)
    path = title(F.col("path")) if "path" in xml.columns else F.lit(None).cast("string")
    failed = xml.filter(F.col("node_type") == FAILED).select(path.alias("f_title"), F.struct(F.col("head").alias("status"), F.col("text").alias("reason")).alias("fault"))
    failed = failed.filter("f_title is not null").groupBy("f_title").agg(F.min("fault").alias("fault"))
    xml = xml.filter(F.col("node_type") != FAILED)
    x = xml.select(F.coalesce(title(F.col("citation")), path).alias("x_title"), part(F.col("citation")).alias("x_part"), F.col("node_type").alias("x_type"), F.col("identifier").alias("x_id"), F.upper("identifier").alias("folded"), T.count_words(F.col("text")).alias("w"), T.count_words(F.col("own_text")).alias("ow"), F.col("doc_pos").alias("x_pos"))
    s = structure.withColumn("s_title", F.coalesce(title(F.col("citation")), F.lit(""))).withColumn("s_part", part(F.col("citation"))).withColumn("s_folded", F.upper("identifier"))
    only = s.groupBy(F.col("s_part").alias("u_part")).agg(F.min("s_title").alias("u_title"), F.max("s_title").alias("u_last")).filter("u_title = u_last").drop("u_last")
    x = x.join(only, F.col("x_title").isNull() & (F.col("x_part") == F.col("u_part")), "left").withColumn("x_title", F.coalesce("x_title", "u_title")).drop("u_part", "u_title")
    on = (s["s_title"] == x["x_title"]) & (s["s_part"] == x["x_part"]) & (s["node_type"] == x["x_type"]) & (s["s_folded"] == x["folded"])
    hit = s.join(x, on).groupBy("citation").agg(F.min_by(F.struct("w", "ow"), F.struct((F.col("x_id") != F.col("identifier")).alias("f"), F.col("x_pos").alias("p"))).alias("h"))
    j = structure.join(hit, "citation", "left").join(failed, title(F.col("citation")) == F.col("f_title"), "left").drop("f_title")
    known = lambda w: F.when(w.isNotNull(), F.struct(w.alias("words"), F.lit(True).alias("known")))
    leaf = C.is_leaf(F.col("node_type"))
    return j.withColumn("direct", F.when(leaf & ~F.col("reserved"), known(F.col("h.w")))).withColumn("own", F.when(~leaf, known(F.col("h.ow")))).withColumn("fault", F.when(leaf & ~F.col("reserved"), F.col("fault"))).drop("h")


@dataclass
class Inputs:
    """agencies (slug, sortable_name, …), claims, titles, structure (flattened), xml (path, content)."""

    agencies: DataFrame
    claims: DataFrame
    titles: DataFrame
    structure: DataFrame
    xml: DataFrame


def build(inputs: Inputs, previous: DataFrame | None = None, refetched: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a run. With ``previous`` nodes and ``refetched`` parts, what lies outside these is carried forward."""
    found = measure(inputs.structure, settle(xml_nodes(inputs.xml.select("path", "content"), failures=True)))
    if previous is not None and refetched is not None:
        inside = tree.with_ancestors(found.select("citation")).join(refetched.select(F.col("citation").alias("root")).distinct(), F.col("ancestor") == F.col("root"), "left_semi").select("citation", F.lit(True).alias("fresh")).distinct()
        old = previous.select("citation", F.struct("words", F.col("words").isNotNull().alias("known")).alias("was"))
        f = found.join(inside, "citation", "left").join(old, "citation", "left")
        above = tree.with_ancestors(refetched.select("citation")).select(F.col("ancestor").alias("citation"), F.lit(True).alias("above")).distinct()
        f = f.join(above, "citation", "left")
        keep = F.col("fresh").isNull() & F.col("above").isNull() & F.col("was").isNotNull()
        found = f.withColumn("direct", F.when(keep, F.col("was")).otherwise(F.col("direct"))).drop("fresh", "was", "above")
    found = settle(found)
    words = tree.roll_up(found)
    nodes = settle(inputs.structure.join(words, "citation"))
    d = jurisdiction.divide(inputs.agencies, inputs.claims, scoped(nodes))
    rollup = d.agencies.withColumnRenamed("slug", "agency_slug")
    return {"structure_node": nodes, "agency_rollup": rollup, "scope_overlap": d.overlaps, "agency": inputs.agencies.drop("cfr_references"), "agency_cfr_reference": inputs.claims, "title": inputs.titles, "corpus": d.corpus}


def _stats(t: dict[str, DataFrame]) -> DataFrame:
    return delta.gate_stats(t["structure_node"], t["agency"], t["title"], t["agency_rollup"].select(F.col("deduplicated").alias("words")))


def backfill(warehouse: Warehouse, inputs: Inputs, run: int) -> bool:
    """A full load. Nothing is published unless every check against the last published run holds."""
    warehouse.record(run, "backfill", "running")
    if inputs.titles.filter("import_in_progress").head(1):
        warehouse.record(run, "backfill", "postponed")
        return False
    return _finish(warehouse, build(inputs), run, "backfill")


def incremental(warehouse: Warehouse, inputs: Inputs, amended: DataFrame, run: int, truncated: bool = False) -> bool:
    """A load of the parts that were amended, changed in size or were unknown; the rest is carried forward."""
    stored = warehouse.read("structure_node")
    if stored is None:
        return backfill(warehouse, inputs, run)
    warehouse.record(run, "delta", "running")
    part = F.col("node_type") == "part"
    parts = inputs.structure.filter(part)
    sizes = delta.size_diff(stored.filter(part), parts)
    unknown = stored.filter(part & F.col("words").isNull())
    plan = delta.refetch_plan(parts, amended, sizes, unknown, truncated)
    return _finish(warehouse, build(inputs, stored.select("citation", "words"), plan), run, "delta")


def _finish(warehouse: Warehouse, tables: dict[str, DataFrame], run: int, kind: str) -> bool:
    names = list(tables)
    for name in names:
        warehouse.stage(name, tables[name], run)
    now = {n: warehouse.staged(n, run) for n in names}
    before = {n: warehouse.read(n) for n in names}
    old = _stats(before) if all(v is not None for v in before.values()) else _stats(now).limit(0)
    checks = delta.gate(_stats(now), old)
    bad = M.violations(now["structure_node"].withColumn("method", F.lit(None).cast("string"))).limit(1).count()
    ok = not bad and checks.filter(~F.col("ok")).limit(1).count() == 0
    if ok:
        warehouse.publish(run, names)
    else:
        warehouse.discard(run)
    warehouse.record(run, kind, "published" if ok else "refused", tables=len(names))
    return ok


def read_inputs(spark: SparkSession, folder: str, titles_root: str = "") -> Inputs:
    """Inputs landed in a folder: agencies.json, titles.json, structure/*.json, xml/*.xml."""
    from ..sources import readers

    a = settle(readers.agencies(spark, f"{folder}/agencies.json"))
    s = settle(tree.flatten_structure(readers.structures(spark, f"{folder}/structure"), titles_root))
    return Inputs(a, readers.claims(a), readers.titles(spark, f"{folder}/titles.json"), s, readers.xml_files(spark, f"{folder}/xml"))
