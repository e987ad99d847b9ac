"""Readers with fixed schemas: nothing is inferred, unknown keys are dropped, missing required ones are refused."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REFERENCE = "struct<title:int,subtitle:string,chapter:string,subchapter:string,part:string>"
AGENCY = f"slug string, name string, short_name string, display_name string, sortable_name string, cfr_references array<{REFERENCE}>"
AGENCIES = f"agencies array<struct<slug:string,name:string,short_name:string,display_name:string,sortable_name:string,cfr_references:array<{REFERENCE}>,children:array<struct<slug:string,name:string,short_name:string,display_name:string,sortable_name:string,cfr_references:array<{REFERENCE}>>>>>"
TITLES = "titles array<struct<number:int,name:string,latest_amended_on:string,latest_issue_date:string,up_to_date_as_of:string,reserved:boolean>>, meta struct<date:string,import_in_progress:boolean>"
VERSIONS = "content_versions array<struct<date:string,amendment_date:string,issue_date:string,identifier:string,name:string,part:string,subpart:string,title:string,type:string,removed:boolean,substantive:boolean>>, meta struct<title:string,result_count:string,total_pages:string>"
MAX_XML_BYTES = 192 << 20


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Raises at run time where a required column is null."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing {c}"))).otherwise(F.col(c)))
    return df


def agencies(spark: SparkSession, path: str) -> DataFrame:
    """(slug, name, short_name, display_name, sortable_name, parent_slug, depth, cfr_references) of agencies and their children; of equal slugs the first."""
    top = spark.read.schema(AGENCIES).json(path, multiLine=True, mode="FAILFAST").select(F.posexplode("agencies").alias("i", "a"))
    cols = lambda p: [F.col(f"{p}.slug").alias("slug"), F.col(f"{p}.name").alias("name"), F.col(f"{p}.short_name").alias("short_name"), F.coalesce(f"{p}.display_name", f"{p}.name").alias("display_name"), F.coalesce(f"{p}.sortable_name", f"{p}.name").alias("sortable_name")]
    parents = top.select("i", F.lit(-1).alias("j"), *cols("a"), F.lit(None).cast("string").alias("parent_slug"), F.lit(0).alias("depth"), F.col("a.cfr_references").alias("cfr_references"))
    kids = top.select("i", F.col("a.slug").alias("parent_slug"), F.posexplode("a.children").alias("j", "c"))
    kids = kids.select("i", "j", *cols("c"), "parent_slug", F.lit(1).alias("depth"), F.col("c.cfr_references").alias("cfr_references"))
    return required(first_of(parents.unionByName(kids), "slug", "i", "j").drop("i", "j"), "slug", "display_name")


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with equal keys the first."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def claims(agencies_df: DataFrame) -> DataFrame:
    """(slug, ref_key, title, levels) of agencies' references, each once."""
    from ..functions import citation as C

    r = agencies_df.select("slug", F.explode("cfr_references").alias("r"))
    s = r.withColumn("s", C.to_scope(F.col("r.title"), **{k: F.col(f"r.{k}") for k in C.LEVELS}))
    return s.select("slug", C.ref_key(F.col("s")).alias("ref_key"), "s.*").dropDuplicates(["slug", "ref_key"])


def titles(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.schema(TITLES).json(path, multiLine=True, mode="FAILFAST")
    return t.select(F.explode("titles").alias("t"), F.col("meta.date").alias("as_of"), F.coalesce("meta.import_in_progress", F.lit(False)).alias("import_in_progress")).select("t.*", "as_of", "import_in_progress")


def structures(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): trees of unbounded depth as text, for ``flatten_structure``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def xml_files(spark: SparkSession, path: str, limit: int = MAX_XML_BYTES) -> DataFrame:
    """(path, content, too_large): the content of files beyond the limit is never read."""
    f = spark.read.format("binaryFile").load(path)
    small = f.filter(F.col("length") <= limit).select("path", F.decode("content", "UTF-8").alias("content"), F.lit(False).alias("too_large"))
    return small.unionByName(f.filter(F.col("length") > limit).select("path", F.lit(None).cast("string").alias("content"), F.lit(True).alias("too_large")))


def xml_stream(spark: SparkSession, path: str, files_per_trigger: int = 16, limit: int = MAX_XML_BYTES) -> DataFrame:
    """The same of files as they land, as a stream; a file is read once, whole."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    f = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    large = F.col("length") > limit
    return f.select("path", F.when(~large, F.decode("content", "UTF-8")).alias("content"), large.alias("too_large"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all pages, with each page's claims about itself."""
    v = spark.read.schema(VERSIONS).json(path, multiLine=True, mode="FAILFAST")
    n = F.size("content_versions")
    cut = (n == 1000) & F.col("meta.total_pages").try_cast("bigint").isNull()
    return v.withColumn("page", F.col("_metadata.file_path")).select("page", cut.alias("truncated"), F.explode("content_versions").alias("v")).select("page", "truncated", "v.*")


def merge_pages(v: DataFrame, max_pages: int = 200) -> DataFrame:
    """All pages' versions once; a repeated page (all of its rows seen before) or too many pages raise."""
    key = ["identifier", "amendment_date", "issue_date"]
    shape = v.groupBy("page").agg(F.hash(F.array_sort(F.collect_list(F.to_json(F.struct(*key))))).alias("h"))
    seen = shape.agg(F.count("*").alias("n"), F.count_distinct("h").alias("d"))
    bad = F.when(F.col("n") > max_pages, F.raise_error(F.lit("too many pages"))).when(F.col("n") > F.col("d"), F.raise_error(F.lit("a page is repeated"))).otherwise(F.lit(True))
    return v.dropDuplicates(key).crossJoin(F.broadcast(seen.select(bad.alias("_ok")))).filter("_ok").drop("_ok", "page")


def snapshot(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A page of a snapshot directory, checked against its schema."""
    return spark.read.schema(schema).json(os.path.join(folder, name), mode="FAILFAST", multiLine=True)


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """In-memory rows, marked as fixtures."""
    return spark.createDataFrame(rows, schema).withColumn("fixture", F.lit(True))


def objects(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(key, length, modified) of the files below a folder whose key begins with the prefix."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    key = F.regexp_replace("path", r"^.*?" + os.path.basename(folder.rstrip("/")) + "/", "")
    return f.withColumn("key", key).filter(F.col("key").startswith(prefix)).select("key", "length", "modified")


def sections(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """Dated section XML with its outcome: ok, absent (404), or failed (anything else, or not landed)."""
    out = F.when(F.col("http_status") == 200, "ok").when(F.col("http_status") == 404, "absent").otherwise("failed")
    return wanted.join(landed, ["title", "section", "date"], "left").withColumn("outcome", out).withColumn("content", F.when(F.col("outcome") == "ok", F.col("content")))


def choose(fixture: bool = False, snapshot_dir: str | None = None, database: str | None = None) -> tuple[str, str | None]:
    """Which source serves: an explicit fixture, a snapshot directory, tables, else the fixture; paths must be absolute."""
    for p in (snapshot_dir, database):
        if p and not os.path.isabs(p):
            raise ValueError(f"{p} isn't absolute")
    if fixture:
        return "fixture", None
    return ("snapshot", snapshot_dir) if snapshot_dir else ("tables", database) if database else ("fixture", None)
