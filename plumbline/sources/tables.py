"""Table maintenance on immutable Parquet: upserts, prunes, versions and a published pointer."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = {
    "sync_run": ["id"], "title_watermark": ["title_number"], "title": ["number"], "agency": ["slug"], "structure_node": ["citation"], "agency_cfr_reference": ["agency_slug", "ref_key"],
    "scope_overlap": ["ref_key"], "agency_rollup": ["agency_slug"], "agency_snapshot": ["agency_slug", "snapshot_date"], "amendment": ["title", "section", "amendment_date", "issue_date"],
}
#: Accounts and keys are never exported.
PUBLIC = ("agency", "agency_cfr_reference", "agency_rollup", "agency_snapshot", "amendment", "app_meta", "scope_overlap", "structure_node", "sync_run", "title", "title_watermark")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), nothing: bool = False) -> DataFrame:
    """New rows replace old ones of equal key; columns in ``keep`` stay as they were; ``nothing``: old rows win."""
    if nothing:
        return existing.unionByName(new.join(existing, keys, "left_anti"))
    if keep:
        new = new.drop(*keep).join(existing.select(*keys, *keep), keys, "left").select(*existing.columns)
    return existing.join(new, keys, "left_anti").unionByName(new)


def merge(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join by key, a new value winning where it isn't null."""
    o, n = existing.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    return o.join(n, on, "full_outer").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in existing.columns])


def _stale(run: int, scope: Column | None) -> Column:
    old = F.coalesce(F.col("last_seen_run_id") < run, F.lit(False))
    return old & F.coalesce(scope, F.lit(False)) if scope is not None else old


def prune(df: DataFrame, run: int, scope: Column | None = None) -> DataFrame:
    """Without the rows of the scope that the run didn't see."""
    return df.filter(~_stale(run, scope))


def prune_count(df: DataFrame, run: int, scope: Column | None = None) -> DataFrame:
    return df.agg(F.count_if(_stale(run, scope)).alias("stale"))


def prune_committed(df: DataFrame, run: int, unit: str, committed: DataFrame) -> DataFrame:
    """Prunes only within units whose writes were all committed."""
    c = committed.select(F.col(unit)).distinct().withColumn("_done", F.lit(True))
    return df.join(c, unit, "left").filter(~(F.coalesce("_done", F.lit(False)) & _stale(run, None))).select(*df.columns)


def conditional_update(df: DataFrame, condition: Column, **values: Column) -> tuple[DataFrame, DataFrame]:
    """(table, affected): a keyed UPDATE as a rewrite, and the number of rows that it changes."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns]), df.agg(F.count_if(hit).alias("affected"))


class Warehouse:
    """Versioned tables below one folder, a ledger of runs, and the pointer to what is published.

    A run writes each table to a version of its own. Publishing renames a small
    pointer file; readers follow it, so a refused or broken run changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def stage(self, name: str, df: DataFrame, run: int, partition_by: list[str] | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/versions/{run}/{name}")

    def staged(self, name: str, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/versions/{run}/{name}")

    def publish(self, run: int, tables: list[str]) -> None:
        """Swaps the pointer by one rename; every table must be there."""
        for t in tables:
            if not self._fs.exists(self._path(f"{self.root}/versions/{run}/{t}/_SUCCESS")):
                raise ValueError(f"{t} isn't committed")
        tmp, to = self._path(f"{self.root}/pointer-{run}"), self._path(f"{self.root}/pointer")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps({"run": run, "tables": tables}).encode()))
        out.close()
        if self._fs.exists(to):
            self._fs.rename(to, self._path(f"{self.root}/pointer-old"))
        self._fs.rename(tmp, to)
        self._fs.delete(self._path(f"{self.root}/pointer-old"), False)

    def pointer(self) -> dict | None:
        for name in ("pointer", "pointer-old"):
            if self._fs.exists(self._path(f"{self.root}/{name}")):
                return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0])
        return None

    def read(self, name: str) -> DataFrame | None:
        p = self.pointer()
        return self.staged(name, p["run"]) if p and name in p["tables"] else None

    def discard(self, run: int) -> None:
        self._fs.delete(self._path(f"{self.root}/versions/{run}"), True)

    def record(self, run: int, kind: str, status: str, **counters: int) -> None:
        """Appends a row to the ledger of runs; a run that dies leaves the one that opened it."""
        row = [(run, kind, status, {k: int(v) for k, v in counters.items()})]
        self.spark.createDataFrame(row, "id bigint, kind string, status string, counters map<string,bigint>").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/ledger")

    def ledger(self) -> DataFrame:
        """Of each run its last row: ``running`` where it never ended."""
        rows = self.spark.read.parquet(f"{self.root}/ledger")
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at"), (F.col("status") == "running").cast("int")))
        return rows.withColumn("_r", last).filter("_r = 1").drop("_r")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n): UNION ALL of counts."""
    parts = [df.agg(F.lit(k).alias("table_name"), F.count("*").alias("n")) for k, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def export(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Writes the public tables, and no others, as JSON lines."""
    done = [k for k in tables if k in PUBLIC]
    for k in done:
        tables[k].write.mode("overwrite").json(f"{folder}/{k}")
    return done


def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of exported files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_pages(df: DataFrame, folder: str, by: str) -> None:
    """A tree of JSON pages, one directory a key."""
    df.write.mode("overwrite").partitionBy(by).json(folder)
