"""URL filters: a trie over reversed host labels and path segments.

An entry is a host, perhaps with a path: ``example.com`` stands for that host
and all below it, ``example.com/a/b`` for what lies under that path there. In
the trie a host's labels come last first, then the path's segments. Of all
entries on a URL's way the one with the most labels and segments decides; of
equally long ones that with more labels; an entry both allowed and blocked is
allowed. A URL that meets no entry is allowed.

The trie is broadcast where there are at most ``broadcast_entries``; beyond, the
entries stay a table, and each URL's possible entries are joined with it.

Defined cases: a null, empty or malformed URL is ``invalid`` (it has no host);
scheme, user, port, query, fragment, a final dot, empty segments and the case of
the host don't count; equal rows get equal decisions; an empty table gives no
rows; no entries allow all; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean

BLOCK = (
    "spam-farm.example.org", "cheap-pills.example.com", "casino.example.net", "example.net/es", "blog.example.org/de",
    "ththre.example.com/fr", "m.example.com", "therti.example.org/en/618",
)
ALLOW = ("www.cheap-pills.example.com/fr", "spam-farm.example.org/en/about", "blog.ththan.example.net/es", "m.therou.example.com")
ENTRIES = [(x, "block") for x in BLOCK] + [(x, "allow") for x in ALLOW]
BROADCAST_ENTRIES = 500_000
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)(?::[0-9]*)?(/[^?#]*)?(?:[?#]|$)", re.S)
SCHEMA = "page_id long, url string, host string, decision string, entry string"


def split(url: str | None) -> tuple[list[str], list[str]] | None:
    """(labels, segments) of a URL, or None."""
    m = _URL.match(url) if url else None
    if not m:
        return None
    labels = [x for x in m[1].lower().rstrip(".").split(".")]
    if not all(labels):
        return None
    return labels, [x for x in (m[2] or "").split("/") if x]


def entry_parts(entry: str) -> tuple[list[str], list[str]]:
    host, _, path = entry.partition("/")
    return [x for x in host.lower().rstrip(".").split(".") if x], [x for x in path.split("/") if x]


def build(entries: list[tuple[str, str]]) -> dict:
    """Nested dicts: labels, then under "/" segments; "" holds (entry, action)."""
    root: dict = {}
    for entry, action in entries:
        labels, segments = entry_parts(entry)
        node = root
        for x in reversed(labels):
            node = node.setdefault(x, {})
        if segments:
            node = node.setdefault("/", {})
            for x in segments:
                node = node.setdefault("/" + x, {})
        name = ".".join(labels) + "".join("/" + x for x in segments)
        if action == "allow" or "" not in node:
            node[""] = (name, action)
    return root


def decide(trie: dict, labels: list[str], segments: list[str]) -> tuple[str, str | None]:
    best, found = (0, 0), None
    node = trie
    for depth, x in enumerate(reversed(labels), 1):
        node = node.get(x)
        if node is None:
            break
        hit = node.get("")
        if hit and (depth, depth) >= best:
            best, found = (depth, depth), hit
        under = node.get("/")
        if under:
            for k, s in enumerate(segments, 1):
                under = under.get("/" + s)
                if under is None:
                    break
                hit = under.get("")
                if hit and (depth + k, depth) > best:
                    best, found = (depth + k, depth), hit
    return (found[1], found[0]) if found else ("allow", None)


def filter_urls(pages: DataFrame, entries: list[tuple[str, str]] | DataFrame = ENTRIES, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(page_id, url, host, decision, entry) of each row; entries: (entry, allow or block) pairs, or such a DataFrame."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    if isinstance(entries, DataFrame):
        e = entries.toDF("entry", "action").filter("entry is not null and action in ('allow', 'block')")
        if e.limit(broadcast_entries + 1).count() > broadcast_entries:
            return _joined(rows, e)
        entries = [(r[0], r[1]) for r in e.collect()]
    elif len(entries) > broadcast_entries:
        return _joined(rows, spark.createDataFrame(entries, "entry string, action string"))
    shared = spark.sparkContext.broadcast(build(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            host, decision, entry = [], [], []
            for url in batch.column("url").to_pylist():
                parts = split(url)
                d, e = decide(trie, *parts) if parts else ("invalid", None)
                host.append(".".join(parts[0]) if parts else None)
                decision.append(d)
                entry.append(e)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(host, pa.string()), pa.array(decision, pa.string()), pa.array(entry, pa.string())], names=["page_id", "url", "host", "decision", "entry"])

    return rows.mapInArrow(lean(run), SCHEMA)


def _joined(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Beyond a broadcast: every entry that could be on a URL's way is looked up by a join."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [".".join(h) + "".join("/" + x for x in s) for h, s in map(entry_parts, b.column("entry").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column("action")], names=["entry", "action"])

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                out: tuple[list, ...] = ([], [], [], [], [])
                for url in b.slice(a, 1000).column("url").to_pylist():
                    parts = split(url)
                    if not parts:
                        continue
                    labels, segments = parts
                    for d in range(1, len(labels) + 1):
                        name = ".".join(labels[-d:])
                        for k in range(len(segments) + 1):
                            for o, x in zip(out, (url, ".".join(labels), name + "".join("/" + x for x in segments[:k]), d + k, d)):
                                o.append(x)
                types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=["url", "host", "entry", "long", "labels"])

    table = entries.mapInArrow(lean(normal), "entry string, action string").groupBy("entry").agg(F.min("action").alias("action"))
    way = rows.select("url").filter("url is not null").distinct().mapInArrow(lean(ways), "url string, host string, entry string, long int, labels int")
    met = way.join(table, "entry", "left")
    rank = F.when(F.col("action").isNotNull(), F.struct("long", "labels", "action", "entry"))
    best = met.groupBy("url", "host").agg(F.max(rank).alias("b"))
    best = best.select("url", "host", F.coalesce("b.action", F.lit("allow")).alias("decision"), F.col("b.entry").alias("entry"))
    return rows.join(best, "url", "left").select("page_id", "url", "host", F.coalesce("decision", F.lit("invalid")).alias("decision"), "entry")


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_VALUES = ", ".join(f"('{e}', '{a}')" for e, a in ENTRIES)
SQL = f"""
with rules(entry, action) as (values {_VALUES}),
r as (select lower(split_part(entry, '/', 1)) || substr(entry, length(split_part(entry, '/', 1)) + 1) as entry, min(action) as action,
        max(len(string_split(split_part(entry, '/', 1), '.'))) as labels, max(len(string_split(entry, '/')) - 1) as segs from rules group by 1),
p as (select row_number() over () as rid, page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)(?::[0-9]*)?(/[^?#]*)?(?:[?#]|$)', 1)), '.') as host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)(?::[0-9]*)?(/[^?#]*)?(?:[?#]|$)', 2) as path from pages),
q as (select *, list_aggregate(list_filter(string_split(path, '/'), lambda x: x <> ''), 'string_agg', '/') as clean from p),
m as (select q.rid, r.*, row_number() over (partition by q.rid order by labels + segs desc, labels desc) as k from q join r
        on (q.host = split_part(r.entry, '/', 1) or ends_with(q.host, '.' || split_part(r.entry, '/', 1)))
       and (r.segs = 0 or starts_with(coalesce(q.clean, '') || '/', substr(r.entry, length(split_part(r.entry, '/', 1)) + 2) || '/')))
select q.page_id, q.url, nullif(q.host, '') as host,
  case when coalesce(q.host, '') = '' then 'invalid' else coalesce(m.action, 'allow') end as decision, m.entry
from q left join m on m.rid = q.rid and m.k = 1
"""
