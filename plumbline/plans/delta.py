"""Incremental loads: what changed, what must be fetched again, and whether the result may be published."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measure as M
from ..operators.series import first_reason


def size_diff(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(citation, change) of parts by declared size: added, removed, unknown (a size is null), changed, unchanged."""
    o, n = stored.select("citation", F.col("xml_bytes").alias("old_bytes"), F.lit(1).alias("_o")), fresh.select("citation", F.col("xml_bytes").alias("new_bytes"), F.lit(1).alias("_n"))
    change = (
        F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
        .when(F.col("old_bytes").isNull() | F.col("new_bytes").isNull(), "unknown").when(F.col("old_bytes") != F.col("new_bytes"), "changed").otherwise("unchanged")
    )
    return o.join(n, "citation", "full_outer").select("citation", "old_bytes", "new_bytes", change.alias("change"))


def removed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return stored.select("citation").subtract(fresh.select("citation"))


def title_plan(titles: DataFrame, marks: DataFrame) -> DataFrame:
    """(number, action, reason): reserved titles are skipped; the others are dirty where they were amended since the mark."""
    t = titles.join(marks.select(F.col("title_number").alias("number"), F.col("latest_amended_on").alias("seen")), "number", "left")
    action = F.when(F.col("reserved"), "reserved").when(F.col("seen").isNull() | F.col("latest_amended_on").isNull() | (F.col("seen") != F.col("latest_amended_on")), "dirty").otherwise("unchanged")
    reason = F.when(F.col("reserved"), "reserved").when(F.col("seen").isNull(), "never loaded").when(F.col("latest_amended_on").isNull(), "no date").when(F.col("seen") != F.col("latest_amended_on"), "amended").otherwise("same date")
    return t.select("number", action.alias("action"), reason.alias("reason"))


def high_water(versions: DataFrame) -> DataFrame:
    """The mark of each title: its latest issue date (not amendment date)."""
    return versions.groupBy("title").agg(F.max("issue_date").alias("latest_issue_date"))


def summarise(versions: DataFrame) -> DataFrame:
    """Of each title: substantive, other and removed versions, parts touched, and whether a page was cut off."""
    return versions.groupBy("title").agg(
        F.count_if(F.col("substantive") & ~F.col("removed")).alias("substantive"), F.count_if(~F.col("substantive") & ~F.col("removed")).alias("minor"), F.count_if("removed").alias("removed"),
        F.array_sort(F.collect_set("part")).alias("parts"), F.bool_or("truncated").alias("truncated"),
    )


def refetch_plan(parts: DataFrame, amended: DataFrame, sizes: DataFrame, unknown: DataFrame, truncated: bool = False) -> DataFrame:
    """(citation, reason): parts to be fetched, the first reason winning; a window that may be cut off takes all."""
    if truncated:
        return parts.select("citation", F.lit("window may be incomplete").alias("reason"))
    s = amended.select("citation", F.lit(1).alias("p"), F.lit("amended").alias("reason"))
    s = s.unionByName(sizes.filter("change in ('added', 'changed', 'unknown')").select("citation", F.lit(2).alias("p"), F.concat(F.lit("size "), F.col("change")).alias("reason")))
    s = s.unionByName(unknown.select("citation", F.lit(3).alias("p"), F.lit("unknown before").alias("reason")))
    return first_reason(s.join(parts.select("citation"), "citation", "left_semi"), "citation", "p", F.col("reason")).select("citation", "reason")


def carry_forward(previous: DataFrame, fresh: DataFrame, refetched: DataFrame) -> DataFrame:
    """(citation, words, origin): new values within refetched subtrees, earlier ones elsewhere. Prefixes are exploded, so the join is an equi-join."""
    from ..operators.tree import with_ancestors

    r = refetched.select(F.col("citation").alias("root")).distinct()
    below = with_ancestors(previous.select("citation")).join(r, F.col("ancestor") == F.col("root"), "left_semi").select("citation").distinct()
    old = previous.join(below, "citation", "left_anti").join(fresh.select("citation"), "citation", "left_anti")
    return old.select("citation", "words", F.lit("carried").alias("origin")).unionByName(fresh.select("citation", "words", F.lit("measured").alias("origin")))


def gate_stats(nodes: DataFrame, agencies: DataFrame, titles: DataFrame, rollup: DataFrame) -> DataFrame:
    """One row: total words (all or nothing), organisations, titles, unmeasured nodes."""
    return (
        rollup.agg(M.all_or_nothing(F.col("words")).alias("total_words"))
        .crossJoin(agencies.agg(F.count("*").alias("agency_count"))).crossJoin(titles.agg(F.count("*").alias("title_count")))
        .crossJoin(nodes.agg(F.count_if(F.col("words").isNull()).alias("uncounted_nodes")))
    )


def gate(now: DataFrame, before: DataFrame, partial_titles: int = 0, drift: float = 0.05, growth: float = 0.10) -> DataFrame:
    """(check_name, ok) rows of a run against what is published (``before`` may be empty: then only absolute checks count)."""
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in before.columns])
    j = now.join(b, F.lit(True), "left")
    none = F.col("b_agency_count").isNull()
    share = F.try_divide(F.abs(F.col("total_words") - F.col("b_total_words")).cast("double"), F.col("b_total_words").cast("double"))
    checks = {
        "total_known": F.col("total_words").isNotNull(),
        "drift": none | F.col("b_total_words").isNull() | F.coalesce(share <= drift, F.lit(False)),
        "agencies_not_fewer": none | (F.col("agency_count") >= F.col("b_agency_count")),
        "titles_not_fewer": none | (F.col("title_count") >= F.col("b_title_count")),
        "unknown_growth": none | (F.col("uncounted_nodes") <= F.col("b_uncounted_nodes") * (1 + growth)),
        "no_partial_titles": F.lit(partial_titles == 0),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("ok")) for k, v in checks.items()])
    return j.select(F.inline(rows))


def publish_if(warehouse, run: int, tables: dict[str, DataFrame], checks: DataFrame) -> bool:
    """Stages the tables; publishes them only where every check holds, else discards them."""
    for name, df in tables.items():
        warehouse.stage(name, df, run)
    ok = checks.filter(~F.col("ok")).limit(1).count() == 0
    if ok:
        warehouse.publish(run, list(tables))
    else:
        warehouse.discard(run)
    warehouse.record(run, "load", "published" if ok else "refused", tables=len(tables))
    return ok


def snapshots(history: DataFrame, today: DataFrame) -> DataFrame:
    """One row an (organisation, date), and the change since the one before."""
    all_rows = history.join(today, ["agency_slug", "snapshot_date"], "left_anti").unionByName(today)
    w = Window.partitionBy("agency_slug").orderBy("snapshot_date")
    return all_rows.withColumn("delta", F.col("words") - F.lag("words").over(w))


def resumable(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(unit, complete): a unit is complete where its date and fingerprint match and nothing failed."""
    m = manifest.select("unit", F.col("date").alias("m_date"), F.col("fingerprint").alias("m_print"), "failures")
    ok = (F.col("m_date") == F.col("date")) & (F.col("m_print") == F.col("fingerprint")) & (F.col("failures") == 0)
    return wanted.join(m, "unit", "left").select("unit", F.coalesce(ok, F.lit(False)).alias("complete"))
