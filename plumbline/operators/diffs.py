"""Diffs of sections: status, edits, hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linediff import MAX_LINES, line_diff


def compare(pairs: DataFrame) -> DataFrame:
    """``status`` and ``edits`` of (old_lines, new_lines, old_failed, new_failed); a null side is absent.

    In this order: failed or both absent is unavailable; absent before, added;
    absent after, removed; too many lines, too_large; else unchanged or modified.
    """
    old, new = F.col("old_lines"), F.col("new_lines")
    status = (
        F.when(F.col("old_failed") | F.col("new_failed") | (old.isNull() & new.isNull()), "unavailable")
        .when(old.isNull(), "added").when(new.isNull(), "removed")
        .when((F.size(old) > MAX_LINES) | (F.size(new) > MAX_LINES), "too_large")
        .when(old == new, "unchanged").otherwise("modified")
    )
    d = pairs.withColumn("status", status)
    return d.withColumn("edits", line_diff(F.when(F.col("status") == "modified", old), F.when(F.col("status") == "modified", new)))


def hunks(diffs: DataFrame, key: str, context: int = 3) -> DataFrame:
    """(key, hunk, old_start, old_count, new_start, new_count, added, removed, edits): changes with ``context`` lines around.

    Two changes at places i < j of the edit list are one hunk iff j - i <= 2 * context + 1.
    """
    e = diffs.filter("edits is not null").select(key, F.posexplode("edits").alias("i", "e"))
    w = Window.partitionBy(key).orderBy("i")
    changes = e.filter("e.op <> 'equal'").withColumn("_p", F.lag("i").over(w))
    changes = changes.withColumn("hunk", F.sum(F.when(F.col("_p").isNull() | (F.col("i") - F.col("_p") > 2 * context + 1), 1).otherwise(0)).over(w) - 1)
    spans = changes.groupBy(key, "hunk").agg((F.min("i") - context).alias("lo"), (F.max("i") + context).alias("hi"))
    placed = e.withColumn("ops", F.count_if(F.col("e.op") != "insert").over(w) - F.when(F.col("e.op") != "insert", 1).otherwise(0)).withColumn("nps", F.count_if(F.col("e.op") != "delete").over(w) - F.when(F.col("e.op") != "delete", 1).otherwise(0))
    inside = placed.join(spans, key).filter("i between lo and hi")
    return inside.groupBy(key, "hunk").agg(
        (F.min("ops") + 1).cast("int").alias("old_start"), F.count_if(F.col("e.op") != "insert").cast("int").alias("old_count"), (F.min("nps") + 1).cast("int").alias("new_start"), F.count_if(F.col("e.op") != "delete").cast("int").alias("new_count"),
        F.count_if(F.col("e.op") == "insert").cast("int").alias("added"), F.count_if(F.col("e.op") == "delete").cast("int").alias("removed"), F.sort_array(F.collect_list(F.struct("i", "e"))).alias("edits"),
    )
