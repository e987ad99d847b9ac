"""Time series, histories, ranks and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_series(counts: DataFrame, key: str, bucket: str, value: str, first: Column, last: Column, step: str = "1 month") -> DataFrame:
    """Every bucket of every key between two dates, zero where nothing was counted, and the key's total."""
    keys = counts.select(key).distinct()
    grid = keys.withColumn(bucket, F.explode(F.sequence(first, last, F.expr(f"interval {step}"))))
    out = grid.join(counts, [key, bucket], "left").withColumn(value, F.coalesce(value, F.lit(0)).cast("bigint"))
    return out.withColumn("total", F.sum(value).over(Window.partitionBy(key)))


def adjacent_dates(events: DataFrame, key: str, day: str, bound: Column) -> DataFrame:
    """The latest distinct date not after the bound, and the one before it."""
    d = events.filter(F.col(day) <= bound).select(key, day).distinct()
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    d = d.withColumn("_r", F.row_number().over(w)).withColumn("previous", F.lead(day).over(w))
    return d.filter("_r = 1").select(key, F.col(day).alias("current"), "previous")


def last_n(df: DataFrame, key: str, order: str, n: int = 90) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """A page in a total order, with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def limited(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """At most ``limit`` rows and whether there were more: one row more is read, no count made."""
    some = df.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)
    some = some.withColumn("_r", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return some.filter(F.col("_r") <= limit).drop("_r")


def first_reason(signals: DataFrame, key: str, priority: str, *order: Column) -> DataFrame:
    """One row a key: that of the first signal."""
    w = Window.partitionBy(key).orderBy(F.col(priority), *order)
    return signals.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def quota(requests: DataFrame, key: str, ts: str, limit: int, width: str = "1 day") -> DataFrame:
    """Requests of each key in each fixed window, and whether they exceed the limit."""
    g = requests.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("used"))
    return g.select(key, F.col("w.start").alias("window_start"), "used", (F.col("used") > limit).alias("over_limit"))


def top_with_share(df: DataFrame, value: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` known values, each in per cent of the greatest, at least 0.5."""
    top = df.filter(F.col(value).isNotNull()).orderBy(F.col(value).desc(), *order).limit(n)
    most = F.max(value).over(Window.partitionBy())
    return top.withColumn("pct", F.greatest(F.lit(0.5), F.round(F.col(value) * 100.0 / most, 4)))



def agency_sort(name: str) -> list[Column]:
    """Orders of the agency list; nulls last, ties by slug."""
    return {
        "name": [F.asc("sortable_name"), F.asc("slug")], "words": [F.desc_nulls_last("words"), F.asc("slug")], "words_asc": [F.asc_nulls_last("words"), F.asc("slug")],
        "refs": [F.desc_nulls_last("refs_total"), F.asc("slug")], "coverage": [F.asc_nulls_first("coverage"), F.asc("slug")],
    }[name]


def overlap_sort(name: str) -> list[Column]:
    return {"agencies": [F.desc("agency_count"), F.asc("ref_key")], "words": [F.desc(F.coalesce("words", F.lit(-1))), F.asc("ref_key")], "key": [F.asc("ref_key")]}[name]
