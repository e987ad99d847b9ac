"""Order-keeping page packing of siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_groups(items: Column, target: int) -> Column:
    """Arrays of (ids, bytes): neighbours are put together until the next would exceed ``target`` bytes (items: struct id, bytes)."""
    group = "struct<ids:array<string>,bytes:bigint>"
    start = F.struct(F.array().cast(f"array<{group}>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("bigint").alias("size"))
    closed = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["open"].alias("ids"), acc["size"].alias("bytes"))))

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (acc["size"] + x["bytes"] > target)
        return F.struct(
            F.when(full, closed(acc)).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(x["id"])).otherwise(F.concat(acc["open"], F.array(x["id"]))).alias("open"),
            F.when(full, x["bytes"]).otherwise(acc["size"] + x["bytes"]).cast("bigint").alias("size"),
        )

    return F.aggregate(items, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, closed(acc)).otherwise(acc["done"]))


def pack_siblings(nodes: DataFrame, parent: str, identifier: str, size: str, order: str, target: int = 4 << 20, oversized: int = 24 << 20) -> DataFrame:
    """(parent, unit, ids, first, last, bytes, oversized): render units of each parent's children, in document order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(identifier).cast("string").alias("id"), F.col(size).cast("bigint").alias("bytes"))))
    g = nodes.groupBy(parent).agg(ordered.alias("items"))
    g = g.select(parent, F.posexplode(pack_groups(F.col("items"), target)).alias("unit", "g")).select(parent, "unit", "g.ids", "g.bytes")
    return g.select(parent, "unit", "ids", F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"), "bytes", (F.col("bytes") > oversized).alias("oversized"))
