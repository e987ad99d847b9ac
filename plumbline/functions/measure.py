"""Measurements: an unknown is never a zero.

A measurement is (words, status, method, reason): words are null exactly where
the status is an unknown one, and then there is a reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN = ("counted", "rolled_up", "reserved_empty", "structurally_empty", "stale")
UNKNOWN = ("not_computed", "unavailable_fetch_failed", "unavailable_parse_failed", "unavailable_too_large")
METHODS = {"counted": "xml_parse", "rolled_up": "descendant_sum", "reserved_empty": "reserved", "structurally_empty": "declared_empty", "stale": "xml_parse"}
MAX_XML_BYTES = 33_554_432
MAX_TEXT_UNITS = 16_000_000


def known(status: str, words: Column) -> Column:
    return F.struct(words.cast("bigint").alias("words"), F.lit(status).alias("status"), F.lit(METHODS[status]).alias("method"), F.lit(None).cast("string").alias("reason"))


def unknown(status: str, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(None).cast("bigint").alias("words"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("method"), reason.alias("reason"))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once a row: the optimizer copies an expression to wherever a CASE or a filter names it."""
    return F.get(F.transform(F.array(x), f), 0)


def counted(words: Column) -> Column:
    """A count; a negative one raises."""
    return known("counted", once(words, lambda w: F.when(w < 0, F.raise_error(F.lit("negative count"))).otherwise(w)))


def reserved_empty() -> Column:
    return known("reserved_empty", F.lit(0))


def structurally_empty() -> Column:
    return known("structurally_empty", F.lit(0))


def not_computed(reason: str = "not measured yet") -> Column:
    return unknown("not_computed", reason)


def unavailable(kind: str, reason: Column | str) -> Column:
    return unknown(f"unavailable_{kind}", reason)


def is_known(status: Column) -> Column:
    return status.isin(*KNOWN)


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units (Spark's length counts code points)."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def reject_by_size(size: Column, measured: Column, limit: int = MAX_XML_BYTES) -> Column:
    return F.when(size > limit, unavailable("too_large", F.format_string(f"%d bytes exceed {limit}", size))).otherwise(measured)


def all_or_nothing(words: Column) -> Column:
    """Aggregate: the sum if there are parts and all are known, else null."""
    return F.when((F.count(F.lit(1)) > 0) & (F.count_if(words.isNull()) == 0), F.sum(words))


def missing(words: Column) -> Column:
    return F.count_if(words.isNull())


def rolled_up(words: Column, parts: Column, absent: Column) -> Column:
    """The measurement of a sum: unknown with ``m of n`` where a part is."""
    reason = F.when(parts == 0, F.lit("nothing to add up")).otherwise(F.format_string("%d of %d parts unknown", absent, parts))
    return F.when((parts > 0) & (absent == 0), known("rolled_up", words)).otherwise(unknown("not_computed", reason))


def violations(df: DataFrame) -> DataFrame:
    """Rows of (words, status, method, reason) that break an invariant, and which; it must be empty."""
    rule = once(
        F.struct("words", "status", "reason"),
        lambda m: F.when(~m["status"].isin(*KNOWN, *UNKNOWN), "status")
        .when(m["words"].isNull() & is_known(m["status"]), "known without words")
        .when(m["words"].isNotNull() & ~is_known(m["status"]), "unknown with words")
        .when(m["words"] < 0, "negative")
        .when(m["words"].isNull() & m["reason"].isNull(), "unknown without reason")
        .when(m["words"].isNotNull() & m["reason"].isNotNull(), "known with reason"),
    )
    return df.withColumn("violation", rule).filter("violation is not null")


def share_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))


def even_share(words: Column, k: Column, rank: Column) -> Column:
    """Whole shares that add up: the first (words mod k) of the order get one more."""
    return F.floor(words / k).cast("bigint") + F.when(rank <= words % k, 1).otherwise(0)
