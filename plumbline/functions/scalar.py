"""Dates, hashes, JSON and small numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def window_start(latest: Column, months: int = 36) -> Column:
    """First day of the window of so many months that ends in the latest one."""
    return F.add_months(F.trunc(latest, "MM"), 1 - months).cast("date")


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def next_midnight(ts: Column) -> Column:
    """Seconds since 1970 of the next UTC midnight."""
    return (F.unix_date(F.date_add(F.to_date(ts), 1)) * F.lit(86400)).cast("bigint")


def format_date(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")


def format_month(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def is_date(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull(), F.lit(False))


def fingerprint(*columns: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 32)


def anonymous_key(salt: str, address: Column, day: Column) -> Column:
    """A day's digest of an address, from which it can't be told."""
    return F.sha2(F.concat_ws("\x00", F.lit(salt), address, F.date_format(day, "yyyy-MM-dd")), 256)


def parse_slugs(text: Column) -> Column:
    """A JSON array of strings; anything else is an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def as_bool(n: Column) -> Column:
    return n.cast("int") != 0


def numeric_string(x: Column) -> Column:
    """A number that may come as a string."""
    return x.try_cast("bigint")


def full_jitter(attempt: Column, base: float = 0.5, cap: float = 30.0, seed: int | None = None) -> Column:
    """Delay before a retry: at most base * 2^attempt and the cap, times a random share."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt)) * (F.rand(seed) if seed is not None else F.rand())


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date from now; null for anything else."""
    seconds = value.try_cast("double")
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(seconds >= 0, seconds).when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double")))


#: (attempts, base seconds, most seconds) of each kind of failure that is tried again.
BUDGETS = {"rate_limited": (6, 1.0, 60.0), "server": (4, 2.0, 60.0), "network": (3, 0.5, 10.0)}


def retry(kind: Column, attempt: Column, suggested: Column, seed: int | None = None, budgets: dict[str, tuple[int, float, float]] = BUDGETS) -> Column:
    """(again, delay) after an attempt (from 1) that failed: what the server suggests, else jitter; no more beyond its kind's budget, or for another kind."""
    delay = F.lit(None).cast("double")
    again = F.lit(False)
    for k, (attempts, base, cap) in budgets.items():
        delay = F.when(kind == k, full_jitter(attempt, base, cap, seed)).otherwise(delay)
        again = F.when(kind == k, attempt < attempts).otherwise(again)
    return F.struct(again.alias("again"), F.when(again, F.coalesce(suggested.cast("double"), delay)).alias("delay"))


def clamp_limit(asked: Column, most: int = 500, default: int = 50) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(asked, F.lit(default)), F.lit(most)))


def format_pct(x: Column) -> Column:
    return F.coalesce(F.concat(F.format_string("%.1f", x * 100), F.lit("%")), F.lit("—"))


def diff_link(title: Column, section: Column, old: Column, new: Column, horizon: str = "2017-01-01") -> Column:
    """A path where there are two versions to compare within the horizon, else null."""
    text = F.concat_ws("/", F.lit("/diff"), title.cast("string"), section, F.date_format(old, "yyyy-MM-dd"), F.date_format(new, "yyyy-MM-dd"))
    return F.when((old < new) & (old >= F.lit(horizon).cast("date")), text)
