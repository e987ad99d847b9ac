"""Streaming forms of the counters, deduplication, memo and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quota(requests: DataFrame, key: str, ts: str, limit: int, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Requests of each key in each fixed window; windows older than the watermark are dropped from state."""
    g = requests.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("used"))
    return g.select(key, F.col("w.start").alias("window_start"), "used", (F.col("used") > limit).alias("over_limit"))


def distinct_versions(versions: DataFrame, ts: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Late and repeated rows dropped by key, with bounded state."""
    return versions.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def retention(usage: DataFrame, day: str, today: str, days: int = 90) -> DataFrame:
    """Rows not older than so many days."""
    return usage.filter(F.col(day) >= F.date_sub(F.lit(today).cast("date"), days))


def bucket_take(tokens: float, last: float, now: float, rate: float, burst: float) -> tuple[bool, float]:
    """One token of a bucket refilled at ``rate`` up to ``burst``: (granted, tokens left)."""
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    return (True, tokens - 1) if tokens >= 1 else (False, tokens)


def rate_limited(requests: DataFrame, key: str, ts: str, rate: float = 8.0, burst: float = 4.0) -> DataFrame:
    """(key, ts, granted) of a stream: a token bucket a key, kept in state; requests of a batch are taken in order of time."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, 0.0)
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        out = []
        for at in rows[ts]:
            now = at.timestamp()
            ok, tokens = bucket_take(tokens, last, now, rate, burst)
            last = max(last, now)
            out.append((k[0], at, ok))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=[key, "ts", "granted"])

    kind = dict(requests.dtypes)
    return requests.groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, ts {kind[ts]}, granted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def rate_limited_batch(requests: DataFrame, key: str, ts: str, rate: float = 8.0, burst: float = 4.0) -> DataFrame:
    """The same over a table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, last, out = burst, 0.0, []
        for at in pdf.sort_values(ts, kind="stable")[ts]:
            now = at.timestamp()
            ok, tokens = bucket_take(tokens, last, now, rate, burst)
            last = max(last, now)
            out.append(ok)
        return pdf.sort_values(ts, kind="stable").assign(granted=out)[[key, ts, "granted"]]

    kind = dict(requests.dtypes)
    return requests.select(key, ts).groupBy(key).applyInPandas(run, f"{key} {kind[key]}, {ts} {kind[ts]}, granted boolean")


def memo(results: DataFrame, asked: DataFrame, now: str, negative_minutes: int = 15) -> DataFrame:
    """Of each key asked its stored result: positives last for ever, negatives for some minutes; else a miss."""
    r = results.select("key", "positive", "stored_at", "value")
    fresh = F.col("positive") | (F.col("stored_at") + F.expr(f"interval {negative_minutes} minutes") > F.lit(now).cast("timestamp"))
    j = asked.join(r, "key", "left")
    return j.select("key", F.when(F.col("stored_at").isNull(), "miss").when(fresh, F.when(F.col("positive"), "hit").otherwise("negative hit")).otherwise("expired").alias("outcome"), F.when(fresh & F.col("positive"), F.col("value")).alias("value"))


def apply_batches(stream: DataFrame, apply, checkpoint: str):
    """A stream of loads: each micro-batch goes through ``apply(df, batch_id)`` once."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
