"""Packing documents into fixed windows by minimum bin slack.

A document of more words than a window fills whole windows; what remains of it,
or all of a shorter one, is a piece. Windows are filled one after the other: the
longest remaining length is set, and a subset-sum over bitsets (one bit for each
reachable fill, lengths taken with their remaining counts) finds the multiset
of other lengths that comes closest to the capacity; its counts are read back
from the stored bitsets. Equal lengths being interchangeable, a multiset is used
as often as the counts allow, so the plan needs the histogram of lengths alone:
at most ``capacity`` rows, whatever the input. Pieces then find their windows by
their rank among those of equal length.

Defined cases: a null, empty or blank text has no words: one row with a null
window; a null id is kept; equal rows are packed each; an empty table gives no
rows; extra columns are ignored. Whole texts are packed: nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import chunks, lean, materialize

CAPACITY = 2048
#: Pieces of one length that are ranked by one task.
RANKED = 50_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[:0x21] = True
_SPACE[0x7F] = True


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset {length: times} with the longest length that fills the capacity best; the first such found."""
    longest = max(counts)
    target = capacity - longest
    left = dict(counts)
    left[longest] -= 1
    goal = 1 << target
    everything = (goal << 1) - 1
    bits = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x, n in left.items() if n and x <= target), reverse=True):
        n = min(left[length], target // length)
        k = 1
        while n and not bits & goal:
            k = min(k, n)
            steps.append((length, k, bits))
            bits |= (bits << (length * k)) & everything
            n -= k
            k *= 2
        if bits & goal:
            break
    at = bits.bit_length() - 1
    out = {longest: 1}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + k
            at -= length * k
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(multiset, windows that it fills)] until every piece is placed."""
    counts = {k: n for k, n in counts.items() if n > 0}
    out = []
    while counts:
        chosen = fill(counts, capacity)
        times = min(counts[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((chosen, times))
    return out


def _layout(plans: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a window, first window, offset in the window), in order of length and rank."""
    rows, used, window = [], {}, 0
    for chosen, times in plans:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, used.get(length, 0), n, window, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        window += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            text = pc.fill_null(part.column("text").cast(pa.large_string()), "")
            joined = pc.binary_join_element_wise(text, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
            off = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
            b = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
            space = _SPACE[b]
            ends = np.zeros(len(b), dtype=np.int64)
            ends[1:] = space[1:] & ~space[:-1]
            n = np.add.reduceat(ends, off[:-1] - off[0])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n)], names=["doc_id", "text_hash", "n"])


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n): words between white space of every row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(lean(_counter), "doc_id long, text_hash long, n long")


def pack(docs: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """(window_id, offset, doc_id, piece, start_word, n_words): where every word of every document lies."""
    rows = materialize(lengths(docs))
    start = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int")))
    pieces = rows.filter("n > 0").withColumn("piece", start).withColumn("n_words", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity))
    histogram = pieces.groupBy("n_words").agg(F.count("*").alias("c"))
    counts = {r["n_words"]: r["c"] for r in histogram.collect()}  # at most ``capacity`` rows
    layout = _layout(plan(counts, capacity))
    parts = F.greatest(F.ceil(F.col("c") / ranked), F.lit(1))
    key = [F.asc_nulls_first("doc_id"), F.asc("text_hash"), F.asc("piece")]
    pieces = pieces.join(histogram, "n_words").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), parts)).drop("c", "n")
    ranks = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("n_words", "part").orderBy(*key)).cast("long") - 1)
    before = pieces.groupBy("n_words", "part").agg(F.count("*").alias("k"))
    before = before.withColumn("before", F.sum("k").over(Window.partitionBy("n_words").orderBy("part")) - F.col("k")).drop("k")
    ranks = ranks.join(before, ["n_words", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = (layout[:, 0] << 40) + layout[:, 1]
        for b in batches:
            n, rank = b.column("n_words").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(starts, (n << 40) + rank, side="right") - 1
            length, first, each, window, offset = layout[at].T
            j = rank - first
            piece = b.column("piece").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(window + j // np.maximum(each, 1)), pa.array((offset + j % np.maximum(each, 1) * length).astype(np.int32)), b.column("doc_id"), b.column("piece"), pa.array(piece.astype(np.int64) * capacity), b.column("n_words")],
                names=["window_id", "offset", "doc_id", "piece", "start_word", "n_words"],
            )

    schema = "window_id long, offset int, doc_id long, piece int, start_word long, n_words long"
    placed = ranks.select("n_words", "rank", "piece", "doc_id").mapInArrow(lean(place), schema)
    none = rows.filter("n = 0").select(F.lit(None).cast("long").alias("window_id"), F.lit(None).cast("int").alias("offset"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_word"), F.lit(0).cast("long").alias("n_words"))
    return placed.unionByName(none)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
