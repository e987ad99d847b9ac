"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on whole Arrow string columns: one concatenated byte buffer,
word boundaries from a byte-class table, and 64-bit word hashes from 8-byte
loads. Batches are cut by bytes, so that memory doesn't follow the row count.
"""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
#: Rows of a batch that goes to Python, where a table is written.
ARROW_ROWS = 2000
U64 = np.uint64
#: Of folded texts that aren't ASCII: what is no letter, mark or digit parts words, and letters of scripts without spaces are words.
_PARTS = r"[^\p{L}\p{M}\p{N}]+"
_SINGLE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
#: What of these a text must have, for either to change its words: other bytes from 0x80 are letters anyhow.
_WIDE = r"[^\x00-\x7F\p{L}\p{M}\p{N}]|" + _SINGLE


def _in_words(b: np.ndarray, fold: bool) -> np.ndarray:
    """Of each byte, whether it belongs to a word: by comparisons, which wrap around, as a look-up a byte takes several times as long."""
    if fold:
        return (b >= 0x80) | (b - np.uint8(0x30) < 10) | ((b | np.uint8(0x20)) - np.uint8(0x61) < 26)
    return (b > 0x20) & (b != 0x7F)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 with wrap-around."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text is about ``limit`` bytes; one long text is never cut."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def lean(run):
    """A mapInArrow function that gives memory back when its task ends: Python workers live on, and would keep it."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


class Words:
    """Words of a string array: ``start``/``end`` bytes, ``doc`` index, ``hash``, and ``first`` word of each document."""

    def __init__(self, texts: pa.Array, fold: bool = False):
        """fold: lower-case words of letters and digits of any script; else what stands between white space."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if fold:
            texts = pc.utf8_lower(texts)
            wide = pc.match_substring_regex(texts, _WIDE)
            if pc.any(wide).as_py():
                spaced = pc.replace_substring_regex(pc.replace_substring_regex(texts.filter(wide), _PARTS, " "), _SINGLE, r" \1 ")
                texts = pc.replace_with_mask(texts, wide, spaced)
        joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        n = len(joined)
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + n + 1]
        raw = joined.buffers()[2]
        base = int(offsets[0]) if n else 0
        size = int(offsets[-1]) - base if n else 0
        self.bytes = np.zeros(size + 8, dtype=np.uint8)
        if size:
            self.bytes[:size] = np.frombuffer(raw, dtype=np.uint8)[base : base + size]
        self.offsets = offsets - base
        mask = _in_words(self.bytes[:size], fold)
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1 if size else np.zeros(0, np.int64)
        if size and mask[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first)) if n else np.zeros(0, np.int64)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        n = len(self.start)
        out = np.full(n, 0x9E3779B97F4A7C15, dtype=U64)
        if not n:
            return out
        loads = np.ndarray((len(self.bytes) - 7,), dtype="<u8", buffer=self.bytes, strides=(1,))
        at, left, who = self.start, self.end - self.start, slice(None)
        while len(at):
            keep = np.minimum(left, 8)
            word = loads[at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((8 - keep).astype(U64) * U64(8)))
            out[who] = mix(out[who] ^ (word + keep.astype(U64)))
            more = np.flatnonzero(left > 8)
            who = more if isinstance(who, slice) else who[more]
            at, left = at[more] + 8, left[more] - 8
        return out

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams, and at which word each starts; none crosses documents."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        g = self.hash[:m].copy()
        for j in range(1, n):
            g = mix(g * U64(0x100000001B3) + self.hash[j : m + j])
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return g[at], at


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; only where that is unset (as in tests) one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import tempfile

        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{qualified(spark, base).rstrip('/')}/{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, resolved once on the driver: without a scheme it is the default one's, for Spark and Python workers alike."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


_written: list[list[str]] = []


@contextlib.contextmanager
def scratch():
    """Yields a function that writes a table to be kept; all other tables written meanwhile are removed at the end."""
    mine: list[str] = []
    kept: set[str] = set()
    spark: SparkSession | None = None
    _written.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        nonlocal spark
        spark = df.sparkSession
        out = materialize(df)
        kept.add(mine[-1])
        return out

    try:
        yield keep
    finally:
        _written.remove(mine)
        if spark is not None:
            for path in mine:
                if path not in kept:
                    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.mode("overwrite")
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:  # long texts: fewer of them at once on either side of the pipe to Python
        spark.conf.set(rows, min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(rows, before)
    for held in _written:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def own_names(run):
    """For a function that keeps its table's columns: those named ``_pl_*``, as its own are, go by other names meanwhile."""

    @functools.wraps(run)
    def inner(docs: DataFrame, *args, **parameters) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        names: dict[str, str] = {}
        for c in docs.columns:
            if c.lower().startswith("_pl_"):
                other = f"own{c}"
                while other.lower() in taken:
                    other = f"own_{other}"
                taken.add(other.lower())
                names[c] = other
        if not names:
            return run(docs, *args, **parameters)
        return run(docs.withColumnsRenamed(names), *args, **parameters).withColumnsRenamed({v: k for k, v in names.items()})

    return inner


#: A written table of at most so many (narrow) rows is broadcast.
BROADCAST_ROWS = 1_000_000


def small_side(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written narrow table as a join's side: broadcast where its counted rows are few, else left to a shuffled join."""
    return F.broadcast(table) if table.count() <= rows else table


def discard(table: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(table.sparkSession, path)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Of a stream sorted by ``key``: tables of about ``rows`` rows or more, none of which splits a group."""
    held: list[pa.RecordBatch] = []
    count = 0

    def changes(t: pa.Table) -> np.ndarray:
        diff = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
        for k in key:
            v = t.column(k).combine_chunks()
            v = v.to_numpy(zero_copy_only=False)
            diff |= v[1:] != v[:-1]
        return np.flatnonzero(diff) + 1

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        cut = changes(t)
        if len(cut):
            last = int(cut[-1])
            yield t.slice(0, last)
            t = t.slice(last)
        held, count = t.combine_chunks().to_batches(), t.num_rows
        rows = max(rows, 2 * count)
    if held:
        yield pa.Table.from_batches(held)
