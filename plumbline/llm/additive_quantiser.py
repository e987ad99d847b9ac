"""Nearest neighbours by additive quantisation.

Full-dimensional codebooks are trained one after the other (k-means) on what the
ones before leave of a sample: the ``sample`` vectors whose rows hash least, which
is all of a smaller table. Every vector is encoded, by a beam search: the ``beam`` best partial sums are kept from codebook
to codebook. Its codes are stored with the squared norm of their sum. A query's
distance to a code is looked up: the products of the query with all codewords
are a table, of which a code takes one entry a codebook. The least of these
distances, ``rerank`` of every block (so that their number grows with the
table), are computed exactly, and the ``k`` nearest remain.

``query`` asks for the rows whose id is divisible by ``EVERY``, ``search`` by
default for every row; all rows but itself are a query's candidates, and nothing
is pruned. Codes lie in blocks, of which a task holds up to ``HELD``, with their
vectors; all queries pass by each task. Codes aren't copied, and queries once for
each task's blocks: fewer bytes than the short lists would be.

Defined cases: rows without an id, and vectors that are null, empty, of another
length than most, or have a null or non-finite element, are left out of both
sides; equal vectors are neighbours at distance 0 and ordered by id; rows of
equal id are each other's candidates only if their vectors differ; of equal rows
(id and vector) one is a candidate, and each gets the same answer in rows of its
own; with fewer than ``k`` candidates all are returned; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import lean, materialize

K = 10
CODEBOOKS = 16
WORDS = 256
BEAM = 6
ITERATIONS = 2
#: Candidates of each block whose exact distance is computed; a block has at most BLOCK rows or so.
RERANK = 400
BLOCK = 16_384
#: Blocks that a task holds at once, in a table of many.
HELD = 8
#: ``query`` takes as queries the rows whose id is divisible by this.
EVERY = 50
#: Vectors that the codebooks are trained on, and their bytes, at most; as many as there are codewords at least.
SAMPLE = 65_536
SAMPLE_BYTES = 64 << 20


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * x @ words.T).argmin(1)


def greedy_residual(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    for c in books:
        x = x - c[nearest(x, c)]
    return x


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norm of the sum of codewords) by beam search; ties go to the lower code.

    The codebooks are trained on greedy residuals, so the greedy path is followed
    too, outside the beam, and taken where it ends nearer.
    """
    codes, error, total = _search(x, books, beam)
    if beam > 1:
        other, error1, total1 = _search(x, books, 1)
        nearer = error1 < error
        codes[nearer], total[nearer] = other[nearer], total1[nearer]
    return codes, (total**2).sum(1)


def _search(x: np.ndarray, books: list[np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, error, sum of codewords) of the best path; errors lack the vector's own norm."""
    n, d = x.shape
    left = x[:, None, :]
    error = np.zeros((n, 1), np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    for c in books:
        width = left.shape[1]
        gain = (c**2).sum(1)[None, None, :] - 2 * (left.reshape(-1, d) @ c.T).reshape(n, width, len(c))
        total = (error[:, :, None] + gain).reshape(n, -1)
        keep = min(beam, total.shape[1])
        best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.tile(np.arange(keep), (n, 1))
        value = np.take_along_axis(total, best, 1)
        order = np.lexsort((best, value), axis=1)
        best, error = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
        which, word = best // len(c), best % len(c)
        left = np.take_along_axis(left, which[:, :, None], 1) - c[word]
        codes = np.concatenate([np.take_along_axis(codes, which[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
    return codes[:, 0].copy(), error[:, 0], x - left[:, 0]


def vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the usable rows, and their dimension."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v")).filter("vec_id is not null and size(v) > 0")
    v = v.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    mode = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (v.filter(F.size("v") == mode["d"]), mode["d"]) if mode else (v, 0)


def seeds(v: DataFrame, d: int, n: int, want: int) -> np.ndarray:
    """The ``want`` vectors whose rows hash least. Only those below a bound are sorted, about four times as many; where that bound leaves too few, all are."""
    share = 4 * want / n
    for low in ([F.col("row") < int(-(1 << 63) + share * (1 << 64))] if share < 1 else []) + [F.lit(True)]:
        got = v.filter(low).orderBy("row", "vec_id").limit(want).select("v").toArrow()
        if got.num_rows == min(want, n):
            break
    return _matrix(got.column("v").combine_chunks(), d) if got.num_rows else np.zeros((0, d), np.float32)


def train(x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, iterations: int = ITERATIONS) -> list[np.ndarray]:
    """Codebooks from the vectors ``x``, in the order of their rows' hashes; each begins with vectors of its own, the first ones first."""
    start = x[: words * codebooks]
    books: list[np.ndarray] = []
    x = x.copy()  # residuals
    parts = [slice(a, a + 4096) for a in range(0, len(x), 4096)]
    for m in range(codebooks):
        mine = start[m * words : (m + 1) * words]
        if len(mine) < min(words, len(start)):
            mine = start[:words]
        c = np.unique(greedy_residual(mine, books), axis=0)
        for _ in range(iterations):
            total, count = np.zeros((len(c), x.shape[1])), np.zeros(len(c), np.int64)
            for p in parts:
                code = nearest(x[p], c)
                count += np.bincount(code, minlength=len(c))
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
                total[code[order][first]] += np.add.reduceat(x[p][order].astype(float), first)
            at = np.flatnonzero(count)
            c[at] = (total[at] / count[at, None]).astype(np.float32)
        for p in parts:
            x[p] -= c[nearest(x[p], c)]
        books.append(c)
    return books


def scores(q: np.ndarray, books: list[np.ndarray], codes: np.ndarray, norm: np.ndarray, rows: int = 1024) -> np.ndarray:
    """(codes, queries): squared distances less the queries' norms, from lookup tables; ``rows`` codes at once stay in the cache."""
    tables = [-2 * (c @ q.T) for c in books]
    by_book = np.ascontiguousarray(codes.T).astype(np.intp)
    out = np.empty((len(codes), len(q)), np.float32)
    some = np.empty((min(rows, len(codes)), len(q)), np.float32)
    for a in range(0, len(codes), rows):
        o = out[a : a + rows]
        o[:] = norm[a : a + rows, None]
        for m, table in enumerate(tables):
            np.take(table, by_book[m, a : a + rows], axis=0, out=some[: len(o)], mode="clip")
            o += some[: len(o)]
    return out


def least(s: np.ndarray, take: int) -> list[np.ndarray]:
    """Of each row of ``s`` the places of its ``take`` least, and of all that equal the last of them."""
    n = s.shape[1]
    if take >= n:
        return [np.arange(n)] * len(s)
    step = max(1, n // 1024)
    guess = min(take // step + take // (2 * step) + 8, (n - 1) // step)  # of a sample: a bound that most often leaves few, and enough
    bound = np.partition(s[:, ::step], guess, axis=1)[:, guess]
    out = []
    for row, b in zip(s, bound):
        at = np.flatnonzero(row <= b)
        if len(at) < take:
            at = np.arange(n)
        few = row[at]
        out.append(at[few <= np.partition(few, take - 1)[take - 1]])
    return out


def search(table: DataFrame, k: int = K, codebooks: int = CODEBOOKS, words: int = WORDS, beam: int = BEAM, iterations: int = ITERATIONS, rerank: int = RERANK, block: int = BLOCK, every: int = 1, sample: int = SAMPLE, held_blocks: int = HELD) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): of each row whose id is divisible by ``every`` its ``k`` nearest others by Euclidean distance."""
    usable, d = vectors(table)
    schema = "vec_id long, neighbour_id long, rank int, distance double"
    if d == 0:
        return table.sparkSession.createDataFrame([], schema)
    v = materialize(usable.groupBy("vec_id", "v").agg(F.count("*").alias("times")).withColumn("row", F.xxhash64("vec_id", "v")))
    n = v.count()
    books = train(seeds(v, d, n, max(words * codebooks, min(sample, SAMPLE_BYTES // (4 * d)))), codebooks, words, iterations)

    def coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                codes, norm = encode(_matrix(part.column("v"), d), books, beam)
                blob = pa.array([x.tobytes() for x in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("row"), part.column("v"), blob, pa.array(norm)], names=["vec_id", "row", "v", "codes", "norm"])

    blocks = max(1, -(-n // block))
    coded = v.mapInArrow(lean(coder), "vec_id long, row long, v array<float>, codes binary, norm float")
    # as many tasks as there are shuffle partitions, and more where a task would hold too many blocks
    tasks = min(blocks, max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // held_blocks)))
    coded = materialize(coded.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int")))
    # a cell is a task's blocks: their codes first, then all queries
    codes = coded.select(F.pmod("block", F.lit(tasks)).alias("cell"), F.lit(0).alias("side"), "block", "vec_id", "row", "v", "codes", "norm")
    each = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    queries = coded.filter(F.col("vec_id") % every == 0).select(each.alias("cell"), F.lit(1).alias("side"), F.lit(0).alias("block"), "vec_id", "row", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm"))
    cells = codes.unionByName(queries).repartition(tasks, "cell").sortWithinPartitions("cell", "side", "block", "vec_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], []

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            q, qid, qrow = _matrix(part.column("v"), d), part.column("vec_id").to_numpy(), part.column("row").to_numpy()
            near, dist = [[] for _ in qid], [[] for _ in qid]
            for code, norm, ids, rows, x in ready:
                short = least(np.ascontiguousarray(scores(q, books, code, norm).T), max(rerank, k + 1))
                for i, at in enumerate(short):
                    at = at[(rows[at] != qrow[i]) | (ids[at] != qid[i])]  # all but the query itself
                    gap = x[at] - q[i]
                    at = at[np.lexsort((ids[at], np.einsum("kd,kd->k", gap, gap)))[:k]]
                    near[i].append(ids[at])
                    dist[i].append(np.sqrt(((x[at].astype(np.float64) - q[i]) ** 2).sum(1)))
            for i in range(len(qid)):
                ids, far = np.concatenate(near[i]), np.concatenate(dist[i])
                best = np.lexsort((ids, far))[:k]
                near[i], dist[i] = ids[best], far[best]
            size = [len(x) for x in near]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, size)), pa.array(np.concatenate(near)), pa.array(np.concatenate(dist)), pa.array(np.repeat(qrow, size))], names=["vec_id", "neighbour_id", "distance", "row"])

        def block_of(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
            t = pa.Table.from_batches(parts).combine_chunks()
            code = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, len(books))
            return code, t.column("norm").to_numpy(), t.column("vec_id").to_numpy(), t.column("row").to_numpy(), _matrix(t.column("v").chunk(0), d)

        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("cell", "side", "block")]
            cut = np.flatnonzero(np.any([np.diff(x) != 0 for x in key], axis=0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if a == b:
                    continue
                part, (cell, side, block) = batch.slice(a, b - a), (int(x[a]) for x in key)
                if held and (cell, side, block) != now:  # a block is whole
                    ready.append(block_of(held))
                    held = []
                if now is None or cell != now[0]:
                    ready = []
                now = (cell, side, block)
                if side == 0:
                    held.append(part)
                elif ready:
                    for s in range(0, part.num_rows, 128):
                        yield answer(part.slice(s, 128))

    near = cells.select("cell", "side", "block", "vec_id", "row", "v", "codes", "norm").mapInArrow(lean(meet), "vec_id long, neighbour_id long, distance double, row long")
    # a query's row is told by its vector too, so that rows of equal id stay apart
    w = Window.partitionBy("vec_id", "row").orderBy("distance", "neighbour_id")
    out = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("vec_id", "row", "neighbour_id", "rank", "distance")
    again = v.filter("times > 1").select("vec_id", "row", "times")
    if again.head(1):
        out = out.join(again, ["vec_id", "row"], "left").withColumn("_k", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
    return out.select("vec_id", "neighbour_id", "rank", "distance")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)
