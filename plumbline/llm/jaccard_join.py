"""N-gram Jaccard self-join by a MinHash LSH forest.

Documents are sets of hashed word ``n``-grams. Equal sets are one class. Each
class has ``trees`` signatures of ``depth`` minhashes; a tree's signatures,
sorted, are a prefix trie. One exchange brings all classes below a node of
prefix length ``FLOOR`` together, sorted by signature, so that longer prefixes
are runs within it: the candidates of all lengths from ``depth`` down to
``FLOOR`` are told at once, longest first. Of each node the classes that have a
candidate go on with their exact sets, as bits over the n-grams that two of them
share, and their candidates are verified there. The share of true pairs found so
far is estimated from those verified: a pair of Jaccard J shares a prefix of
length d in one of l trees with probability ``1-(1-J^d)^l``. While that estimate
is below ``recall``, the prefix is shortened by one more level, for the pairs that
no longer one has.

A node's members are all compared, in blocks where they are many; there is no
cap on partners. A pair is taken up once, in the first tree that has it.

``links`` returns a row for each document: the id of its class, by equal sets and
near ones however linked, and the number of other documents that it has a link
to. Pairs are counted where they are verified and never written, as their number
grows as the square of a group's. ``join`` returns pairs: of a set that m documents
have these are its first document with each of the others (m-1 rows of Jaccard 1);
of two near sets it is their first documents.

Defined cases: null ids and texts without words match nothing; a text of fewer
than ``n`` words is one n-gram; rows with equal id and text are one document;
rows with equal id and another text are documents of their own; an empty table
gives no rows; extra columns are ignored by ``join`` and ``links`` and kept by
``deduplicate``, whatever their names. In ``links`` a document without words is a
class of its own; rows without an id are kept each, without a class or links. Case and punctuation of any script don't count, and letters
of scripts without spaces are words of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U64, Words, chunks, discard, lean, materialize, mix, own_names, small_side, whole_groups

N = 3
THRESHOLD = 0.5
RECALL = 0.95
TREES = 16
DEPTH = 5
#: The longest prefix at which the search may stop: at longer ones the estimate rests on the closest pairs alone.
FLOOR = 3
#: A node's rows, and bytes of their sets, that are compared at once (with as many of another block).
BLOCK = 4096
BLOCK_BYTES = 64 << 20
#: Cells of up to so many classes take all their pairs at once.
FEW = 300
#: In larger ones an n-gram that more than this share of the rows has is a bit of each row, any other a list of its rows; and so many pairs are taken at once.
OFTEN = 1 / 16
TILE = 1 << 16
_RNG = np.random.default_rng(7)
_MUL = (_RNG.integers(1, 1 << 31, 256, dtype=np.uint64) * U64(2) + U64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def shingles(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of each word n-gram, repeats included; short texts are one n-gram."""
    w = Words(texts, fold=True)
    g, at = w.ngrams(n)
    doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        tail = np.zeros(len(short), U64)
        for j in range(n - 1):
            has = count[short] > j
            tail[has] = mix(tail[has] * U64(0x100000001B3) + w.hash[w.first[short[has]] + j])
        g, doc = np.concatenate([g, mix(tail)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def _distinct(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's n-grams once, sorted; ``doc`` is sorted already."""
    g = g.copy()
    cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(g)]):
        g[a:b].sort()
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[keep], doc[keep]


def _signer(n: int, trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                g, doc = _distinct(*shingles(part.column("text"), n))
                if not len(g):
                    continue
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                size = np.diff(np.append(first, len(doc)))
                ids = doc[first]
                one = np.bitwise_xor.reduceat(g, first)
                two = np.add.reduceat(mix(g ^ U64(0x5851F42D4C957F2D)), first)
                cls = mix(one * U64(0x9E3779B97F4A7C15) + two)
                low = (g >> U64(32)).astype(np.uint32)
                sig = np.empty((len(first), trees * depth), dtype=np.uint32)
                for j in range(trees * depth):
                    x = low * _MUL[j] + _ADD[j]
                    x ^= x >> np.uint32(15)
                    x *= np.uint32(0x2C1B3C6D)
                    sig[:, j] = np.minimum.reduceat(x, first)
                width = trees * depth * 4
                blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.arange(len(first) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_pl_doc").take(pa.array(ids)), part.column("_pl_text").take(pa.array(ids)), pa.array(cls.astype(np.int64)), pa.array(size.astype(np.int32)), blob],
                    names=["doc_id", "text_hash", "cls", "size", "sig"],
                )

    return run


def signatures(docs: DataFrame, n: int = N, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, text_hash, cls, size, sig) of each row that has an id and words."""
    keyed = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("_pl_doc"), F.xxhash64("text").alias("_pl_text"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(lean(_signer(n, trees, depth)), "doc_id long, text_hash long, cls long, size int, sig binary")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, width)


def _nodes(sig: np.ndarray, d: int) -> np.ndarray:
    """(rows, trees): the trie node of each tree at prefix length ``d``."""
    node = np.zeros(sig.shape[:2], dtype=U64) + (np.arange(sig.shape[1], dtype=U64) + U64(1))
    for k in range(d):
        node = mix(node * U64(0x100000001B3) + sig[:, :, k])
    return node


def _prefixes(trees: int, depth: int, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node = _nodes(_matrix(batch.column("sig"), trees * depth).reshape(-1, trees, depth), d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.ravel().astype(np.int64)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(node))), pa.array(np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), trees)), pa.array(np.repeat(batch.column("size").to_numpy(zero_copy_only=False), trees))],
                    names=["node", "tree", "cls", "size"],
                )

    return run


def _tries(trees: int, depth: int, d: int, above: int):
    """``sig`` cut to what a pass compares: 32 bits of each tree's node at ``d``, those at ``above``, and the signatures in trie order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = _matrix(batch.column("sig"), trees * depth).reshape(-1, trees, depth)
                both = np.concatenate([_nodes(sig, x) >> U64(32) for x in (d, above)], axis=1).astype(np.uint32)
                leaf = np.ascontiguousarray(sig[:, :, d:]).astype(">u4").reshape(len(sig), -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls"), batch.column("size"), pa.array([x.tobytes() for x in both], pa.binary()), pa.array([x.tobytes() for x in leaf], pa.binary())],
                    names=["cls", "size", "nodes", "leaves"],
                )

    return run


def _candidates(trees: int, above: bool, least: float):
    """The rows below one node of a sorted trie that are in a pair whose first tree at this length is this one, and that no longer prefix of an earlier pass had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["cell"]):
            cell, tree = t.column("cell").to_numpy(), t.column("tree").to_numpy()
            size = t.column("size").to_numpy().astype(float)
            block = t.column("block").to_numpy()
            low, high = t.column("low").to_numpy(), t.column("high").to_numpy()
            both = _matrix(t.column("nodes"), 2 * trees)
            nodes, longer = both[:, :trees], both[:, trees:] if above else None
            has = np.zeros(len(cell), dtype=bool)
            s = 1  # neighbours in the trie share the longest prefixes; each step looks one place farther
            alive = np.arange(len(cell))
            while True:
                alive = alive[alive < len(cell) - s]
                alive = alive[cell[alive] == cell[alive + s]]
                if not len(alive):
                    break
                for a in np.array_split(alive, max(1, len(alive) // 100_000)):
                    b = a + s
                    ok = ~(has[a] & has[b])
                    ok &= (low[a] == high[a]) | (block[a] != block[b])  # a cell of two blocks has only their cross pairs
                    a, b = a[ok], b[ok]
                    ok = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
                    a, b = a[ok], b[ok]
                    ok = np.argmax(nodes[a] == nodes[b], axis=1) == tree[a]
                    if longer is not None:
                        ok &= ~(longer[a] == longer[b]).any(axis=1)
                    has[a[ok]] = has[b[ok]] = True
                s += 1
            if has.any():
                yield from t.filter(pa.array(has)).combine_chunks().to_batches()

    return run


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                g, doc = _distinct(*shingles(part.column("text"), n))
                if not len(g):
                    continue
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                ends = np.append(first, len(doc))
                blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(g.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("cls").take(pa.array(doc[first])), blob], names=["cls", "shingles"])

    return run


def _bits(g: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """(m, words): the sets as bits; an n-gram that one row alone has is in no intersection and gets none."""
    _, what, times = np.unique(g, return_inverse=True, return_counts=True)
    return _set_bits(times > 1, what, row, m)


def _set_bits(keep: np.ndarray, what: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """The rows' bits of the n-grams ``keep``; ``what`` is the n-gram of each place."""
    place = (np.cumsum(keep) - 1)[what[keep[what]]]
    row = row[keep[what]]
    width = max(1, -(-int(keep.sum()) // 64))
    out = np.zeros(m * width, dtype=U64)
    np.bitwise_or.at(out, row * width + place // 64, U64(1) << (place % 64).astype(U64))
    return out.reshape(m, width)


class _Shared:
    """Sizes of the intersections of a large cell's sets. Bits of all shared n-grams would be as many as the rows' changes, so that a pair's time followed the cell's rows."""

    def __init__(self, g: np.ndarray, row: np.ndarray, m: int):
        """row: of each n-gram, sorted."""
        _, what, times = np.unique(g, return_inverse=True, return_counts=True)
        often = times > max(1, int(m * OFTEN))
        self.m, self.bits = m, np.ascontiguousarray(_set_bits(often, what, row, m).T)
        rare = (~often & (times > 1))[what]
        self.what, self.row = what[rare], row[rare]
        self.first = np.searchsorted(self.row, np.arange(m + 1))
        self.who = self.row[np.argsort(self.what, kind="stable")]
        self.count = np.bincount(self.what, minlength=len(times))
        self.start = np.cumsum(self.count) - self.count

    def sizes(self, i: int, j: int, low: int) -> np.ndarray:
        """(j - i, m - low): of the rows from i to j with those from low on."""
        out = np.zeros((j - i, self.m - low), dtype=np.int32)
        for x in self.bits:
            out += np.bitwise_count(x[i:j, None] & x[None, low:])
        here = slice(self.first[i], self.first[j])
        what, row = self.what[here], self.row[here] - i
        n = self.count[what]
        if len(n):
            at = np.repeat(self.start[what] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(np.repeat(row, n) * self.m + self.who[at], minlength=(j - i) * self.m).reshape(j - i, self.m)[:, low:].astype(np.int32)
        return out


def _small(grams, row, m: int, size, nodes, longer, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, Jaccard) of the true pairs of a cell of few rows. nodes, longer: (rows, trees); pairs that share one of these were met before."""
    a, b = np.triu_indices(m, 1)
    ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
    a, b = a[ok], b[ok]
    for x in (nodes, longer):
        if x.shape[1]:
            ok = ~(x[a] == x[b]).any(axis=1)
            a, b = a[ok], b[ok]
    if not len(a):
        return
    bits = _bits(grams, row, m)
    step = max(1, (1 << 17) // bits.shape[1])
    common = np.concatenate([np.bitwise_count(bits[a[i : i + step]] & bits[b[i : i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), step)])
    value = common / (size[a] + size[b] - common)
    ok = value >= threshold
    if ok.any():
        yield a[ok], b[ok], value[ok]


def _large(grams, row, m: int, size, nodes, longer, threshold: float, within: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of many rows, tile by tile. within: the first so many rows are one block, and only pairs of both blocks count."""
    if within in (0, m):
        return
    shared = _Shared(grams, row, m)
    met = [np.ascontiguousarray(x.T) for x in (nodes, longer)]
    i = 0
    while i < (within or m):
        low = within or i
        j = min(within or m, i + max(1, TILE // (m - low)))
        new = np.ones((j - i, m - low), dtype=bool) if within else np.arange(low, m)[None] > np.arange(i, j)[:, None]
        for x in met:
            for node in x:
                new &= node[i:j, None] != node[None, low:]
        if new.any():
            common = shared.sizes(i, j, low)
            value = common / (size[i:j, None] + size[None, low:] - common)
            a, b = np.nonzero(new & (value >= threshold))
            value, a, b = value[a, b], a + i, b + low
            ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
            if ok.any():
                yield a[ok], b[ok], value[ok]
        i = j


def _link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of components, the least row of each, after the links (a, b)."""
    while True:
        x, y = label[a], label[b]
        ok = x != y
        if not ok.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[ok], np.minimum(x, y)[ok])
        while (label[label] != label).any():
            label = label[label]


def _sums(depth: int) -> list[str]:
    """Columns of the estimate: for each prefix length the sum of 1/p over the pairs."""
    return [f"whole{d}" for d in range(1, min(FLOOR, depth) + 1)]


def _verifier(trees: int, depth: int, above: bool, threshold: float, pairs: bool):
    """Verifies each cell's candidates: true pairs; or of each class what it has there: a class that it is linked to by them, and its sums."""
    sums = _sums(depth)
    names = ["a", "b", "jaccard"] if pairs else ["cls", "root", "links", "n", *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(least: int) -> Iterator[pa.RecordBatch]:
            if held and sum(len(x[0]) for x in held) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)
                held.clear()

        for t in whole_groups(batches, ["cell"], 2000):
            cells, trees_of, classes, docs, blocks, lows, highs = (t.column(c).to_numpy() for c in ("cell", "tree", "cls", "docs", "block", "low", "high"))
            sizes, both = t.column("size").to_numpy().astype(np.int64), _matrix(t.column("nodes"), 2 * trees)
            sets = t.column("shingles").cast(pa.large_binary()).combine_chunks()
            ends = np.frombuffer(sets.buffers()[1], dtype=np.int64)[sets.offset : sets.offset + len(sets) + 1] // 8
            grams = np.frombuffer(sets.buffers()[2], dtype=U64, count=ends[-1])
            cut = np.flatnonzero(np.diff(cells)) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(cells)]):
                m, tree, cls, doc, size = y - x, trees_of[x], classes[x:y], docs[x:y], sizes[x:y]
                nodes, longer = both[x:y, :tree], both[x:y, trees:] if above else both[x:y, :0]
                cell = grams[ends[x] : ends[y]], np.repeat(np.arange(m), np.diff(ends[x : y + 1])), m, size, nodes, longer, threshold
                if lows[x] != highs[x]:
                    found = _large(*cell, within=int((blocks[x:y] == lows[x]).sum()))
                else:
                    found = _small(*cell) if m <= FEW else _large(*cell)
                label, links, n, whole = np.arange(m), np.zeros(m), np.zeros(m), np.zeros((len(sums), m))
                for a, b, value in found:
                    if pairs:
                        held.append([np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b]), value])
                        yield from out(100_000)
                        continue
                    links += np.bincount(a, doc[b], m) + np.bincount(b, doc[a], m)
                    n += np.bincount(a, minlength=m)
                    for k in range(len(sums)):
                        whole[k] += np.bincount(a, 1 / (1 - (1 - value ** (k + 1)) ** trees), m)
                    label = _link(label, a, b)
                if links.any():
                    at = np.flatnonzero(links)
                    held.append([cls[at], cls[label[at]], links[at].astype(np.int64), n[at].astype(np.int64), *whole[:, at]])
            yield from out(1)

    return run


class Forest:
    """The join's parts: ``members`` (row to class of equal sets), and of these classes ``pairs`` with their exact Jaccard; or, without ``pairs``, their ``edges`` and ``totals``, which are as many as the classes times the trees at most."""

    def __init__(self, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK, pairs: bool = True):
        signed = materialize(signatures(docs, n, trees, depth))
        one = Window.partitionBy("cls").orderBy("doc_id", "text_hash")
        self.members = materialize(signed.select("doc_id", "text_hash", "cls"))
        self.classes = materialize(signed.withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r"))
        discard(signed)
        #: (cls, docs): a class's documents
        self.docs = None if pairs else materialize(self.members.distinct().groupBy("cls").agg(F.count("*").alias("docs")))
        #: (prefix length, pairs so far, share of all true pairs that these are by estimate)
        self.levels: list[tuple[int, int, float]] = []
        found: DataFrame | None = None
        above = depth
        for d in range(min(FLOOR, depth), 0, -1):
            new = self._pass(docs, n, threshold, trees, depth, d, above, block, pairs)
            above = d
            found = new if found is None else found.unionByName(new)
            if pairs:
                p = 1 - F.pow(1 - F.pow("jaccard", F.lit(float(d))), F.lit(float(trees)))
                got = found.agg(F.count("*").alias("n"), F.sum(1 / p).alias("all")).first()
            else:
                got = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(f"whole{d}").alias("all")).first()
            self.levels.append((d, got["n"], got["n"] / got["all"] if got["n"] else 1.0))
            if self.levels[-1][2] >= recall:
                break
        if pairs:
            self.pairs = found
        else:
            self.edges = found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))
            self.totals = found.groupBy("cls").agg(F.sum("links").alias("links"))

    def _pass(self, docs, n, threshold, trees, depth, d, above, block, pairs):
        """True pairs with a common prefix of length ``d``, or their sums; after the first pass, those that have none of length ``above``."""
        first = not self.levels
        schema = "a long, b long, jaccard double" if pairs else "cls long, root long, links long, n long" + "".join(f", {x} double" for x in _sums(depth))
        narrow = self.classes.select("cls", "size", "sig").mapInArrow(lean(_prefixes(trees, depth, d)), "node long, tree int, cls long, size int")
        node = Window.partitionBy("node")
        crowd = narrow.withColumn("m", F.count("*").over(node)).withColumn("mb", 8 * F.sum("size").over(node)).filter("m > 1")
        # a node of many members, or large ones, is cut into blocks; each pair of blocks is a cell
        at = crowd.withColumn("nb", F.least("m", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("mb") / BLOCK_BYTES))).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("nb")).cast("int"))
        at = at.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        at = at.select("node", "tree", "cls", "block", F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high"))
        at = at.withColumn("cell", F.xxhash64("node", "low", "high")).drop("node")
        wide = at.join(self.classes.select("cls", "size", "sig").mapInArrow(lean(_tries(trees, depth, d, above)), "cls long, size int, nodes binary, leaves binary"), "cls")
        width = 4 * (depth - d)
        leaf = F.substring("leaves", F.col("tree") * width + 1, F.lit(width)) if width else F.lit(None).cast("binary")
        wide = wide.select("cell", "tree", "cls", "block", "low", "high", "size", "nodes", leaf.alias("leaf")).repartition("cell").sortWithinPartitions("cell", "leaf", "cls").drop("leaf")
        new = materialize(wide.mapInArrow(lean(_candidates(trees, not first, threshold)), wide.schema))
        if not new.head(1):
            discard(new)
            return docs.sparkSession.createDataFrame([], schema)
        sets = self._sets(docs, n, new.select("cls").distinct())
        weighed = sets.withColumn("docs", F.lit(1).cast("long")) if pairs else sets.join(self.docs, "cls")
        wide = new.join(weighed, "cls").select("cell", "tree", "cls", "block", "low", "high", "size", "docs", "nodes", "shingles").repartition("cell").sortWithinPartitions("cell", "block", "cls")
        true = materialize(wide.mapInArrow(lean(_verifier(trees, depth, not first, threshold, pairs)), schema))
        discard(sets)
        discard(new)
        return true

    def _sets(self, docs, n, who):
        """(cls, shingles) of the classes that have a candidate, from their first documents' texts."""
        need = materialize(self.classes.select("cls", "doc_id", "text_hash").join(who, "cls"))
        keyed = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
        rows = keyed.join(small_side(need), ["doc_id", "text_hash"]).select("cls", "text")
        sets = materialize(rows.mapInArrow(lean(_setter(n)), "cls long, shingles binary").dropDuplicates(["cls"]))
        discard(need)
        return sets


def join(docs: DataFrame, **parameters) -> DataFrame:
    """(kind, doc_id_a, doc_id_b, jaccard): kind ``same`` pairs a class's first document with each other one, ``near`` the first documents of two classes."""
    f = Forest(docs, **parameters)
    rep = f.classes.select("cls", F.col("doc_id").alias("rep"), F.col("text_hash").alias("rh"))
    near = f.pairs.join(rep.select(F.col("cls").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("cls").alias("b"), F.col("rep").alias("rb")), "b")
    near = near.select(F.lit("near").alias("kind"), F.least("ra", "rb").alias("doc_id_a"), F.greatest("ra", "rb").alias("doc_id_b"), "jaccard")
    rest = f.members.distinct().join(rep, "cls").filter("doc_id <> rep or text_hash <> rh")
    same = rest.select(F.lit("same").alias("kind"), F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same)


def links(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, class_id, links) of each document: ``class_id`` is the least hash of the sets that its class has, ``links`` the number of other documents of a Jaccard of ``threshold`` at least."""
    f = Forest(docs, pairs=False, **parameters)
    each = f.docs.join(components(f.edges), "cls", "left").join(f.totals, "cls", "left")
    each = each.select("cls", F.coalesce("root", "cls").alias("class_id"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    mine = f.members.distinct().join(each, "cls").select("doc_id", "text_hash", "class_id", "links")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    named = rows.filter("doc_id is not null").distinct().join(mine, ["doc_id", "text_hash"], "left")
    named = named.select("doc_id", F.coalesce("class_id", F.xxhash64("doc_id", "text_hash")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return named.unionByName(rows.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("links")))


def components(edges: DataFrame) -> DataFrame:
    """(cls, root): of each vertex of ``edges`` (a, b) the least vertex of its connected component.

    Each round takes the least label among neighbours and then follows labels;
    rounds are cut from each other by tables in the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cls"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(label.select(F.col("cls").alias("b"), "root"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("root").alias("other"))
        step = label.join(near, "cls").select("cls", "root", F.least("root", "other").alias("low"))
        hop = step.select(F.col("cls").alias("low"), F.col("low").alias("far"))
        nxt = materialize(step.join(hop, "low", "left").select("cls", F.least("low", F.coalesce("far", "low")).alias("root"), (F.least("low", F.coalesce("far", "low")) != F.col("root")).alias("moved")))
        if not nxt.filter("moved").head(1):
            return nxt.select("cls", "root")
        label = nxt.select("cls", "root")


@own_names
def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each group of near copies (its least id) stays; all columns are kept.

    Of equal rows one stays. Rows without an id or without words all stay.
    """
    f = Forest(docs, pairs=False, **parameters)
    root = components(f.edges)
    rows = f.members.select("doc_id", "text_hash", "cls").distinct().join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = Window.partitionBy("root").orderBy("doc_id", "text_hash")
    repeated = f.members.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    drop = rows.withColumn("_r", F.row_number().over(first)).join(repeated, ["doc_id", "text_hash"]).filter("_r > 1 or times > 1")
    drop = materialize(drop.select(F.col("doc_id").alias("_pl_doc"), F.col("text_hash").alias("_pl_text"), (F.col("_r") > 1).alias("_pl_gone")))
    mine = docs.withColumn("_pl_h", F.xxhash64("text")).withColumn("_pl_d", F.col("doc_id").cast("long"))
    gone = small_side(drop.filter("_pl_gone"))
    on = (mine["_pl_d"] == gone["_pl_doc"]) & (mine["_pl_h"] == gone["_pl_text"])
    kept = mine.join(gone, on, "left_anti")
    if drop.filter("not _pl_gone").head(1):
        # equal rows of a group's first document: one of them
        twice = drop.filter("not _pl_gone").select("_pl_doc", "_pl_text", F.lit(True).alias("_pl_twice"))
        kept = kept.join(twice, (kept["_pl_d"] == twice["_pl_doc"]) & (kept["_pl_h"] == twice["_pl_text"]), "left")
        w = Window.partitionBy("_pl_d", "_pl_h", F.when(F.col("_pl_twice").isNull(), F.monotonically_increasing_id())).orderBy(F.lit(1))
        kept = kept.withColumn("_pl_r", F.row_number().over(w)).filter("_pl_r = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
