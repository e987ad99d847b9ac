"""Quality rules by n-gram perplexity.

A modified Kneser-Ney model over UTF-8 byte 5-grams is counted per language by
Spark over *all* documents: counts, contexts and their discounts are grouped and
joined by Spark, the orders up to 3, whose kinds are few whatever the corpus, are
finished a language at a time. Its log probabilities are stored by sorted key
hashes and score every document in full; where there are more than one array
should hold, they are cut into slices by hash, and each pass over the documents
adds up what one slice knows. No text is shuffled.

Each language then has its own lower and upper band: ``lower`` median deviations
of all its documents below the median score, ``upper`` of all those above it;
documents outside are rejected.

Defined cases: a null or empty text is rejected as ``empty``, one of white space
alone as ``blank``, and neither counts for the bands; a null language is a
language of its own; a short text's score is drawn to its language's mean by
``prior_bytes``, so that chance alone rejects none; equal or repeated rows get
equal verdicts, one row each; an empty table gives an empty result; extra columns
are ignored by ``score`` and kept by ``filter_documents``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U64, chunks, discard, lean, materialize, mix, own_names, small_side

ORDER = 5
PAD = "\x02" * (ORDER - 1)
#: N-grams of one array, which is broadcast; a model of more is cut into slices by hash, each for one pass over the documents.
SLICE_NGRAMS = 4_000_000
#: A lower order's table of at most so many n-grams is broadcast to the next one's, 24 bytes each.
SMALL_KINDS = 250_000
#: Orders finished a language at a time: a language has at most 2**24 kinds of 3 bytes, and in UTF-8 far fewer.
LOW = 3
_SCORES = "_pl_doc long, _pl_text long, lang string, blank boolean, n_bytes long, bits double"


def lang_id(lang: str | None) -> int:
    return zlib.crc32((lang or "").encode()) >> 8


def _grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (language, 5 bytes) at every byte, the document of each, and bytes a document."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(pa.scalar(PAD, pa.large_string()), texts, pa.scalar("", pa.large_string()))
    n = len(joined)
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + n + 1]
    b = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets) - len(PAD)
    m = len(b) - ORDER + 1
    code = np.zeros(m, dtype=U64)
    for j in range(ORDER):
        code <<= U64(8)
        code |= b[j : m + j]
    inside = np.ones(len(b), dtype=bool)
    for k in range(1, ORDER):
        inside[offsets[1:] - k] = False
    code = code[inside[:m]]
    langs = batch.column("lang").dictionary_encode()
    ids = np.array([lang_id(x) for x in langs.dictionary.to_pylist()] + [lang_id(None)], dtype=U64)
    at = pc.fill_null(langs.indices.cast(pa.int64()), len(ids) - 1).to_numpy(zero_copy_only=False)
    code |= np.repeat(ids[at], size) << U64(8 * ORDER)
    return code, np.repeat(np.arange(n), size), size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, c = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(k)
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(c, first)

    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            code, _, _ = _grams(part)
            if len(code):
                held.append(np.unique(code, return_counts=True))
                rows += len(held[-1][0])
                if rows > 800_000:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows > 600_000:  # many kinds: let Spark merge them
                        yield _pairs(*held.pop())
                        rows = 0
    if held:
        yield _pairs(*merged())


def _pairs(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], names=["gram", "n"])


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(gram, n): counts over all documents, combined in each task and then by Spark."""
    counts = docs.select(F.col("text"), F.col("lang").cast("string")).mapInArrow(lean(_count), "gram long, n long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """What is taken from counts 0, 1, 2, and 3 or more. Counts of counts are 1 at least, and what they give is kept within bounds."""
    n1, n2, n3, n4 = (max(x, 1) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(min(max(k - (k + 1) * y * more / less, 0.05 * k), k - (0.05, 0.1, 0.1)[k - 1]) for k, less, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]


def _low_orders(key: tuple[pa.Scalar, ...], counts: pa.Table) -> pa.Table:
    """(l, g, p) of one language's LOW-grams from their counts (g, n): interpolated, lower orders counting distinct left contexts."""
    order = np.argsort(counts.column("g").to_numpy())
    tables = {LOW: (counts.column("g").to_numpy()[order], counts.column("n").to_numpy()[order].astype(float))}
    for k in range(LOW - 1, 0, -1):
        kinds = np.unique(tables[k + 1][0] & ((1 << (8 * k)) - 1), return_counts=True)
        tables[k] = (kinds[0], kinds[1].astype(float))
    p = np.full(1, 1 / 256)
    for k in range(1, LOW + 1):
        g, c = tables[k]
        taken = np.array(discounts(*(int((c == j).sum()) for j in (1, 2, 3, 4))))[np.minimum(c, 3).astype(int)]
        _, first, which = np.unique(g >> 8, return_index=True, return_inverse=True)
        total = np.add.reduceat(c, first)
        left = np.add.reduceat(taken, first) / total
        below = p[np.searchsorted(tables[k - 1][0], g & ((1 << (8 * (k - 1))) - 1))] if k > 1 else p
        p = (c - taken) / total[which] + left[which] * below
    return pa.table({"l": np.full(len(p), key[0].as_py()), "g": tables[LOW][0], "p": p})


def model_table(counts: DataFrame) -> DataFrame:
    """(gram, bits) of every n-gram of ``counts`` (gram, n), written in the shared folder."""
    mask = lambda k: F.lit((1 << (8 * k)) - 1)
    tables = {ORDER: counts.select(F.shiftrightunsigned("gram", 8 * ORDER).alias("l"), F.col("gram").bitwiseAND(mask(ORDER)).alias("g"), "n")}
    for k in range(ORDER - 1, LOW - 1, -1):
        up = tables[k + 1].groupBy("l", F.col("g").bitwiseAND(mask(k)).alias("g")).agg(F.count("*").alias("n"))
        tables[k] = materialize(up) if k > LOW else up
    p = materialize(tables[LOW].groupBy("l").applyInArrow(_low_orders, "l long, g long, p double"))
    for k in range(LOW + 1, ORDER + 1):
        kinds = tables[k].groupBy("l").agg(*[F.count_if(F.col("n") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]).collect()  # a row a language
        taken = counts.sparkSession.createDataFrame([(r["l"], *discounts(r["n1"], r["n2"], r["n3"], r["n4"])[1:]) for r in kinds], "l long, d1 double, d2 double, d3 double")
        w = Window.partitionBy("l", "c")
        t = tables[k].join(small_side(taken), "l").withColumn("c", F.shiftright("g", 8)).withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        t = t.withColumn("total", F.sum("n").over(w)).withColumn("left", F.sum("d").over(w) / F.col("total"))
        below = small_side(p.select(F.col("l").alias("pl"), F.col("g").alias("pg"), F.col("p").alias("below")), SMALL_KINDS)
        t = t.join(below, (F.col("l") == F.col("pl")) & (F.col("g").bitwiseAND(mask(k - 1)) == F.col("pg")))
        now = (F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("below")
        before, p = p, materialize(t.select("l", "g", now.alias("p")))
        discard(before)
    return p.select(F.shiftleft("l", 8 * ORDER).bitwiseOR(F.col("g")).alias("gram"), (-F.log2("p")).cast("float").alias("bits"))


class Arrays:
    """Sorted key hashes with their bits, and a radix index over the hashes' leading bits."""

    def __init__(self, gram: np.ndarray, bits: np.ndarray):
        h = mix(gram.astype(U64))
        order = np.argsort(h)
        self.hash, self.bits = h[order], bits[order].astype(np.float32)
        self.shift = U64(64 - max(8, int(np.ceil(np.log2(len(h) + 1))) + 1))
        self.index = np.searchsorted(self.hash, np.arange(1 << (64 - int(self.shift)), dtype=U64) << self.shift).astype(np.int32)

    def lookup(self, code: np.ndarray) -> np.ndarray:
        """Bits of each n-gram; 0 where it isn't here (but in another slice)."""
        out = np.zeros(len(code), dtype=np.float32)
        if not len(self.hash):
            return out
        h = mix(code)
        at = self.index[h >> self.shift]
        who: np.ndarray | slice = slice(None)
        last = len(self.hash) - 1
        while True:
            found = self.hash[np.minimum(at, last)]
            hit = (found == h) & (at <= last)
            go = ~hit & (found < h) & (at < last)
            if isinstance(who, slice):
                out[hit] = self.bits[at[hit]]
                who = np.flatnonzero(go)
                at, h = at[who] + 1, h[who]
            else:
                out[who[hit]] = self.bits[at[hit]]
                who, at, h = who[go], at[go] + 1, h[go]
            if not len(who):
                return out


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                code, doc, size = _grams(part)
                bits = np.bincount(doc, weights=arrays.lookup(code), minlength=part.num_rows) if len(code) else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_pl_doc"), part.column("_pl_text"), part.column("lang"), part.column("blank"), pa.array(size.astype(np.int64)), pa.array(bits.astype(float))],
                    names=["_pl_doc", "_pl_text", "lang", "blank", "n_bytes", "bits"],
                )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_pl_doc"), F.xxhash64("text").alias("_pl_text"), F.col("lang").cast("string").alias("lang"), F.coalesce(~F.col("text").cast("string").rlike(r"(?U)\S"), F.lit(True)).alias("blank"), F.col("text").cast("string").alias("text"))


def raw_scores(docs: DataFrame, slice_ngrams: int = SLICE_NGRAMS) -> DataFrame:
    """Bits of each document under the model of all documents, written in the shared folder."""
    spark = docs.sparkSession
    counts = materialize(count_ngrams(docs))
    model = model_table(counts)
    slices = max(1, -(-counts.count() // slice_ngrams))
    keyed = _keyed(docs)
    found = []
    for k in range(slices):
        t = model.filter(F.pmod(F.xxhash64("gram"), F.lit(slices)) == k).toArrow()  # about slice_ngrams rows of 12 bytes
        shared = spark.sparkContext.broadcast(Arrays(t.column("gram").to_numpy(), t.column("bits").to_numpy()))
        found.append(materialize(keyed.mapInArrow(lean(_scorer(shared)), _SCORES)))
        shared.destroy()
    discard(counts)
    discard(model)
    if slices == 1:
        return found[0]
    # of equal rows each slice has as many
    all_of = reduce(DataFrame.unionByName, found).groupBy("_pl_doc", "_pl_text", "lang", "blank", "n_bytes").agg(F.sum("bits").alias("bits"), (F.count("*") / slices).cast("int").alias("_times"))
    rows = all_of.withColumn("bits", F.col("bits") / F.col("_times")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return materialize(rows.drop("_times", "_k"))


def score(docs: DataFrame, lower: float = 10.0, upper: float = 6.0, prior_bytes: int = 300, step: float = 1e-3, slice_ngrams: int = SLICE_NGRAMS) -> DataFrame:
    """One row a document: perplexity a byte, its language's bands, and the verdict keep, low, high, blank or empty.

    The tails differ, so each side's deviations are measured by its own documents.
    Medians come from a histogram of all scores in steps of ``step`` bits, so they
    don't depend on the order of rows.
    """
    raw = raw_scores(docs, slice_ngrams)
    base = raw.groupBy("lang").agg(F.sum("bits").alias("_b"), F.sum("n_bytes").alias("_n")).select(F.col("lang").alias("_lang"), (F.col("_b") / F.when(F.col("_n") > 0, F.col("_n"))).alias("_mean"))
    s = raw.join(base, raw["lang"].eqNullSafe(base["_lang"]), "left").withColumn("score_bits", (F.col("bits") + prior_bytes * F.coalesce("_mean", F.lit(0.0))) / (F.col("n_bytes") + prior_bytes)).drop("_lang", "_mean")
    bins = s.filter("n_bytes > 0 and not blank").groupBy("lang", F.round(F.col("score_bits") / step).cast("long").alias("bin")).agg(F.count("*").alias("n"))

    def middle(t: DataFrame, value: str, *by: str) -> DataFrame:
        w = Window.partitionBy("lang", *by)
        t = t.withColumn("_up", F.sum("n").over(w.orderBy(value))).withColumn("_all", F.sum("n").over(w))
        return t.filter(F.col("_up") * 2 >= F.col("_all")).groupBy("lang", *by).agg(F.min(value).alias("mid"))

    med = middle(bins, "bin").withColumnRenamed("lang", "_lang")
    off = bins.join(med, bins["lang"].eqNullSafe(med["_lang"])).select("lang", "n", (F.col("bin") - F.col("mid")).alias("off")).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    sides = middle(off.withColumn("dev", F.col("off") * F.col("side")).filter("dev >= 0"), "dev", "side")
    mad = sides.groupBy(F.col("lang").alias("_lang2")).agg(*[F.greatest(F.max(F.when(F.col("side") == k, F.col("mid"))), F.lit(5)).alias(c) for k, c in ((-1, "_below"), (1, "_above"))])
    bands = med.join(mad, med["_lang"].eqNullSafe(mad["_lang2"])).select("_lang", ((F.col("mid") - lower * F.col("_below")) * step).alias("lower_bits"), ((F.col("mid") + upper * F.col("_above")) * step).alias("upper_bits"))
    out = s.join(bands, s["lang"].eqNullSafe(bands["_lang"]), "left")
    verdict = F.when(F.col("n_bytes") == 0, "empty").when(F.col("blank"), "blank").when(F.col("score_bits") < F.col("lower_bits"), "low").when(F.col("score_bits") > F.col("upper_bits"), "high").otherwise("keep")
    return out.select(F.col("_pl_doc").alias("doc_id"), "_pl_text", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("bits") / F.when(F.col("n_bytes") > 0, F.col("n_bytes")))).alias("perplexity"), "score_bits", "lower_bits", "upper_bits", verdict.alias("verdict"))


@own_names
def filter_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    bad = score(docs, **parameters).filter("verdict <> 'keep'").select(F.col("doc_id").alias("_pl_doc"), "_pl_text", F.col("lang").alias("_pl_lang")).distinct()
    bad = small_side(materialize(bad))
    mine = docs.withColumn("_pl_h", F.xxhash64("text"))
    return mine.join(bad, mine["doc_id"].cast("long").eqNullSafe(bad["_pl_doc"]) & (mine["_pl_h"] == bad["_pl_text"]) & mine["lang"].cast("string").eqNullSafe(bad["_pl_lang"]), "left_anti").select(*[docs[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_pl_text")
