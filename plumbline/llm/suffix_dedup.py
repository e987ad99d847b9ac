"""Passages repeated across documents, by external induced suffix sorting.

1. Every window of ``words`` words holds a minimizer, the least of its hashed
   word 8-grams, and equal windows hold equal ones. Minimizers met in two
   documents or more are kept; all others can't lie in a repeated window.
2. The words of each kept minimizer's windows, its context, go to the shard of
   its hash. Equal contexts are merged there.
3. A shard's contexts are one text, whose suffixes are sorted by induction:
   S*-substrings are named by sorting, their order is found by recursion, and
   two passes of a monotone bucket queue carry (suffix, common prefix) tuples
   from each suffix to the one before it. Many minimizers share a shard that fits
   in memory; one whose contexts have more than ``memory_words`` words is a shard
   of its own, which is never held: its text, substrings, names, queues, order and
   common prefixes are files in the shared folder (``external_suffixes``).
4. Suffixes with a common prefix of ``words`` words or more, of two documents
   or more, are repeats; they are joined to maximal spans of each document.

Words are what stands between white space, compared exactly. The result is the
same as that of one suffix array over all documents.

Defined cases: rows without an id or a text are left out; a text of fewer than
``words`` words has no span; repeats within one document (or rows of equal id)
alone are none; an empty table gives no rows; extra columns are ignored.
``keep`` marks the words whose document has the least id of all that share them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .external_suffixes import Log, Sorter, Store, induced
from .kernels import U64, Words, chunks, lean, materialize, mix, shared_dir

WORDS = 50
GRAM = 8
#: Words of a text that is sorted in memory, about; and the most that one minimizer's contexts may have there.
SHARD_WORDS = 400_000
MEMORY_WORDS = 1_000_000
#: Tuples that each queue or sorter of a shard on disk holds in memory.
TUPLES = 100_000
#: Windows whose minimizers are found at once; less than 2**24.
STEP = 1 << 23
#: Contexts that a task remembers to have sent the words of.
SENT = 1_000_000
#: Words of a shard on disk are greater than its ends.
_FLOOR = 1 << 40


class BucketQueue:
    """A monotone priority queue of (suffix, common prefix) by first word, first in first out."""

    def __init__(self):
        self.held: dict[int, list[int]] = {}

    def push(self, key: int, item: int) -> None:
        bucket = self.held.get(key)
        if bucket is None:
            self.held[key] = [item]
        else:
            bucket.append(item)

    def take(self, key: int) -> list[int]:
        """What the bucket has now, in order; what is pushed into it later is taken by another call."""
        return self.held.pop(key)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end is smaller than all."""
    n = len(t)
    less = np.zeros(n, dtype=bool)
    differ = np.zeros(n, dtype=bool)
    differ[:-1] = t[:-1] != t[1:]
    differ[-1] = True
    less[:-1] = t[:-1] < t[1:]
    at = np.where(differ, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return less[nxt]


def sort_suffixes(t: np.ndarray, cap: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each with the one before it, at most ``cap``) of an array of naturals, by induction."""
    t = np.ascontiguousarray(t, dtype=np.int64)
    n = len(t)
    if n <= 1:
        return np.arange(n), np.zeros(n, np.int64)
    small = _types(t)
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order, common = _order_stars(t, star, cap)
    text = t.tolist()
    kind = small.tolist()
    # the first word's run, for the common prefix of the last L and the first S suffix of a bucket
    left = np.full(n, n)
    left[:-1] = np.where(t[:-1] != t[1:], np.arange(1, n), n)
    run = np.minimum.accumulate(left[::-1])[::-1] - np.arange(n)
    large, large_common = _induce(text, kind, order, common, run, cap, False)
    tiny, tiny_common = _induce(text, kind, large, large_common, run, cap, True)
    # merge: of each first word the L suffixes, then the S suffixes
    large, tiny = np.asarray(large, np.int64), np.asarray(tiny, np.int64)[::-1]
    lc = np.asarray(large_common, np.int64)
    sc = np.asarray(tiny_common, np.int64)[::-1]  # of each with the one after it, as taken in descending order
    sc = np.concatenate([[0], sc[:-1]]) if len(sc) else sc
    both = np.concatenate([large, tiny])
    place = np.argsort(np.concatenate([t[large] * 2, t[tiny] * 2 + 1]), kind="stable")
    sa, lcp = both[place], np.concatenate([lc, sc])[place]
    meet = np.flatnonzero(~small[sa[:-1]] & small[sa[1:]] & (t[sa[:-1]] == t[sa[1:]])) + 1
    lcp[meet] = np.minimum(np.minimum(run[sa[meet - 1]], run[sa[meet]]), cap)
    lcp[1:][t[sa[1:]] != t[sa[:-1]]] = 0
    lcp[0] = 0
    return sa, lcp


def _order_stars(t: np.ndarray, star: np.ndarray, cap: int) -> tuple[list[int], list[int]]:
    """S* suffixes in order, with common prefixes: names of their substrings by sorting, then recursion where names repeat."""
    m = len(star)
    if m == 0:
        return [], []
    raw = t.astype(">u4").tobytes()
    ends = np.append(star[1:] + 1, len(t)).tolist()
    # a substring that is the beginning of another is the greater one; the last one, which meets the end, is the lesser
    keys = [raw[4 * a : 4 * b] + b"\xff\xff\xff\xff" for a, b in zip(star.tolist(), ends)]
    keys[-1] = keys[-1][:-4]
    names = {k: i for i, k in enumerate(sorted(set(keys)))}
    named = np.fromiter((names[k] for k in keys), np.int64, m)
    if len(names) == m:
        rank = np.empty(m, np.int64)
        rank[named] = np.arange(m)
        known = np.zeros(m, np.int64)
    else:
        rank, known = sort_suffixes(named, cap)
    pos = star[rank]
    # equal names span equal words: what the recursion has in common is a lower bound here
    base = np.zeros(m, np.int64)
    base[1:] = np.append(star, len(t))[np.minimum(rank[1:] + known[1:], m)] - pos[1:]
    lcp = np.minimum(base, cap)
    live = np.flatnonzero(lcp[1:] < cap) + 1
    while len(live):
        a, b = pos[live - 1] + lcp[live], pos[live] + lcp[live]
        inside = (a < len(t)) & (b < len(t))
        live, a, b = live[inside], a[inside], b[inside]
        live = live[t[a] == t[b]]
        lcp[live] += 1
        live = live[lcp[live] < cap]
    return pos.tolist(), lcp.tolist()


def _induce(text, kind, seeds, seed_common, run, cap, descending):
    """One pass: from the seeds (S* ascending, or L descending) the suffixes of the other type.

    Returns them in the order taken, each with its common prefix with the one
    taken before it (first of a bucket: 0).
    """
    queue = BucketQueue()
    want = descending  # S suffixes are induced in the descending pass
    out: list[int] = []
    out_common: list[int] = []
    last_rank: dict[int, int] = {}
    ranks: list[int] = []
    lows: list[int] = []
    n = len(text)
    rank = 0
    seeds = list(seeds)
    if descending:
        seeds.reverse()
        # the common prefix with the one taken before, in the other direction
        seed_common = list(seed_common)
        seed_common = [0, *seed_common[:0:-1]] if seed_common else []
    heads = sorted({text[s] for s in seeds} | set(text), reverse=descending)
    at, total = 0, len(seeds)
    push, take, held = queue.push, queue.take, queue.held
    if not descending and kind[n - 1] == want:
        push(text[n - 1], (n - 1) << 8)  # induced by the empty suffix
        last_rank[text[n - 1]] = -1
        ranks.append(-1)
        lows.append(0)
    for c in heads:
        start = rank  # what was induced from before this bucket has one word in common, no more
        previous = -1
        common = 0
        seeded = False
        while True:
            # the bucket's queue, then its seeds; each is (suffix, common prefix with the one before it)
            if c in held:
                items = take(c)
            elif at < total and text[seeds[at]] == c:
                items, seeded = [], True
                i = seeds[at]
                items.append(i << 8 | (min(int(run[previous]), int(run[i]), cap) if previous >= 0 else 0))
                at += 1
                while at < total and text[seeds[at]] == c:
                    items.append(seeds[at] << 8 | seed_common[at])
                    at += 1
            else:
                break
            if not seeded and previous < 0:
                items[0] = items[0] >> 8 << 8
            for item in items:
                i = item >> 8
                common = item & 255
                if not seeded:
                    out.append(i)
                    out_common.append(common)
                while lows and lows[-1] >= common:
                    lows.pop()
                    ranks.pop()
                ranks.append(rank)
                lows.append(common)
                if i and kind[i - 1] == want:
                    b = text[i - 1]
                    before = last_rank.get(b)
                    if before is None:
                        got = 0
                    elif before < start:
                        got = 1
                    else:
                        got = lows[bisect_right(ranks, before)] + 1
                        if got > cap:
                            got = cap
                    last_rank[b] = rank
                    push(b, (i - 1) << 8 | got)
                rank += 1
            previous = items[-1] >> 8
    return out, out_common


def minimizers(w: Words, words: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each run of windows with one minimizer: their least 8-gram, leftmost where equal."""
    span = words - gram + 1
    m = len(w.hash) - words + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = w.hash[: len(w.hash) - gram + 1].copy()
    for j in range(1, gram):
        g = mix(g * U64(0x100000001B3) + w.hash[j : len(g) + j])
    window = np.flatnonzero(w.doc[:m] == w.doc[words - 1 :])
    at = np.empty(m, np.int64)
    for a in range(0, m, STEP):  # a place within a step fits beside 40 bits of the hash
        some = g[a : a + STEP + span - 1]
        least = (some >> U64(24) << U64(24)) | np.arange(len(some), dtype=U64)
        n, have = len(some) - span + 1, 1
        while have * 2 <= span:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        least = np.minimum(least[:n], least[span - have : span - have + n])
        at[a : a + n] = (least & U64((1 << 24) - 1)).astype(np.int64) + a
    at = at[window]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    return g[at[new]], window[new], np.diff(np.append(new, len(at)))


def _minimizers(words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                w = Words(part.column("text"))
                h, at, n = minimizers(w, words, gram)
                ids = part.column("doc_id").take(pa.array(w.doc[at]))
                hashes = part.column("text_hash").take(pa.array(w.doc[at]))
                where = (at - w.first[w.doc[at]]) << 16 | n
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), ids, hashes, pa.array(where)], names=["m", "doc_id", "text_hash", "at"])

    return run


def _contexts(words: int, gram: int):
    """Of each kept minimizer the words of its windows, and their hash; ``m`` comes with its place.

    Of equal contexts a task sends the words with the first alone, ``again`` marks the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                w = Words(part.column("text"))
                lists = part.column("places")
                at = lists.flatten().field("at").to_numpy(zero_copy_only=False)
                m = lists.flatten().field("m")
                size = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), size)
                first = w.first[doc]
                a = first + (at >> 16)
                length = (at & 0xFFFF) + words - 1
                token = (w.hash >> U64(32)).astype(np.uint32)
                ends = np.concatenate([[0], np.cumsum(length)])
                within = np.arange(ends[-1]) - np.repeat(ends[:-1], length)
                index = within + np.repeat(a, length)
                whole = np.zeros(len(a), U64)
                if len(a):
                    whole = mix(np.add.reduceat(mix(w.hash[index] + within.astype(U64) * U64(0x9E3779B97F4A7C15)), ends[:-1]))
                both = mix(whole ^ m.to_numpy(zero_copy_only=False).astype(U64))
                kinds, first_of = np.unique(both, return_index=True)
                fresh = np.array([k not in sent for k in kinds.tolist()], dtype=bool)
                if len(sent) > SENT:
                    sent.clear()  # words are sent once more, no harm
                sent.update(kinds[fresh].tolist())
                send = np.zeros(len(a), dtype=bool)
                send[first_of[fresh]] = True
                body = token[index[np.repeat(send, length)]] if len(index) else token[:0]
                bytes_ = np.concatenate([[0], np.cumsum(np.where(send, length, 0) * 4)]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(bytes_.tobytes()), pa.py_buffer(body.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [m, pa.array(whole.astype(np.int64)), pa.array(~send), part.column("doc_id").take(pa.array(doc)), part.column("text_hash").take(pa.array(doc)), pa.array((a - first).astype(np.int32)), blob],
                    names=["m", "ctx", "again", "doc_id", "text_hash", "at", "tokens"],
                )

    return run


def repeats(texts: list[np.ndarray], low: np.ndarray, high: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows met in two documents: (context, word, least document) from one suffix sort of all contexts.

    low, high: the least and the greatest document of each context.
    """
    size = np.array([len(x) for x in texts])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    kinds, code = np.unique(np.concatenate(texts), return_inverse=True)
    t = np.empty(start[-1], np.int64)
    is_end = np.zeros(len(t), dtype=bool)
    is_end[start[1:] - 1] = True
    t[~is_end] = code + len(texts)
    t[is_end] = np.arange(len(texts))  # each end is a word of its own
    sa, lcp = sort_suffixes(t, words)
    group = np.cumsum(lcp < words)
    which = np.searchsorted(start, sa, side="right") - 1
    full = start[which + 1] - 1 - sa >= words
    sa, group, which = sa[full], group[full], which[full]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least, most = np.minimum.reduceat(low[which], first), np.maximum.reduceat(high[which], first)
    length = np.diff(np.append(first, len(sa)))
    several = np.repeat(least != most, length)
    return which[several], (sa - start[which])[several], np.repeat(least, length)[several]


def _sorter(words: int, shard_words: int, memory_words: int, tuples: int, folder: str):
    def shard(t: pa.Table) -> pa.RecordBatch | None:
        m, ctx = t.column("m").to_numpy(), t.column("ctx").to_numpy()
        doc, at, hashed = t.column("doc_id").to_numpy(), t.column("at").to_numpy(), t.column("text_hash").to_numpy()
        head = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (ctx[1:] != ctx[:-1])]))
        owner = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(m))))
        texts = [np.frombuffer(x, dtype=np.uint32) for x in t.column("tokens").take(pa.array(head)).to_pylist()]
        low, high = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
        _, group, kinds = np.unique(m[head], return_inverse=True, return_counts=True)
        # a minimizer with one context in all documents: its windows are those repeated, and there is nothing to sort
        alone = np.flatnonzero((kinds[group] == 1) & (low != high))
        several = np.flatnonzero(kinds[group] > 1)
        rc, ra, rl, rb = alone, np.zeros(len(alone), np.int64), low[alone], np.array([len(texts[k]) for k in alone], np.int64)
        if len(several):
            c, p, least = repeats([texts[k] for k in several], low[several], high[several], words)
            order = np.lexsort((p, c))
            c, p, least = several[c[order]], p[order], least[order]
            # runs of windows with the same least document, once for each context
            f = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1) | (least[1:] != least[:-1])])) if len(c) else c
            last = np.append(f[1:], len(c)) - 1 if len(c) else c
            rc, ra, rl, rb = (np.concatenate(x) for x in ((rc, c[f]), (ra, p[f]), (rl, least[f]), (rb, p[last] + words)))
            order = np.lexsort((ra, rc))
            rc, ra, rl, rb = rc[order], ra[order], rl[order], rb[order]
        if not len(rc):
            return None
        # every occurrence of the context has its runs
        lo, hi = np.searchsorted(rc, owner, "left"), np.searchsorted(rc, owner, "right")
        row = np.repeat(np.arange(len(owner)), hi - lo)
        k = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(hashed[row]), pa.array(doc[row] == rl[k]), pa.array((at[row] + ra[k]).astype(np.int32)), pa.array((at[row] + rb[k]).astype(np.int32))],
            names=["doc_id", "text_hash", "keep", "start_word", "end_word"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, long in _shards(batches, max(1, shard_words // (2 * words)), memory_words):
            if long is not None:
                yield from external_spans(long, words, tuples, folder)
            elif (out := shard(t)) is not None:
                yield out

    return run


def _shards(batches: Iterator[pa.RecordBatch], rows: int, memory_words: int) -> Iterator[tuple[pa.Table | None, Iterator[pa.Table] | None]]:
    """Of a stream sorted by ``m``: tables of about ``rows`` rows of whole minimizers, and, where one has more than ``memory_words`` words, the stream of its tables instead."""
    stream = iter(batches)
    held: list[pa.RecordBatch] = []
    count, enough = 0, rows
    for b in stream:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < enough:
            continue
        t = pa.Table.from_batches(held)
        m = t.column("m").to_numpy()
        cut = np.flatnonzero(m[1:] != m[:-1])
        if len(cut):
            yield t.slice(0, int(cut[-1]) + 1), None
            t = t.slice(int(cut[-1]) + 1)
        if t.num_rows * 8 + pc.sum(pc.binary_length(t.column("tokens"))).as_py() // 4 > memory_words:
            rest: list[pa.RecordBatch] = []

            def long() -> Iterator[pa.Table]:
                yield t
                for more in stream:
                    same = more.column("m").to_numpy() == m[-1]
                    n = int(same.sum())
                    if n:
                        yield pa.Table.from_batches([more.slice(0, n)])
                    if n < more.num_rows:
                        rest.append(more.slice(n))
                        return

            yield None, long()
            held, count, enough = rest, sum(x.num_rows for x in rest), rows
            continue
        held, count = t.combine_chunks().to_batches(), t.num_rows
        enough = max(rows, min(2 * count, count + memory_words // 64 + 1))
    if held:
        yield pa.Table.from_batches(held), None


def external_spans(tables: Iterator[pa.Table], words: int, tuples: int, folder: str, watch: list | None = None) -> Iterator[pa.RecordBatch]:
    """What ``shard`` gives of one minimizer's rows, in files: nothing that follows their number is held. ``watch`` gets the store."""
    store = Store(folder, tuples)
    if watch is not None:
        watch.append(store)
    text, contexts, rows = Log(store), Log(store), Log(store)
    try:
        k, start, length, low, high, last = -1, 0, 0, 0, 0, None
        for t in tables:
            for ctx, doc, hashed, at, tokens in zip(*(t.column(c).to_pylist() for c in ("ctx", "doc_id", "text_hash", "at", "tokens"))):
                if ctx == last:
                    low, high = min(low, doc), max(high, doc)
                else:
                    if k >= 0:
                        contexts.append((start, length, low, high))
                        start += length + 1
                    k, low, high, last = k + 1, doc, doc, ctx
                    length = len(tokens) // 4
                    for x in np.frombuffer(tokens, np.uint32).tolist():
                        text.append(_FLOOR + x)
                    text.append(k)  # an end is a word of its own, less than all words
                rows.append((k, doc, hashed, at))
        contexts.append((start, length, low, high))
        for log in (text, contexts, rows):
            log.done()
        spans = ((k, 0, length, low) for k, (_, length, low, high) in enumerate(contexts) if low != high) if k == 0 else _windows(store, text, contexts, words)
        yield from _occurrences(spans, rows)
    finally:
        store.close()


def _windows(store: Store, text: Log, contexts: Log, words: int) -> Iterator[tuple[int, int, int, int]]:
    """(context, first word, end, least document) of runs of windows met in two documents, in order."""
    by_place = Sorter(store)
    group = 0
    for _, at, common in induced(store, text, words, _FLOOR):
        group += common < words
        by_place.push((at, group))
    members = Sorter(store)
    of = enumerate(contexts)
    k, (start, length, low, high) = next(of)
    for at, group in by_place:
        while at > start + length:
            k, (start, length, low, high) = next(of)
        if at - start + words <= length:
            members.push((group, k, at - start, low, high))
    met, ends = Log(store), Log(store)
    now, least, most = None, 0, 0
    for group, k, p, low, high in members:
        met.append((group, k, p))
        if group != now:
            if now is not None:
                ends.append((now, least, most))
            now, least, most = group, low, high
        else:
            least, most = min(least, low), max(most, high)
    if now is not None:
        ends.append((now, least, most))
    met.done(), ends.done()
    windows, of = Sorter(store), iter(ends)
    now = None
    for group, k, p in met:
        if group != now:
            now, least, most = next(of)
        if least != most:
            windows.push((k, p, least))
    run = None  # context, first and last window, least document
    for k, p, least in windows:
        if run is not None and run[0] == k and run[2] + 1 == p and run[3] == least:
            run[2] = p
        else:
            if run is not None:
                yield run[0], run[1], run[2] + words, run[3]
            run = [k, p, p, least]
    if run is not None:
        yield run[0], run[1], run[2] + words, run[3]


def _occurrences(spans: Iterator[tuple[int, int, int, int]], rows: Log) -> Iterator[pa.RecordBatch]:
    """Every row (context, document, its text's hash, place) with its context's spans; both in order of context."""
    span = next(spans, None)
    mine, k = [], -1  # a context's spans are within its words
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()))], names=["doc_id", "text_hash", "keep", "start_word", "end_word"])

    for c, doc, hashed, at in rows:
        if c != k:
            k, mine = c, []
            while span is not None and span[0] <= c:
                if span[0] == c:
                    mine.append(span)
                span = next(spans, None)
        out += [(doc, hashed, doc == least, at + a, at + b) for _, a, b, least in mine]
        if len(out) >= 10_000:
            yield batch()
    if out:
        yield batch()


def repeated_spans(docs: DataFrame, words: int = WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS, memory_words: int = MEMORY_WORDS, tuples: int = TUPLES) -> DataFrame:
    """(doc_id, text_hash, keep, start_word, end_word) of every maximal repeated span, words counted from 0."""
    keyed = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = materialize(keyed.mapInArrow(lean(_minimizers(words, gram)), "m long, doc_id long, text_hash long, at long"))
    shared = found.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("m")
    places = found.join(shared, "m").groupBy("doc_id", "text_hash").agg(F.array_distinct(F.collect_list(F.struct("m", "at"))).alias("places"))
    rows = keyed.join(places, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places")
    contexts = rows.mapInArrow(lean(_contexts(words, gram)), "m long, ctx long, again boolean, doc_id long, text_hash long, at int, tokens binary")
    shards = contexts.repartition("m").sortWithinPartitions("m", "ctx", "again")
    spans = shards.mapInArrow(lean(_sorter(words, shard_words, memory_words, tuples, shared_dir(docs.sparkSession))), "doc_id long, text_hash long, keep boolean, start_word int, end_word int")
    w = Window.partitionBy("doc_id", "text_hash", "keep").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_word") <= F.col("_reach"), 0).otherwise(1)).over(w)
    spans = spans.withColumn("_reach", reach).withColumn("_island", island)
    return spans.groupBy("doc_id", "text_hash", "keep", "_island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("_island")


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
