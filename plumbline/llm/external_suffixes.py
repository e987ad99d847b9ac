"""External induced suffix sorting with common prefixes, for texts far larger than memory.

A text is a sequence of naturals on disk; nothing whose size follows it is held.
One scan from the right finds its S*-suffixes, each with the symbols that stand
before it as far as the S*-suffix to its left: these travel with the suffix, so
the text isn't read again. S*-substrings are named by an external sort; their
order is that of the text of names, by recursion. Two passes of a disk-backed
priority queue then carry tuples (suffix, common prefix, run, symbols before it)
from each suffix to the one before it: L-type ones ascending, S-type descending.

A tuple's symbols reach from one S*-suffix to the next; where a text is made of
pieces that end in symbols less than all others, each a symbol of its own, that
is within a piece. Besides one block of each file that is being read there stay in
memory: at most ``limit`` tuples of each of the few queues and sorters in use, and
a number for each symbol that stands before the present one.
"""

from __future__ import annotations

import contextlib
import heapq
import pickle
import uuid
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np

#: Items of a block of a file, at most.
BLOCK = 2048
#: Files merged at once.
FAN = 32
_LAST = 1 << 62


class Store:
    """Files of pickled blocks below ``folder``; counts what its queues and sorters hold."""

    def __init__(self, folder: str, limit: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.base = f"{self.base}/{uuid.uuid4().hex}"
        self.limit, self.held, self.peak, self.files = limit, 0, 0, 0
        self.block = max(1, min(BLOCK, limit // FAN))
        self.fs.create_dir(self.base, recursive=True)

    def hold(self, n: int) -> None:
        self.held += n
        self.peak = max(self.peak, self.held)

    def close(self) -> None:
        with contextlib.suppress(OSError):
            self.fs.delete_dir(self.base)


class Log:
    """Items in the order of their writing, read forward or backward by blocks."""

    def __init__(self, store: Store, items: Iterable = ()):
        self.store, self.path = store, f"{store.base}/{uuid.uuid4().hex}"
        self.out = store.fs.open_output_stream(self.path, compression=None)
        self.block: list = []
        self.places: list[int] = [0]
        self.count = 0
        store.files += 1
        for x in items:
            self.append(x)

    def append(self, item) -> None:
        self.block.append(item)
        self.count += 1
        if len(self.block) == self.store.block:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            raw = pickle.dumps(self.block, protocol=5)
            self.out.write(raw)
            self.places.append(self.places[-1] + len(raw))
            self.block = []

    def done(self) -> Log:
        self._flush()
        self.out.close()
        return self

    def __iter__(self) -> Iterator:
        return self._read(range(len(self.places) - 1), False)

    def __reversed__(self) -> Iterator:
        return self._read(range(len(self.places) - 2, -1, -1), True)

    def _read(self, blocks: Iterable[int], backward: bool) -> Iterator:
        with self.store.fs.open_input_file(self.path) as f:
            for k in blocks:
                f.seek(self.places[k])
                items = pickle.loads(f.read(self.places[k + 1] - self.places[k]))
                yield from reversed(items) if backward else items

    def drop(self) -> None:
        self.store.fs.delete_file(self.path)


class Sorter:
    """Tuples, sorted beyond memory: runs of at most ``limit`` go to disk and are merged."""

    def __init__(self, store: Store):
        self.store, self.held, self.runs = store, [], []

    def push(self, item: tuple) -> None:
        self.held.append(item)
        self.store.hold(1)
        if len(self.held) >= self.store.limit:
            self._spill()

    def _spill(self) -> None:
        self.held.sort()
        self.runs.append(Log(self.store, self.held).done())
        self.store.hold(-len(self.held))
        self.held = []
        if len(self.runs) >= FAN:
            merged = Log(self.store, heapq.merge(*self.runs)).done()
            for r in self.runs:
                r.drop()
            self.runs = [merged]

    def __iter__(self) -> Iterator[tuple]:
        """In order, once."""
        self.held.sort()
        yield from heapq.merge(*self.runs, self.held)
        for r in self.runs:
            r.drop()
        self.store.hold(-len(self.held))
        self.held, self.runs = [], []


class Queue:
    """A monotone priority queue of items by key, first in first out: beyond ``limit`` all it holds goes to a run on disk."""

    def __init__(self, store: Store):
        self.store, self.held, self.keys, self.count = store, {}, [], 0
        self.runs: list[tuple[Log, list]] = []  # a run and its head: [key, item, iterator], or [] at its end

    def push(self, key: int, item: tuple) -> None:
        bucket = self.held.get(key)
        if bucket is None:
            self.held[key] = [item]
            heapq.heappush(self.keys, key)
        else:
            bucket.append(item)
        self.count += 1
        self.store.hold(1)
        if self.count >= self.store.limit:
            self._spill()

    def _spill(self) -> None:
        log = Log(self.store)
        for key in sorted(self.held):
            for item in self.held[key]:
                log.append((key, item))
        self._open(log.done())
        self.store.hold(-self.count)
        self.held, self.keys, self.count = {}, [], 0
        if len(self.runs) >= FAN:
            old = [(log, head) for log, head in self.runs if head]
            rest = [self._rest(head) for _, head in old]
            merged = Log(self.store, heapq.merge(*rest, key=lambda x: x[0])).done()  # of equal keys the older run first
            for log, _ in old:
                log.drop()
            self.runs = []
            self._open(merged)

    def _open(self, log: Log) -> None:
        it = iter(log)
        first = next(it, None)
        self.runs.append((log, [*first, it] if first else []))

    @staticmethod
    def _rest(head: list) -> Iterator[tuple]:
        yield head[0], head[1]
        yield from head[2]

    def least(self) -> int | None:
        while self.keys and self.keys[0] not in self.held:
            heapq.heappop(self.keys)
        keys = [head[0] for _, head in self.runs if head] + self.keys[:1]
        return min(keys) if keys else None

    def take(self, key: int) -> Iterator[tuple]:
        """One after the other, with what is pushed meanwhile; ``key`` is the least."""
        while True:
            run = next(((log, head) for log, head in self.runs if head and head[0] == key), None)
            if run is not None:
                log, head = run
                item = head[1]
                after = next(head[2], None)
                if after is None:
                    head.clear()
                    log.drop()
                    self.runs = [r for r in self.runs if r[1]]
                else:
                    head[:2] = after
                yield item
                continue
            bucket = self.held.pop(key, None)
            if not bucket:
                return
            self.count -= len(bucket)
            for item in bucket:
                self.store.hold(-1)
                yield item


def scan(text: Log, prefix: int) -> Iterator[tuple]:
    """From the right, of the end (position n) and then of each S*-suffix: (position, run of its symbol, L symbols before it, S symbols before those, what it begins with, its S*-substring)."""
    n = text.count
    at, run, large, small, ahead, own = n, 0, [], [], (), ()
    piece: list[int] = []  # from the present S*-suffix leftward
    near: deque = deque(maxlen=max(prefix, 1))
    symbol, is_small, length = -1, False, 0
    for i, c in zip(range(n - 1, -1, -1), reversed(text)):
        now = i < n - 1 and (c < symbol or c == symbol and is_small)
        if is_small and not now:  # i + 1 is an S*-suffix
            yield at, run, tuple(large), tuple(small), ahead, own
            # a substring that is the beginning of another is the greater one; the last one, which meets the end, is the lesser
            own = (*reversed(piece), _LAST) if at < n else tuple(reversed(piece))
            at, run, large, small, ahead, piece = i + 1, length, [], [], tuple(near) if prefix else (), [symbol]
        (small if now else large).append(c)
        piece.append(c)
        near.appendleft(c)
        symbol, is_small, length = c, now, length + 1 if c == symbol else 1
    yield at, run, tuple(large), tuple(small), ahead, own


def _in_memory(text: Log) -> Iterator[int]:
    from .suffix_dedup import sort_suffixes

    yield from sort_suffixes(np.fromiter(text, np.int64, text.count), 1)[0].tolist()


def ordered(store: Store, text: Log) -> Iterator[int]:
    """Positions of the suffixes of a text, in order."""
    if text.count <= store.limit:
        yield from _in_memory(text)
        return
    for _, at, _ in induced(store, text, 0):
        yield at


class _Bucket:
    """Suffixes of one first symbol as they are taken: the common prefix of what one induces with what the last one of equal symbol induced."""

    def __init__(self, cap: int):
        self.cap, self.rank = cap, 0
        self.last: dict[int, int] = {}
        self.ranks: list[int] = []
        self.lows: list[int] = []  # strictly growing, so at most cap of them

    def take(self, common: int) -> None:
        if self.cap:
            while self.lows and self.lows[-1] >= common:
                self.lows.pop()
                self.ranks.pop()
            self.ranks.append(self.rank)
            self.lows.append(common)
        self.rank += 1

    def induce(self, symbol: int) -> int:
        """Called after ``take``: the common prefix of (symbol, the one taken) with the last such one; 1 where that was of another bucket."""
        if not self.cap:
            return 0
        before = self.last.get(symbol)
        self.last[symbol] = self.rank - 1
        return 1 if before is None else min(self.cap, self.lows[bisect_right(self.ranks, before)] + 1)


def _pass(queue: Queue, seeds: Iterator[tuple], cap: int, sign: int, floor: int, out: Log) -> None:
    """One induction. A seed is (symbol, position, run, common prefix with the seed before it, symbols before it, symbols for later); out gets (symbol, position, common prefix with the one before it, run, symbols for later).

    sign: 1 ascending, -1 descending. ``queue`` may have items of its own already.
    """
    seed = next(seeds, None)
    while True:
        keys = [k for k in (queue.least(), seed and sign * seed[0]) if k is not None]
        if not keys:
            return
        key = min(keys)
        c = sign * key
        bucket = _Bucket(cap)
        run_before = 0  # of the one taken last; 0 at a bucket's beginning

        def go(at: int, run: int, common: int, before: tuple, later: tuple) -> None:
            bucket.take(common)
            if before and before[0] >= floor:
                b = before[0]
                queue.push(sign * b, (at - 1, run + 1 if b == c else 1, bucket.induce(b), before[1:], later))

        seeded = False
        while True:
            for at, run, common, before, later in queue.take(key):
                common = common if run_before else 0
                out.append((c, at, common, run, () if before else later))
                go(at, run, common, before, later)
                run_before = run
            if seeded or seed is None or seed[0] != c:
                break
            seeded, fresh = True, True
            while seed is not None and seed[0] == c:
                _, at, run, common, before, later = seed
                if fresh:
                    common = min(run_before, run, cap)
                fresh = False
                go(at, run, common, before, later)
                run_before = run
                seed = next(seeds, None)


def induced(store: Store, text: Log, cap: int, floor: int = 0) -> Iterator[tuple[int, int, int]]:
    """(symbol, position, common prefix with the one before it, at most ``cap``) of the suffixes in order; without a cap common prefixes aren't kept.

    Suffixes that begin with a symbol below ``floor`` are left out: these symbols stand once each.
    """
    n = text.count
    stars, names = Log(store), Sorter(store)
    large, small = (), ()
    for at, run, left, farther, ahead, own in scan(text, cap):
        if at == n:
            large, small = left, farther
        else:
            stars.append((own[0], at, run, left, farther, ahead))
            names.push((own, at))
    stars.done()
    # names by sorting; where some repeat, the order of the text of names
    by_place, kinds, last = Sorter(store), -1, None
    for own, at in names:
        if own != last:
            kinds, last = kinds + 1, own
        by_place.push((at, kinds))
    reduced = None
    ranks = (name for _, name in by_place)
    if kinds + 1 < stars.count:
        reduced = Log(store, ranks).done()
        places = Sorter(store)
        for rank, k in enumerate(ordered(store, reduced)):
            places.push((k, rank))
        ranks = (rank for _, rank in places)
    ranked = Sorter(store)
    for rank, star in zip(ranks, reversed(stars)):
        ranked.push((rank, *star))
    stars.drop()
    if reduced:
        reduced.drop()

    def seeds() -> Iterator[tuple]:
        before: tuple = ()
        for _, c, at, run, left, farther, ahead in ranked:
            common = next((k for k, (x, y) in enumerate(zip(before, ahead)) if x != y), min(len(before), len(ahead))) if cap else 0
            before = ahead
            yield c, at, run, common, left, farther

    # L-type suffixes: from the empty suffix and the S*-suffixes, ascending
    queue, ascending = Queue(store), Log(store)
    if large:
        queue.push(large[0], (n - 1, 1, 0, large[1:], small))
    _pass(queue, seeds(), cap, 1, floor, ascending)
    ascending.done()

    def back() -> Iterator[tuple]:
        common = 0  # an L suffix's with the one after it
        for c, at, before, run, farther in reversed(ascending):
            yield c, at, run, common, farther, ()
            common = before

    # S-type suffixes: from the L-type ones, descending
    descending = Log(store)
    _pass(Queue(store), back(), cap, -1, floor, descending)
    descending.done()
    # of each symbol the L-type suffixes, then the S-type ones
    one, two = iter(ascending), reversed(descending)
    x, y = next(one, None), next(two, None)
    symbol, run_before, after = None, 0, 0
    while x is not None or y is not None:
        if y is None or x is not None and x[0] <= y[0]:
            c, at, common, run, _ = x
            x = next(one, None)
        else:
            c, at, own, run, _ = y
            # in descending order it is the one after it that has their common prefix
            common, after = (after if symbol == c and run_before < 0 else min(abs(run_before), run, cap)), own
            run = -run
            y = next(two, None)
        if symbol != c:
            common = 0
        yield c, at, common
        symbol, run_before = c, run
    ascending.drop()
    descending.drop()
