"""Arrow batches in small pieces, so that Python's memory doesn't follow the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Arrow bytes and rows of one piece; a row is never cut.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1024


def slices(batch: pa.RecordBatch | pa.Array, bytes_: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch | pa.Array]:
    """The batch in order, halved until each piece has at most so many bytes and rows."""
    stack = [batch]
    while stack:
        b = stack.pop()
        if len(b) > rows or (len(b) > 1 and b.nbytes > bytes_):
            half = len(b) // 2
            stack += [b.slice(half), b.slice(0, half)]
        else:
            yield b


def together(arrays: tuple[pa.Array, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), names=[str(k) for k in range(len(arrays))])
