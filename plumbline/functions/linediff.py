"""Minimal line diffs (shortest edit scripts) and hunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .batches import slices, together

MAX_LINES = 5000


def _snake(a, b, alo, ahi, blo, bhi):
    """A middle snake of a shortest edit path, searched from both ends at once."""
    n, m = ahi - alo, bhi - blo
    top = (n + m + 1) // 2
    delta = n - m
    size = 2 * top + 2
    fwd, back = [0] * size, [0] * size
    for d in range(top + 1):
        for k in range(-d, d + 1, 2):
            x = fwd[k + 1] if k == -d or (k != d and fwd[k - 1] < fwd[k + 1]) else fwd[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and a[alo + x] == b[blo + y]:
                x, y = x + 1, y + 1
            fwd[k] = x
            if delta & 1 and -(d - 1) <= delta - k <= d - 1 and x + back[delta - k] >= n:
                return 2 * d - 1, alo + x0, blo + x0 - k, alo + x, blo + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and a[ahi - 1 - x] == b[bhi - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not delta & 1 and -d <= delta - k <= d and x + fwd[delta - k] >= n:
                return 2 * d, ahi - x, bhi - y, ahi - x0, bhi - (x0 - k)
    raise AssertionError


def edits(old: list[str], new: list[str]) -> list[tuple[str, int | None, int | None, str]]:
    """[(op, old index, new index, line)]: equal, delete, insert; as few changes as there can be, in linear space."""
    ids: dict[str, int] = {}
    a = [ids.setdefault(x, len(ids)) for x in old]
    b = [ids.setdefault(x, len(ids)) for x in new]
    keep_a, keep_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    stack = [(0, len(a), 0, len(b))]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            keep_a[alo] = keep_b[blo] = True
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            keep_a[ahi] = keep_b[bhi] = True
        if alo == ahi or blo == bhi:
            continue
        _, x, y, u, v = _snake(a, b, alo, ahi, blo, bhi)
        keep_a[x:u] = True
        keep_b[y:v] = True
        if (x, y) != (alo, blo) or (u, v) != (ahi, bhi):
            stack += [(u, ahi, v, bhi), (alo, x, blo, y)]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and not keep_a[i]:
            out.append(("delete", i, None, old[i]))
            i += 1
        elif j < len(b) and not keep_b[j]:
            out.append(("insert", None, j, new[j]))
            j += 1
        else:
            out.append(("equal", i, j, old[i]))
            i, j = i + 1, j + 1
    return out


EDITS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("old_index", T.IntegerType()), T.StructField("new_index", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.arrow_udf(EDITS)
def line_diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Edits from one array of lines to another; null where a side is null or has more than MAX_LINES lines."""
    kind = to_arrow_type(EDITS)

    def one(a, b):
        if a is None or b is None or len(a) > MAX_LINES or len(b) > MAX_LINES:
            return None
        return edits(a, b)

    for batch in batches:
        for s in slices(together(batch)):
            found = [one(a, b) for a, b in zip(s[0].to_pylist(), s[1].to_pylist())]
            columns = list(zip(*(e for x in found if x for e in x))) or [()] * 4
            structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type)], fields=list(kind.value_type))
            ends = np.cumsum([0] + [len(x or ()) for x in found])
            # a null list is one whose start is null
            starts = pa.array(ends, pa.int32(), mask=np.array([x is None for x in found] + [False]))
            yield pa.ListArray.from_arrays(starts, structs, type=kind)
