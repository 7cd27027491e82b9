"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bytes of columns that a function of a batch gets at a time; a row is never cut.
PART_BYTES = 1 << 20


def by_parts(fn: Callable[..., pa.Array], *columns: pa.Array, most: int = PART_BYTES) -> pa.Array:
    """``fn(*columns)`` of a function that works row by row, from consecutive rows of at most ``most`` bytes, or one row. What it holds
    besides its result (lists, sort orders) follows a part, not the batch."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    out, left = [], [(0, len(columns[0]))]
    while left:
        begin, end = left.pop()
        if end - begin > 1 and sum(c.slice(begin, end - begin).nbytes for c in columns) > most:
            middle = (begin + end) // 2
            left += [(middle, end), (begin, middle)]
            continue
        rows = pa.array(np.arange(begin, end))
        out.append(fn(*[c if end - begin == len(c) else c.take(rows) for c in columns]))
    return out[0] if len(out) == 1 else pa.concat_arrays(out)
