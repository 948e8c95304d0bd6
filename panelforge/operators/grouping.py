"""Sorted Arrow streams cut into whole groups, for operators that run over a partition without collecting it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _differs(left: pa.ChunkedArray | pa.Array, right: pa.ChunkedArray | pa.Array) -> np.ndarray:
    unequal = pc.fill_null(pc.not_equal(left, right), False)
    nulls = pc.not_equal(pc.is_null(left), pc.is_null(right))
    return np.asarray(pc.or_(unequal, nulls))


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a group begins in a table sorted by `keys`; nulls equal each other."""
    n = table.num_rows
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        new[1:] |= _differs(column.slice(1), column.slice(0, n - 1))
    return np.flatnonzero(new)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold only whole groups, from batches sorted by `keys`; at most one group and one batch are kept."""
    pending: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if pending:
            seam = pa.concat_tables([pending[-1].slice(pending[-1].num_rows - 1), table.slice(0, 1)])
            if len(group_starts(seam, keys)) == 2:
                yield pa.concat_tables(pending)
                pending = []
        cut = int(group_starts(table, keys)[-1])
        if cut:
            yield pa.concat_tables([*pending, table.slice(0, cut)])
            pending = []
        pending.append(table.slice(cut))
    if pending:
        yield pa.concat_tables(pending)
