"""Groups of rows from a sorted Arrow stream, one at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs_by(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows that stand together and agree in `keys` (no nulls), in order. Holds one group and one batch."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        edges = np.append(np.flatnonzero(change), table.num_rows).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            name = tuple(table.column(k)[a].as_py() for k in keys)
            if held and name != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = name
    if held:
        yield pa.concat_tables(held)
