"""Groups in a sorted stream of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def groups(batches, key: list[str]):
    """Arrow batches in the order of key, cut anew so that no group is split."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        k = np.column_stack([t.column(c).to_numpy() for c in key])
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        if not len(change):
            held = t
            continue
        cut = int(change[-1]) + 1
        held = t.slice(cut)
        yield t.slice(0, cut), np.concatenate([[0], change + 1])
    if held is not None and len(held):
        k = np.column_stack([held.column(c).to_numpy() for c in key])
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        yield held, np.concatenate([[0], change + 1, [len(held)]])
