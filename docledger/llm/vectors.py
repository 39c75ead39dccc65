"""Vectors of an Arrow column as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array):
    """(rows, matrix of doubles) for each length of vector; rows whose vector is null or
    holds a null or non-finite component are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten()
    flat = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        matrix = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            yield rows[fine], matrix[fine]
