"""Vector columns as Arrow batches: validity, dense matrices, packed binaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def dense(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, float64 matrix) of the vectors that are whole: no null, nothing infinite, not empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten()  # leaves out null vectors
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")))
    start = size.cumsum() - size
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        x = values[start[rows][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1)
        yield dim, rows[good], x[good]
