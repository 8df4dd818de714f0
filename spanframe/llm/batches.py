"""Bounded pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text, one row at least: long texts don't pile up in a worker."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    start, used = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and used + size > limit:
            yield start, i
            start, used = i, 0
        used += size
    if start < len(sizes):
        yield start, len(sizes)
