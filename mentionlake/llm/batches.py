"""Arrow batches cut by the size of their texts, so that long texts do not fill a worker."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MOST_CHARS = 2_000_000


def _cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(begin, end) of runs of rows whose sizes sum to ``most`` at most; a larger row is alone."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if len(sizes):
        out.append((begin, len(sizes)))
    return out


def frames(batches: Iterable[pd.DataFrame], column: str, most: int = MOST_CHARS) -> Iterator[pd.DataFrame]:
    """Parts of the batches; an empty batch is passed on, so that every input gives a frame."""
    for b in batches:
        sizes = b[column].str.len().fillna(0).to_numpy(dtype=np.int64) if len(b) else np.zeros(0, np.int64)
        for begin, end in _cuts(sizes, most) or [(0, 0)]:
            yield b.iloc[begin:end]


def arrow(batches: Iterable[pa.RecordBatch], columns: Sequence[str], most: int = MOST_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of record batches by the bytes of the named text columns; empty batches are left out."""
    for b in batches:
        if b.num_rows:
            sizes = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
            for begin, end in _cuts(sizes, most):
                yield b.slice(begin, end - begin)
