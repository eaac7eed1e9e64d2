"""Arrow and numpy helpers that the text operators share; each works on one Arrow batch inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of other characters than these (code points 0x20 and 0x09 to 0x0D).
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in smaller ones of about ``most`` bytes of text, whole texts each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            # copied, as string kernels misread arrays that begin inside a buffer
            yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))


def split_words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Bounds (one more than texts) and the flat array of words. A null text has none; ``lower`` maps A-Z only."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    flat = parts.flatten()
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    bounds = before[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
    return bounds, flat if keep.all() else flat.filter(pa.array(keep))


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of words and the dictionary they point to."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; 0 for empty ones."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
