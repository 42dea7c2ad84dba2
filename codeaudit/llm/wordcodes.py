"""Texts of Arrow batches as arrays of word codes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts (column `text`) have some `size` bytes; a longer text is a slice of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(low, high - low)
        low = high


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column, cut at ASCII white space, and the row of each; null texts have none."""
    lists = pc.ascii_split_whitespace(texts)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    words = lists.flatten()
    filled = pc.greater(pc.binary_length(words), 0)
    return words.filter(filled), rows[filled.to_numpy(zero_copy_only=False)]


def codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for every word, equal for equal words, and the words by number."""
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]
