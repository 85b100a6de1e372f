"""Vectorised helpers over the UTF-8 bytes of a batch of texts.

A batch is one contiguous byte buffer plus document offsets, as Arrow stores a
string column.  Words, shingles and lines are arrays of positions and 64-bit
hashes over that buffer, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
#: Bytes of text handled at once; one document may exceed it.
BLOCK_BYTES = 2 << 20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int = 7) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


#: A random 64-bit value per byte, so that the polynomial hash is not linear in the byte codes.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: Bytes that belong to words: all but the blank and \t \n \v \f \r.
WORD_NON_BLANK = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
#: Bytes that belong to words: digits, a-z and all beyond ASCII (after lower-casing).
WORD_ALNUM = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buffer and the n + 1 offsets of a string or binary array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batches, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most limit bytes of text each (at least one row), with their bytes and offsets."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows == 0:
            continue
        _, offsets = string_bytes(column)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            part = batch.slice(start, end - start)
            data, own = string_bytes(part.column(part.schema.get_field_index(text)))
            yield part, data, own
            start = end


class Words:
    """Words of a block: starts, ends (byte positions), doc (row of each), first (index of each row's first word, n + 1 long), hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD_NON_BLANK, lower: bool = False):
        n = len(data)
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = word[data]
        begin = inside[:n].copy()
        begin[1:] &= ~inside[: n - 1]
        edges = offsets[:-1][offsets[:-1] < n]
        begin[edges] = inside[edges]
        stop = inside[:n] & ~inside[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        stop[last] = inside[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = self.spans(self.starts, self.ends)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans of the block."""
        if not hasattr(self, "_sums"):
            up, _ = powers(len(self.data))
            self._sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUES[self.data] * up[: len(self.data)], out=self._sums[1:])
        _, down = powers(len(self.data))
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of k words of a row, repeats included; a row of 1..k-1 words has its whole sequence as one."""
    h, n = words.hash, len(words.hash)
    c = constants(k + 1)
    total = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        total += h[j : n - k + 1 + j] * c[j] if n >= k else total
    whole = words.doc[: len(total)] == words.doc[k - 1 :] if n >= k else np.zeros(0, bool)
    out, doc = mix(total[whole] + c[k]), words.doc[: len(total)][whole]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        more = np.array([int((h[words.first[d] : words.first[d + 1]] * c[: counts[d]]).sum(dtype=np.uint64)) for d in short], dtype=np.uint64)
        out = np.concatenate([out, mix(more + c[k] + counts[short].astype(np.uint64) * np.uint64(BASE))])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def distinct_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, one after the other, and the rows + 1 offsets."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(rows + 1))


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of an array (offsets in items) as Arrow binary values."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
