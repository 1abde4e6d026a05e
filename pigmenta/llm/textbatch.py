"""Vectorised word handling over Arrow string columns.

A batch of texts is looked at as one byte buffer plus row offsets, so word
boundaries, word hashes and window hashes cost a few numpy passes and no
per-word Python. Rows are processed in groups of bounded bytes (a single longer
row forms a group of its own), whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
_CHUNK = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mask(allowed: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in allowed:
        out[low : high + 1] = True
    return out


#: ``[^\x20\x09-\x0D]+`` byte by byte.
SPACE_WORDS = ~_mask([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` byte by byte, after A-Z were lower-cased.
ALNUM_WORDS = _mask([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: The same over raw bytes: A-Z count as letters because they are lower-cased first.
ALNUM_WORDS_RAW = ALNUM_WORDS | _mask([(0x41, 0x5A)])
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 0x20


#: Most rows that are looked at together.
BATCH_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, ``BATCH_ROWS`` at a time.

    Spark bounds a batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``) and rows; the
    session's settings are left as they are, and what is made from a batch is bounded here.
    """
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(low, BATCH_ROWS)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 1 << 63, dtype=np.uint64)) * 2 % (1 << 64) + 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, _CHUNK + 4096)
            for name, base in (("up", self.base), ("down", self.inverse)):
                seq = np.full(n, base, dtype=np.uint64)
                seq[0] = 1
                setattr(self, name, np.multiply.accumulate(seq))
        return self.up, self.down


_POWERS = [_Powers(_odd(11)), _Powers(_odd(12))]
_TABLES = [np.random.default_rng(21 + i).integers(1, 1 << 63, 256, dtype=np.uint64) for i in range(2)]
_BASES = [np.uint64(_odd(31)), np.uint64(_odd(32))]


def column_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary()).cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        keep = ~column.is_null().to_numpy(zero_copy_only=False)
        if np.any(np.diff(off)[~keep]):
            return column_buffer(column.fill_null(b""))
    return raw[off[0] : off[-1]], off - off[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row."""
    n, low = len(offsets) - 1, 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


class Words:
    """Words of consecutive rows: where they are and to which row they belong."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACE_WORDS) -> None:
        self.raw, self.offsets = raw, offsets
        mask = is_word[raw]
        size = len(raw)
        first, last = offsets[:-1], offsets[1:]
        before = np.zeros(size, dtype=bool)
        before[1:] = mask[:-1]
        before[first[first < size]] = False
        after = np.zeros(size, dtype=bool)
        after[:-1] = mask[1:]
        ends_at = last[last > 0] - 1
        after[ends_at] = False
        self.starts = np.flatnonzero(mask & ~before)
        self.ends = np.flatnonzero(mask & ~after) + 1
        bounds = np.searchsorted(self.starts, offsets)
        self.bounds = bounds
        self.counts = np.diff(bounds)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.is_word = is_word

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0, fold: np.ndarray = IDENTITY) -> np.ndarray:
        """A 64-bit hash of each word's bytes after mapping them through ``fold``."""
        n = len(self.starts)
        out = np.empty(n, dtype=np.uint64)
        table = _TABLES[which][fold]
        table = np.where(self.is_word, table, np.uint64(0))
        low = 0
        while low < n:
            origin = int(self.starts[low])
            high = int(np.searchsorted(self.starts, origin + _CHUNK, "left"))
            high = max(high, low + 1)
            stop = int(self.ends[high - 1])
            up, down = _POWERS[which].get(stop - origin + 1)
            values = table[self.raw[origin:stop]]
            values *= up[: stop - origin]
            at = self.starts[low:high] - origin
            # the length keeps words apart whose bytes differ by a zero-valued tail
            out[low:high] = np.add.reduceat(values, at) * down[at] + (self.ends[low:high] - self.starts[low:high]).astype(np.uint64) * _MULT
            low = high
        return mix64(out)

    def windows(self, k: int) -> np.ndarray:
        """Indices of the words at which ``k`` words of one row start."""
        if len(self.row) < k:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.row[: len(self.row) - k + 1] == self.row[k - 1 :])


def rolling(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every ``k`` consecutive values, in O(log k) passes (not mixed)."""
    if len(values) < k:
        return np.zeros(0, dtype=np.uint64)
    base = int(_BASES[which])
    power = lambda m: np.uint64(pow(base, m, 1 << 64))
    block, width, out, done = values, 1, None, 0
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, done = block, width
            else:  # out covers `done` values from i; the block of `width` values follows
                n = len(values) - (done + width) + 1
                out = out[:n] * power(width) + block[done : done + n]
                done += width
        rest >>= 1
        if rest:
            n = len(values) - 2 * width + 1
            block = block[:n] * power(width) + block[width : width + n]
            width *= 2
    return out[: len(values) - k + 1]


def rolling_min(values: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every ``k`` consecutive values."""
    if len(values) < k:
        return values[:0]
    width, out = 1, values
    while width * 2 <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < k:
        step = k - width
        out = np.minimum(out[: len(out) - step], out[step:])
    return out


def text_groups(batch: pa.RecordBatch, text: str, is_word: np.ndarray = SPACE_WORDS, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) of a batch, group by group."""
    raw, offsets = column_buffer(batch.column(batch.schema.get_field_index(text)))
    for low, high in groups(offsets, limit):
        part = offsets[low : high + 1]
        yield low, high, Words(raw[part[0] : part[-1]], part - part[0], is_word)
