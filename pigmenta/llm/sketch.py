"""Count sketches built per partition, merged by cell range, broadcast at a fixed size.

Each task counts into its own dense array (a byte a cell, or two bits where only 0, 1 and more
matter) and emits it in compressed pieces, as many as the
cluster has tasks; pieces of one cell range meet in one task, which adds them as they
stream in, in two levels where there are very many. The width follows the input up to a
fixed most: that is the proven bound under which it is collected and broadcast. Estimates never fall
below the true count, whatever the load.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import slices

#: Fewest and most cell ranges of a sketch.
PIECES, MOST_PIECES = 64, 4096
#: Bytes of input for which one more task adds up the pieces of a range in the first level.
_FAN_BYTES = 64 << 30
_SCHEMA = pa.schema([("piece", pa.int32()), ("cells", pa.binary())])
_DDL = "piece int, cells binary"


class PartitionCounts:
    """Saturating byte counters of one partition."""

    def __init__(self, width: int, rows: int = 1) -> None:
        self.width, self.rows = width, rows
        self.cells = np.zeros(rows * width, dtype=np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for r in range(self.rows):
            cell, n = np.unique(cells_of(keys, r, self.width), return_counts=True)
            at = cell.astype(np.int64) + r * self.width
            self.cells[at] = np.minimum(self.cells[at] + n.astype(np.int64), 255).astype(np.uint8)

    def parts(self, n: int) -> Iterator[np.ndarray]:
        yield from np.split(self.cells, n)


class PartitionBits:
    """Two bits a cell of one partition: whether it counted any, and whether two or more."""

    def __init__(self, width: int, rows: int = 1) -> None:
        self.width, self.rows = width, rows
        self.any, self.more = (np.zeros(rows * width // 8, dtype=np.uint8) for _ in range(2))

    def add(self, keys: np.ndarray) -> None:
        for r in range(self.rows if len(keys) else 0):
            cell, n = np.unique(cells_of(keys, r, self.width), return_counts=True)
            at = cell.astype(np.int64) + r * self.width
            byte, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
            head = np.flatnonzero(np.diff(byte, prepend=-1))  # first cell in each byte; cells ascend
            byte, held, twice = byte[head], np.bitwise_or.reduceat(bit, head), np.bitwise_or.reduceat(np.where(n > 1, bit, np.uint8(0)), head)
            self.more[byte] |= twice | (self.any[byte] & held)
            self.any[byte] |= held

    def parts(self, n: int) -> Iterator[np.ndarray]:
        for one, two in zip(np.split(self.any, n), np.split(self.more, n)):
            yield np.concatenate([one, two])


def _add_counts(total: np.ndarray | None, part: np.ndarray) -> np.ndarray:
    if total is None:
        return part.astype(np.uint32)
    total += np.minimum(part, np.uint32(0xFFFFFFFF) - total).astype(np.uint32)
    return total


def _add_bits(total: np.ndarray | None, part: np.ndarray) -> np.ndarray:
    if total is None:
        return part.copy()
    half = len(part) // 2
    total[half:] |= part[half:] | (total[:half] & part[:half])
    total[:half] |= part[:half]
    return total


def _packed(piece: int, part: np.ndarray) -> pa.RecordBatch:
    body = zstandard.ZstdCompressor(level=1).compress(part.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([body], pa.binary())], schema=_SCHEMA)


#: Odd multipliers that make the rows of a sketch differ.
_ROWS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def cells_of(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cell of each 64-bit key in one of up to four rows; ``width`` is a power of two."""
    bits = np.uint64(width.bit_length() - 1)
    return ((keys * np.uint64(_ROWS[row])) >> (np.uint64(64) - bits)).astype(np.uint32)


def _merge(batches: Iterator[pa.RecordBatch], kind: type, add: Callable, finish: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for piece, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[piece] = add(sums.get(piece), np.frombuffer(unpacker.decompress(packed.as_py()), dtype=kind))
    for piece, total in sums.items():
        yield _packed(piece, finish(total))


def log_levels(total: np.ndarray) -> np.ndarray:
    """Counts as bytes: 0, 1, 2, 3 as they are, then eight steps an octave."""
    out = np.minimum(total, 3).astype(np.uint8)
    big = total > 3
    out[big] = np.minimum(8 * np.log2(total[big]) - 12, 255).astype(np.uint8)
    return out


def repeated(total: np.ndarray) -> np.ndarray:
    """One bit a cell: whether it counted two or more."""
    return total[len(total) // 2 :]


def present(total: np.ndarray) -> np.ndarray:
    """One bit a cell: whether it counted any."""
    return total[: len(total) // 2]


def bits_at(packed: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The bits of cells in an array of packed bits."""
    return (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & np.uint8(1) != 0


def input_bytes(df: DataFrame) -> int:
    """Size of what a plan reads, by its statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def width_for(df: DataFrame, bytes_a_cell: int, most: int) -> int:
    """A power of two that follows the size of the input, ``most`` at most."""
    cells = max(1 << 14, input_bytes(df) // bytes_a_cell)
    return min(most, 1 << (cells - 1).bit_length())


def merged_sketch(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int, rows: int, quantise: Callable[[np.ndarray], np.ndarray], fan: int | None = None) -> Broadcast:
    """Broadcast sketch over the 64-bit keys of all rows of ``df``.

    It has ``rows * width`` bytes of ``log_levels``, or bits where ``quantise`` is ``present``
    or ``repeated``; a task then counts with two bits a cell, which is all that these need.
    ``width`` is a power of two, 8 * PIECES at least. ``fan`` tasks add up the pieces of one range first.
    """
    bits = quantise is not log_levels
    sketch, add, unit = (PartitionBits, _add_bits, 8) if bits else (PartitionCounts, _add_counts, 1)
    context = df.sparkSession.sparkContext
    pieces = max(PIECES, min(MOST_PIECES, width // 8, 1 << (2 * context.defaultParallelism - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sketch(width, rows)
        held: list[np.ndarray] = []
        n = 0
        for batch in slices(batches):
            for keys in keys_of(batch):
                held.append(keys)
                n += len(keys)
                if n >= 1 << 20:
                    own.add(np.concatenate(held))
                    held, n = [], 0
        if held:
            own.add(np.concatenate(held))
        for i, part in enumerate(own.parts(pieces)):
            if part.any():
                yield _packed(i, part)

    counted, kind = df.mapInArrow(count, _DDL), np.uint8
    tasks = min(pieces, 2 * context.defaultParallelism)
    fan = fan or min(64, 1 + input_bytes(df) // _FAN_BYTES)
    if fan > 1:
        salted = counted.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan)))
        first = salted.repartition(tasks * fan, "piece", "salt").select("piece", "cells")
        counted, kind = first.mapInArrow(lambda b: _merge(b, np.uint8, add, lambda x: x), _DDL), np.uint8 if bits else np.uint32
    merged = counted.repartition(tasks, "piece").mapInArrow(lambda b: _merge(b, kind, add, quantise), _DDL)
    parts = [np.zeros(rows * width // unit // pieces, dtype=np.uint8)] * pieces
    unpacker = zstandard.ZstdDecompressor()
    table = merged.toArrow()  # of fixed size, before compression
    for piece, packed in zip(table.column(0).to_pylist(), table.column(1)):
        parts[piece] = np.frombuffer(unpacker.decompress(packed.as_py()), dtype=np.uint8)
    return context.broadcast(np.concatenate(parts))
