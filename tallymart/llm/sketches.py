"""Count-min sketches made per partition and merged slice by slice.

A sketch has several rows of cells; a key falls into one cell of each row, and
the smallest of its cells is never less than how often it was added. Cells stop
at 2, since only "once at most" and "perhaps more" are told apart: two bits per
cell. Slices of the sketches travel compressed to the task that merges them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import words

ROWS = 2
SLICE_BITS = 1 << 20
#: Bounds of a row's cells. The bits of "perhaps more" of all rows are sent to
#: every executor, so the upper bound keeps that at 16 MB whatever the input.
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 26
SLICES = "row int, slice int, once binary, more binary"


def cells_for(keys: int) -> int:
    """A power of two of about eight cells per key, within the bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (8 * max(keys, 1) - 1).bit_length()))


def cells_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    salted = words.mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64)))
    return (salted & np.uint64(cells - 1)).astype(np.int64)


class Partial:
    """The sketch of one partition."""

    def __init__(self, cells: int) -> None:
        self.cells = cells
        self.once = np.zeros((ROWS, cells // 8), np.uint8)
        self.more = np.zeros((ROWS, cells // 8), np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for row in range(ROWS):
            found, times = np.unique(cells_of(keys, row, self.cells), return_counts=True)
            for chosen, again in ((found, False), (found[times > 1], True)):
                byte, bit = chosen >> 3, (1 << (chosen & 7)).astype(np.uint8)
                if again:
                    np.bitwise_or.at(self.more[row], byte, bit)
                    continue
                seen = chosen[(self.once[row][byte] & bit) > 0]
                np.bitwise_or.at(self.more[row], seen >> 3, (1 << (seen & 7)).astype(np.uint8))
                np.bitwise_or.at(self.once[row], byte, bit)

    def slices(self):
        size = min(SLICE_BITS, self.cells) // 8
        out: list[tuple] = []
        for row in range(ROWS):
            for at in range(self.cells // 8 // size):
                part = slice(at * size, at * size + size)
                once, more = self.once[row, part], self.more[row, part]
                if once.any():
                    out.append((row, at, zlib.compress(once.tobytes(), 1), zlib.compress(more.tobytes(), 1)))
        yield batch_of(out)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([row[at] for row in rows], kind) for at, kind in enumerate(kinds)], ["row", "slice", "once", "more"]
    )


def merge(batches):
    """Merge the slices that one task has got; it holds one pair for each."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for row, at, once, more in zip(*(column.to_pylist() for column in batch.columns)):
            once, more = (np.frombuffer(zlib.decompress(x), np.uint8).copy() for x in (once, more))
            have = held.setdefault((row, at), [np.zeros_like(once), np.zeros_like(more)])
            have[1] |= more | (have[0] & once)
            have[0] |= once
    yield batch_of([(row, at, b"", zlib.compress(pair[1].tobytes(), 1)) for (row, at), pair in held.items()])


def merged(partials: DataFrame, cells: int) -> "Repeated":
    """Bring all partial sketches together; only the merged bits are collected."""
    tasks = max(1, min(ROWS * cells // min(SLICE_BITS, cells), 64))
    rows = partials.repartition(tasks, F.col("row"), F.col("slice")).mapInArrow(merge, SLICES).collect()
    bits = np.zeros((ROWS, cells // 8), np.uint8)
    size = min(SLICE_BITS, cells) // 8
    for one in rows:
        bits[one["row"], one["slice"] * size : (one["slice"] + 1) * size] = np.frombuffer(zlib.decompress(one["more"]), np.uint8)
    return Repeated(cells, bits)


class Repeated:
    """Tells which keys may have been added more than once."""

    def __init__(self, cells: int, bits: np.ndarray) -> None:
        self.cells, self.bits = cells, bits

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row in range(ROWS):
            cell = cells_of(keys, row, self.cells)
            out &= (self.bits[row][cell >> 3] >> (cell & 7).astype(np.uint8) & 1) > 0
        return out
