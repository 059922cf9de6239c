"""Words of whole texts as Arrow arrays, and hashes of runs of words.

A word is a maximal run of bytes other than the six ASCII blanks. Texts are cut
on their UTF-8 bytes, a slice of a batch at a time, so memory stays bounded by
the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 8 << 20


def filled(texts: pa.Array) -> pa.Array:
    """The texts with nulls as empty ones, as one array starting at offset 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an array of strings without nulls."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return flat, (bounds - bounds[0]).astype(np.int64)


def row_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts hold at most ``limit`` bytes, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if total + size > limit and row > start:
            yield batch.slice(start, row - start)
            total, start = 0, row
        total += size
    yield batch.slice(start)


def binary_array(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(
        kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))]
    )


def cut_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words in order as binary, and the bounds of each text among them."""
    flat, bounds = buffers(filled(texts))
    letter = ~BLANK[flat]
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    heads = bounds[:-1][bounds[1:] > bounds[:-1]]
    opens[heads] = letter[heads]
    word_of = np.flatnonzero(opens)
    kept = flat[letter]
    starts = np.flatnonzero(opens[letter])
    array = binary_array(LOWER[kept] if lower else kept, np.append(starts, len(kept)), pa.binary())
    return array, np.searchsorted(word_of, bounds)


def encoded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's position in the array of distinct words, and that array."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def listed(array: pa.Array) -> list:
    """The values as Python objects, without a scalar object for each."""
    return array.to_numpy(zero_copy_only=False).tolist()


def word_digests(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit hash of every word, as two columns of 64 bits."""
    codes, distinct = encoded(words)
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(word) for word in listed(distinct)])
    halves = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return halves[codes, 0], halves[codes, 1]


def mix(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Runs:
    """Hashes of runs of words by prefix sums of one polynomial.

    The hash of words ``a`` to ``b`` depends on those words alone, not on where
    they stand, and takes constant time after one pass over all words.
    """

    def __init__(self, words: np.ndarray, base: int) -> None:
        base |= 1
        powers = np.empty(len(words) + 1, np.uint64)
        powers[0] = 1
        powers[1:] = np.uint64(base)
        np.multiply.accumulate(powers, out=powers)
        inverse = np.empty(len(words) + 1, np.uint64)
        inverse[0] = 1
        inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
        self.inverse = np.multiply.accumulate(inverse)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[:-1], out=sums[1:])
        self.sums = sums

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.inverse[starts])


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of ``width`` words fits into its text."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    return ranges(bounds[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of runs given by their starts and lengths, in order."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)
