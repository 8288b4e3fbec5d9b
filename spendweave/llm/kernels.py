"""Slices of Arrow batches by bytes of text, and hashes of all words of a slice at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block (``blocks.py``). A longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of text that one call works on; its arrays take about 60 bytes a byte of text.
CHUNK_BYTES = 1 << 20
#: Byte classes: 0 separates words (0x20, 0x09-0x0D).
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Weights of a byte by its place in a word: a table for 64 places, and a factor for each further 64.
PLACES = 64
_weights: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_weights(places: int) -> tuple[np.ndarray, np.ndarray]:
    if not _weights:
        _weights.append(mix(np.arange(1, 256 * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _weights.append(np.ones(1, np.uint64))
    if len(_weights[1]) * PLACES < places:
        _weights[1] = mix(np.arange(2 * places // PLACES + 2, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        _weights[1][0] = 1
    return _weights[0], _weights[1]


def _byte_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings between ``starts`` and ``ends``, in order and apart: sums of a random weight for every byte at its place.

    Unlike powers of a base, the weights of different places have no relation that texts could follow. Different strings get the same
    hash with a chance of about 2^-64.
    """
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
    weights, factors = _byte_weights(int(sizes.max()))
    at = place + np.repeat(starts, sizes)
    value = weights[((place & (PLACES - 1)) << 8) + data[at]]
    if int(sizes.max()) > PLACES:
        value *= factors[place // PLACES]
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix(sums[first + sizes] - sums[first] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, one text after another, and where texts begin and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups_of(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of text, or one row. Null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column).fill_null("")
        batch = batch.set_column(column, batch.schema.field(column), text)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        at, used = 0, 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, used + most, side="right")))
            yield batch.slice(at, to - at)
            at, used = to, int(ends[to - 1])


def merged_groups(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Like ``groups_of``, with small neighbours put together."""
    held, size = [], 0
    for group in groups_of(batches, column, most):
        own = int(pc.sum(pc.binary_length(group.column(column))).as_py() or 0)
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(group)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    return groups_of(batches, column, CHUNK_BYTES)


def token_hashes(data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and each text's first word's number (one more at the end).

    Words are maximal runs without separators; with ``kinds`` (a class for each byte value, 0 for separators)
    they also end where the class changes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    kind = (~SEPARATOR).astype(np.uint8)[data] if kinds is None else kinds[data]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[bounds[:-1][bounds[:-1] < n]] = True
    last = np.empty(n, bool)
    last[:-1] = first[1:]
    last[-1] = True
    word = kind != 0
    starts, ends = np.flatnonzero(first & word), np.flatnonzero(last & word) + 1
    hashes = _byte_sums(data, starts, ends)
    return hashes, np.searchsorted(starts, bounds)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of whole strings."""
    data, bounds = text_bytes(strings)
    return _byte_sums(data, bounds[:-1], bounds[1:])


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word sequences of ``size`` words, and where texts begin; a shorter text is one sequence, an empty one none."""
    counts = np.diff(bounds)
    step = [mix(np.full(1, k + 1, np.uint64))[0] | np.uint64(1) for k in range(size)]
    if len(words) >= size:
        total = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            total += words[k:len(words) - size + 1 + k] * step[k]
        total = np.concatenate([total, np.zeros(size - 1, np.uint64)])
    else:
        total = np.zeros(len(words), np.uint64)
    keep = np.ones(len(words), bool)
    for k in range(1, size):  # sequences that would run over the end of their text
        at = bounds[1:] - k
        keep[at[at >= bounds[:-1]]] = False
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        a, b = bounds[t], bounds[t + 1]
        short = (words[a:b] * np.array(step[:b - a], np.uint64)).sum(dtype=np.uint64, keepdims=True)
        total[a], keep[a] = mix(short ^ np.uint64(0x5851F42D4C957F2D + int(b - a)))[0], True
    before = np.concatenate(([0], np.cumsum(keep)))
    return mix(total[keep]), before[bounds]
