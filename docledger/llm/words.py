"""Words of whole batches of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space between words, and A-Z in lower case.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOWER[65:91] += np.uint64(32)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bytes handled at once; a longer document is handled by itself.
BYTES_AT_ONCE = 1 << 18


def mixed(value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = (value ^ (value >> np.uint64(31))) * MIX
        value = (value ^ (value >> np.uint64(27))) * STEP
    return value ^ (value >> np.uint64(32))


def word_hashes(texts: pa.Array):
    """(first row, hashes, bounds) for consecutive rows; a null text has no words.

    The words of row `first + i` are `hashes[bounds[i] : bounds[i + 1]]`.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + BYTES_AT_ONCE, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        own = data[offsets[first] : offsets[last]]
        yield first, *_hashes(own, offsets[first : last + 1] - offsets[first])
        first = last


def _hashes(data: np.ndarray, offsets: np.ndarray):
    flat = np.flatnonzero(~SPACES[data])
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.ones(len(flat), bool)
    starts[1:] = np.diff(flat) > 1
    begins = np.searchsorted(flat, offsets[:-1])
    starts[begins[begins < len(flat)]] = True
    heads = np.flatnonzero(starts)
    length = np.diff(np.append(heads, len(flat)))
    place = np.arange(len(flat)) - np.repeat(heads, length)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), STEP, np.uint64))
        value = np.add.reduceat(LOWER[data[flat]] * powers[place], heads)
    return mixed(value), np.searchsorted(flat[heads], offsets)
