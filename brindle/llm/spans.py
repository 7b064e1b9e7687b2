"""Vectorised work on the bytes of a batch of texts: word spans and their hashes.

Texts are taken from Arrow's buffers as one array of bytes with offsets; no Python string is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_CHUNK = 1 << 20
#: A 64-bit value for each byte.
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _M)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and the text each lies in."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    starts = np.flatnonzero(begins)
    over = np.zeros(n, bool)
    over[:-1] = solid[:-1] & (~solid[1:] | first[1:n])
    over[-1] = solid[-1]
    ends = np.flatnonzero(over) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span (ascending, disjoint), worked off in chunks of about 1 MB.

    The sum of a scrambled value for each pair of byte and place in the span. A polynomial modulo
    2**64 would do with less, but regular texts (such as a Thue-Morse word and its complement) collide in it.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        s, e = starts[i:j] - low, ends[i:j] - low
        # The place of a byte counts from the start of its span; between spans it doesn't matter.
        begin = np.zeros(high - low, np.int64)
        begin[s] = np.diff(s, prepend=0)
        place = np.arange(high - low) - np.cumsum(begin)
        h = _VALUES[data[low:high]] + place.view(np.uint64) * _STEP
        h ^= h >> np.uint64(32)
        h *= _M
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(h, out=sums[1:])
        out[i:j] = (sums[e] - sums[s]) + (e - s).astype(np.uint64) * _M
        i = j
    return mix(out)


def joined(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of data that begin at these places, end to end."""
    over = np.cumsum(lengths, dtype=np.int64)
    return data[np.repeat(begin - over + lengths, lengths) + np.arange(over[-1] if len(over) else 0)]


#: What is left of the first eight bytes (little-endian) of a span of so many bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


def span_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span: up to seven bytes are the key, with their number; longer spans have a hash."""
    short = lengths <= 7
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    n = np.minimum(lengths, 7)
    out = eight[starts] & _MASKS[n] | n.astype(np.uint64) << np.uint64(56)
    if not short.all():
        sizes = lengths[~short]
        ends = np.cumsum(sizes, dtype=np.int64)
        out[~short] = span_hashes(joined(data, starts[~short], sizes), ends - sizes, ends)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span, different for all different spans of up to seven bytes; with fold, A-Z count as a-z."""
    return mix(span_keys(_FOLD[data] if fold else data, starts, ends - starts))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return mix(h)
