"""Array helpers for tasks: word boundaries, word hashes and shingle hashes of many texts at once.

Both word rules of this subpackage are classes of bytes (every byte of a character outside
ASCII counts as a letter), so they can be read from UTF-8 without decoding it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WHITE = b" \t\n\x0b\x0c\r"


def _table(separators: set[int]) -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[ord("A") : ord("Z") + 1] += 32
    lut[sorted(separators)] = 0
    return lut


#: Letters, digits and all characters outside ASCII; upper case A-Z is lowered, the rest is 0.
ALPHANUMERIC = _table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: Everything but ASCII white space; the null character counts as a letter and takes the place of A, which is lowered.
SPACED = _table({*_WHITE})
SPACED[0] = ord("A")

_LOOK = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOOK2 = np.random.Generator(np.random.PCG64(20250311)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _inverse(x: int) -> int:
    return pow(x, -1, 2**64)


#: So many powers are kept for the next texts; more are made anew where a single word or piece is that long.
KEPT_POWERS = 1 << 22


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (int(_BASE), _inverse(int(_BASE))):
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        made.append(np.multiply.accumulate(out))
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = 1 << 18):
    """Runs (first, end) of texts with about size bytes; a longer text is alone in its run."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: A longer text is read in stretches of so many bytes.
STRETCH = 1 << 20


def stretches(data: np.ndarray, begin: int, end: int, lut: np.ndarray, size: int):
    """Parts (begin, end) of about size bytes, all of which end where no word goes on."""
    while begin < end:
        stop = min(begin + size, end)
        while stop < end:
            gap = np.flatnonzero(lut[data[stop : min(stop + size, end)]] == 0)
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(stop + size, end)
        yield begin, stop
        begin = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a run of texts begin and end, and the lowered bytes (0: no word)."""
    low = lut[data]
    word = low != 0
    before, after = np.empty_like(word), np.empty_like(word)
    if len(word):
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(word))]
        before[cuts] = False
        after[cuts - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1, low


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words wherever they stand."""
    up, down = powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_LOOK[low] * up[: len(low)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece of the bytes, which stand as they are."""
    up, down = powers(len(data) + 1)
    out = []
    for look in (_LOOK, _LOOK2):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(look[data] * up[: len(data)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return out[0], out[1]


def each_text(column: pa.Array, lut: np.ndarray):
    """(number of the text in the column, hashes of its words) for each text, in order."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        if offsets[j] - offsets[i] > STRETCH:  # one long text
            found = []
            for begin, end in stretches(data, int(offsets[i]), int(offsets[j]), lut, STRETCH):
                starts, ends, low = word_bounds(data[begin:end], np.array([0, end - begin]), lut)
                found.append(word_hashes(low, starts, ends))
            yield i, np.concatenate(found)
            continue
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, low = word_bounds(part, at, lut)
        hashes = word_hashes(low, starts, ends)
        cut = np.searchsorted(starts, at)
        for k in range(j - i):
            yield i + k, hashes[cut[k] : cut[k + 1]]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total * _BASE + words[k : k + n]
    out = mix(total)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
