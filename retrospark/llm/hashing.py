"""Vectorised hashing of bytes, words and word shingles (NumPy, no Spark)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit value per byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(buffer: np.ndarray, doc_of_byte_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts.

    buffer: the texts' bytes, each followed by one space; doc_of_byte_end: the position after each text's space.
    Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.
    Returns the words' hashes and, per text, how many words precede the end of that text.
    """
    low = _LOWER[buffer]
    word = ~_SPACE[low]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = _powers(int(_BASE), len(buffer) + 1)
    inverse = _powers(pow(int(_BASE), -1, 1 << 64), len(buffer) + 1)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_VALUES[low] * powers[:-1], dtype=U64)))
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))
    return hashes, np.searchsorted(starts, doc_of_byte_end)


def word_slices(starts: np.ndarray, most: int = 1 << 19) -> list[tuple[int, int]]:
    """Ranges of words that start within `most` bytes of each other."""
    cuts = [0, *(np.flatnonzero(np.diff(starts // most)) + 1).tolist(), len(starts)]
    return [(i, j) for i, j in zip(cuts, cuts[1:], strict=False) if i < j]


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
    """A hash of each word's bytes, length and seed, the same wherever the word stands. Works on slices of the bytes."""
    out = np.zeros(len(starts), U64)
    for i, j in word_slices(starts):
        first, s, e = starts[i], starts[i:j] - starts[i], ends[i:j] - starts[i]
        n = int(e[-1])
        powers, inverse = _powers(int(_BASE), n + 1), _powers(pow(int(_BASE), -1, 1 << 64), n + 1)
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_VALUES[data[first : first + n]] * powers[:-1], dtype=U64)))
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64))
    return out if seeds is None else mix(out + seeds)


def shingle_sets(texts: list[bytes | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles, 54 bits, of each of at most 1024 texts: (all values, offsets), sorted within a text.

    A text with fewer than `width` words but at least one gives its whole word sequence as one shingle;
    a text without words (or None) gives none.
    """
    blobs = [t or b"" for t in texts]
    joined = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs)))
    words, upto = word_hashes(joined, ends)
    counts = np.diff(np.concatenate(([0], upto)))
    n = len(words)
    doc_of_word = np.repeat(np.arange(len(blobs)), counts)
    position = np.arange(n) - np.repeat(upto - counts, counts)
    size = np.repeat(counts, counts)
    first = (position + width <= size) | ((position == 0) & (size < width))
    length = np.minimum(size, width)
    h = np.zeros(n, U64)
    for j in range(width):
        shifted = np.zeros(n, U64)
        shifted[: max(0, n - j)] = words[j:]
        h = np.where(j < length, h * _BASE + shifted + U64(1), h)
    keep = np.flatnonzero(first)
    doc, h = doc_of_word[keep], mix(h[keep] ^ (length[keep].astype(U64) << U64(60)))
    # One sort for all texts: the text's number on top, 54 bits of the hash below.
    packed = np.unique((doc.astype(U64) << U64(54)) | (h >> U64(10)))
    doc, h = (packed >> U64(54)).astype(np.int64), packed & U64((1 << 54) - 1)
    return h, np.searchsorted(doc, np.arange(len(blobs) + 1))
