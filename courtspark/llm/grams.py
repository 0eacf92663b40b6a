"""Word and n-gram hashes of whole texts, computed by numpy on the texts' bytes."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: Texts are hashed in pieces of this many bytes, cut between words; a longer word is hashed on its own.
PIECE = 1 << 16
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _table(separators: bytes) -> np.ndarray:
    """Byte to lower-cased byte, 0 for separators."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    return t


#: Words of anything but white space, and words of digits, letters and what lies outside ASCII.
BLANKS = _table(bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]))
SIGNS = _table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ODD, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(PIECE + 1, _ODD, np.uint64))
        down = np.cumprod(np.full(PIECE + 1, inverse, np.uint64))
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _piece_words(codes: np.ndarray) -> np.ndarray:
    is_word = codes > 0
    edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
    if not len(edge):
        return np.empty(0, np.uint64)
    start, end = edge[::2], edge[1::2]
    up, down = _powers()
    sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * up[: len(codes)], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes, table: np.ndarray = BLANKS) -> np.ndarray:
    """64-bit hashes of the words of a text in order; A-Z count as a-z."""
    codes = table[np.frombuffer(text, np.uint8)]
    if len(codes) <= PIECE:
        return _piece_words(codes)
    gaps = np.flatnonzero(codes == 0)
    out, i = [], 0
    while i < len(codes):
        stop = min(i + PIECE, len(codes))
        if stop < len(codes) and codes[stop]:
            k = np.searchsorted(gaps, stop) - 1
            if k >= 0 and gaps[k] >= i:
                stop = int(gaps[k]) + 1
            else:
                k = np.searchsorted(gaps, i)
                stop = int(gaps[k]) if k < len(gaps) else len(codes)
                out.append(np.array([xxhash.xxh64_intdigest(codes[i:stop].tobytes())], np.uint64))
                i = stop
                continue
        out.append(_piece_words(codes[i:stop]))
        i = stop
    return np.concatenate(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words in order; a shorter, non-empty sequence is one run."""
    if len(words) < n:
        n = len(words)
    if not n:
        return words
    total = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total += words[k : len(words) - n + 1 + k] * np.uint64((_ODD * (2 * k + 3) * (2 * k + 3) + 2 * k) & _MASK | 1)
        return mix(total + np.uint64(n))
