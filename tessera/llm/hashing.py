"""Fingerprints in numpy: of words by their own bytes, of short byte ranges by prefix sums with 64-bit wrap-around."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _byte_table() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTES = _byte_table()
#: ASCII capitals to small letters, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word of more bytes is digested on its own.
LONG = 64
_KEY = np.uint64(0x2545F4914F6CDD1D)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0..n-1, and its inverse to the same powers."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix(data: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """Sums over 0..i of byte value times base to its position; entry i is before byte i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:], dtype=np.uint64)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranges(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte ranges [begin, end), equal for equal bytes wherever they are.

    For ranges of some hundred bytes: modulo a power of two, there are different strings of 1024 bytes that agree whatever the base.
    """
    return mixed((sums[end] - sums[begin]) * powers(len(sums))[1][begin])


#: White space between words: blank and the controls from tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def spelled(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [begin, end) by all their bytes, eight a step with a mixing round after each; long ranges by BLAKE2."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - begin
    out = mixed(size.astype(np.uint64) + _KEY)
    every = np.flatnonzero(size <= LONG)
    for j in range(0, LONG, 8):
        every = every[size[every] > j] if j else every
        if not len(every):
            break
        out[every] = mixed((out[every] ^ (eight[begin[every] + j] & _MASK[np.minimum(size[every] - j, 8)])) * _KEY)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of concatenated rows, and at which word each row begins (and the last ends)."""
    word = ~SPACE[part]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[:-1][bounds[:-1] < len(part)]
    first[inner] |= word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = bounds[1:][bounds[1:] > 0] - 1
    last[inner] |= word[inner]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return spelled(part, begin, end), np.searchsorted(begin, bounds)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive entries; row borders are the caller's."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    acc = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        acc = mixed(acc * np.uint64(0x100000001B3)) + hashes[j : len(hashes) - n + 1 + j]
    return mixed(acc)
