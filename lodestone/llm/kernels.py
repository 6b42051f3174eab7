"""Numpy over the bytes of many documents at once: words, their hashes, hashes of every window of bytes."""

import numpy as np

from lodestone.llm.common import ships

ships(__name__)

R = 0x9E3779B97F4A7C15
R_INV = pow(R, -1, 1 << 64)

#: Word bytes in lower case, 0 for the others: digits, letters, and all bytes of characters beyond ASCII.
WORD = np.zeros(256, np.uint8)
WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD[0x80:] = np.arange(0x80, 0x100)

#: Bytes whose prefix sums are held at once: a very long text takes little more memory than a short one.
PIECE = 4 << 20

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 23:  # kept for the next slice, unless one long document asked for it
            _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefixes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * R ** i; any substring's polynomial hash follows from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(R, len(data)), out=out[1:])
    return out


def word_places(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of lower-cased data; words end with their document."""
    is_word = low != 0
    starts, ends = is_word.copy(), is_word.copy()
    starts[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(low))]
    starts[edge] = is_word[edge]
    ends[edge - 1] = is_word[edge - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def pieces(low: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Runs of whole words over about PIECE bytes each: (first word, end word, first byte, end byte)."""
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + PIECE, "right")))
        yield i, j, int(s[i]), int(e[j - 1])
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and the index of each document's first word (with an end)."""
    low = WORD[data]
    s, e = word_places(low, offs)
    h = np.empty(len(s), np.uint64)
    for i, j, a, b in pieces(low, s, e):
        p, at, to = prefixes(low[a:b]), s[i:j] - a, e[i:j] - a
        h[i:j] = mixed((p[to] - p[at]) * powers(R_INV, b - a + 1)[at] + (to - at).astype(np.uint64))
    return h, np.searchsorted(s, offs)


def lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 + the index of each hash in the sorted keys, or 0."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, at + 1, 0)


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi), and which range each is of."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo), dtype=np.int32), n)
    return np.arange(len(which)) + (lo - (np.cumsum(n) - n))[which], which
