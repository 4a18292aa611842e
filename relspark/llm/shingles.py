"""Word n-grams of many texts as 64-bit hashes, computed with numpy on a whole text at a time."""

from __future__ import annotations

import hashlib

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xD6E8FEB86659FD93)
#: Inverse of P modulo 2^64, by which a word's hash is moved to position 0.
P_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64; the longest table so far is kept, up to a million entries."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 14)
        have = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
        if size <= 1 << 20:
            _powers[int(base)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word (run of anything but ASCII white space), in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(P, len(raw)), dtype=np.uint64)]
    return mixed((sums[ends] - sums[starts]) * powers(P_INVERSE, len(raw))[starts])


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct n-grams of words, as sorted hashes; a text of fewer words has one, of all its words; without words, none."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    k = min(n, len(words))
    grams = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        grams = grams * Q + words[i : len(words) - k + 1 + i]
    return np.unique(mixed(grams + np.uint64(k)))


def set_key(grams: np.ndarray) -> bytes:
    """16 bytes that stand for the set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
