"""Vectorised word hashing over UTF-8 buffers; no Python object is made for a word.

A word is a maximal run of bytes of one class within one text. Its hash is a polynomial over
random byte weights modulo 2**64, shifted to position 0 and mixed; equal words have equal hashes
in every task. Different words share one with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import functools

import numpy as np

_R = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


WINDOW = 1 << 16  # bytes whose powers are kept
SPAN = 1 << 20  # bytes of a batch that are hashed at once


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to WINDOW."""
    inverse = pow(_R, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(WINDOW, base, np.uint64))]) for base in (_R, inverse))


def prefix_hashes(weights: np.ndarray) -> np.ndarray:
    """Sums of weights[i] * base**i up to each place; n + 1 numbers."""
    up, _ = _powers()
    total = np.empty(len(weights) + 1, np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        for lo in range(0, len(weights), WINDOW):
            part = weights[lo : lo + WINDOW]
            np.cumsum(part * up[: len(part)] * np.uint64(pow(_R, lo, 1 << 64)), out=total[lo + 1 : lo + 1 + len(part)])
            total[lo + 1 : lo + 1 + len(part)] += total[lo]
    return total


def range_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over start..end-1, shifted to place 0: equal strings, equal numbers."""
    _, down = _powers()
    far = pow(pow(_R, -1, 1 << 64), WINDOW, 1 << 64)
    blocks = np.array([pow(far, k, 1 << 64) for k in range(len(total) // WINDOW + 1)], np.uint64)
    with np.errstate(over="ignore"):
        return (total[end] - total[start]) * down[start % WINDOW] * blocks[start // WINDOW]


@functools.lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += np.uint64(32)  # A-Z count as a-z
    return mix(fold + np.uint64(0x1234567))


def space_class() -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    out = np.ones(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = False
    return out


def alnum_class() -> np.ndarray:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of text whose A-Z were made a-z."""
    out = np.zeros(256, bool)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    return out


def hashed_words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Hash of every word, and the index of the first word of each text (n + 1 numbers).

    Bytes are hashed SPAN by SPAN, so a very long text takes no more than its words' hashes beside it."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    bounds = offsets[1:-1]
    hashes, places = [], []
    carry, since = None, 0  # hash so far of a word that the last span left open, and its length
    for lo in range(0, n, SPAN):
        part = raw[lo : lo + SPAN]
        ok = inside[part]
        cut = np.zeros(len(part) + 1, bool)  # a text begins here
        cut[bounds[(bounds >= lo) & (bounds < lo + len(part))] - lo] = True
        start = ok.copy()
        start[1:] &= ~ok[:-1] | cut[1:-1]
        end = ok.copy()
        end[:-1] &= ~ok[1:] | cut[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(end)
        h = range_hashes(prefix_hashes(_weights()[part]), s, e + 1)
        s, size = s + lo, e + 1 - s
        goes_on = bool(len(s)) and lo + len(part) < n and ok[-1] and inside[raw[lo + len(part)]] and not (bounds == lo + len(part)).any()
        if carry is not None:  # its first run goes on with that word
            with np.errstate(over="ignore"):
                h[0] = carry + h[0] * np.uint64(pow(_R, since, 1 << 64))
            s[0], size[0] = lo - since, size[0] + since
        carry = None
        if goes_on:
            carry, since = h[-1], int(size[-1])
            h, s = h[:-1], s[:-1]
        hashes.append(mix(h))
        places.append(s)
    s = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(s, offsets)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashed_words(raw, np.array([0, len(raw)]), np.ones(256, bool))[0][0])


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words in order of place; a shorter text gives its whole sequence as one."""
    n = len(h)
    if n == 0:
        return h
    k, whole = (k, 0) if n >= k else (n, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(whole + 1), np.uint64)
        for i in range(k):
            out = out * np.uint64(_R) + h[i : n - k + 1 + i]
        return mix(out)
