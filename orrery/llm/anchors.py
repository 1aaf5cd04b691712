"""Anchors: every window of a sequence is stood for by the least of its sub-windows' hashes.

Equal windows have equal anchors at equal places inside, wherever they stand, so windows can only
repeat where anchors repeat; and neighbouring windows mostly share their anchor, so a text has some
fifty times fewer anchors than windows.  Windows that share one anchor are a run.
"""

from __future__ import annotations

import numpy as np

PLACE_BITS = 20  # of a packed minimum; longer sequences are taken in parts
MOST_WINDOWS = 4096  # that a run can have, and so the widest window in grams
PART = (1 << PLACE_BITS) - MOST_WINDOWS
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # multipliers of a 64-bit mixer
_S = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def byte_grams(data: np.ndarray) -> np.ndarray:
    """A hash of each 16 bytes of ``data`` (uint8)."""
    n = len(data) - 15
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    return mixed(words[:n] * _M1 ^ mixed(words[8: 8 + n]))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of ``data`` (uint8), by its length and its 8-byte parts."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    lengths = ends - starts
    out = lengths.astype(np.uint64) * _M2
    for at in range(0, int(lengths.max(initial=0)), 8):
        rest = np.flatnonzero(lengths > at) if at else np.arange(len(lengths))
        left = lengths[rest] - at
        part = words[starts[rest] + at]
        short = left < 8
        part[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[rest] = mixed(out[rest] ^ part)
    return out


def word_grams(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each ``words`` consecutive word hashes."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, words):
        out = out * _M1 + hashes[k: k + n]
    return mixed(out)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    span, n = 1, len(keys) - width + 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[:n], keys[width - span: width - span + n])


def runs(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each run of windows of ``width`` grams."""
    hashes, firsts, lasts = [], [], []
    place = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, len(grams) - width + 1, PART):
        part = grams[at: at + PART + width - 1]
        keys = (part & ~place) | np.arange(len(part), dtype=np.uint64)
        where = (_least(keys, width) & place).astype(np.int64)
        cuts = np.flatnonzero(where[1:] != where[:-1]) + 1
        first = np.concatenate(([0], cuts))
        hashes.append(part[where[first]])
        firsts.append(at + first)
        lasts.append(at + np.concatenate((cuts, [len(where)])) - 1)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes).view(np.int64), np.concatenate(firsts), np.concatenate(lasts)
