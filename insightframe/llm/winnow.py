"""Content-chosen anchors of fixed-length byte strings (winnowing), vectorised with numpy.

Every ``length``-byte string owns one anchor: the leftmost smallest hash among its GRAM-byte
grams. The choice looks at the string's bytes only, so equal strings own equal anchors at equal
places, wherever they stand. Consecutive strings mostly share an anchor and form one run.
"""
from __future__ import annotations

import numpy as np

from .common import mix64

GRAM = 32
_SYMBOL = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = [pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64) for i in range(20)]
PIECE = 1 << 16  # start positions worked on at once; bounds the arrays
_BASE = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])


_POWERS = _powers(_BASE, PIECE + 1024), _powers(pow(_BASE, -1, 1 << 64), PIECE + 1024)


def rolling(raw: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every length-byte string of ``raw`` (length at least 1)."""
    out, done, acc = _SYMBOL[raw], 1, None
    covered, rest = 0, length
    while rest:
        if rest & 1:
            if acc is None:
                acc, covered = out, done
            else:
                n = len(out) - covered
                shift = np.uint64(pow(0x9E3779B97F4A7C15, done, 1 << 64))
                acc = acc[:n] * shift + out[covered:covered + n]
                covered += done
        rest >>= 1
        if rest:
            out = out[:-done] * np.uint64(pow(0x9E3779B97F4A7C15, done, 1 << 64)) + out[done:]
            done *= 2
    return acc[:len(raw) - length + 1]


def runs(raw: np.ndarray, off: np.ndarray, length: int):
    """Runs of string starts that own the same anchor occurrence, in every document.

    Yields arrays (start, count, anchor hash, digest) per piece of ``raw``; start is an index
    into ``raw``. The digest covers the bytes of all strings of the run and the anchor's place,
    so runs of equal digest hold equal strings. Runs are cut at documents and at pieces.
    """
    width = length - GRAM + 1
    total = len(raw)
    ends = off[1:]
    for lo in range(0, max(0, total - length + 1), PIECE):
        part = raw[lo:min(total, lo + PIECE + length - 1)]
        gram = mix64(rolling(part, GRAM))
        key = (gram & ~np.uint64((1 << 20) - 1)) | np.arange(len(gram), dtype=np.uint64)
        least, done = key, 1
        while done * 2 <= width:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        n = len(part) - length + 1
        least = np.minimum(least[:n], least[width - done:width - done + n])
        owner = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        change = np.ones(n, bool)
        change[1:] = owner[1:] != owner[:-1]
        # strings may neither start in one document and end in another
        here = ends[np.searchsorted(ends, lo):np.searchsorted(ends, lo + n + length, side="right")] - lo
        here = np.concatenate([here, here - length + 1])
        change[here[(here > 0) & (here < n)]] = True
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, n))
        keep = lo + first + length <= ends[np.searchsorted(ends, lo + first, side="right")]
        first, count = first[keep], count[keep]
        if not len(first):
            continue
        anchor = gram[owner[first]]
        yield lo + first, count, anchor, _digest(part, first, count + length - 1, owner[first] - first)


def _digest(part: np.ndarray, first: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of part[first:first+size) from prefix sums of a polynomial; odd base, so invertible."""
    power, inverse = _POWERS
    prefix = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_SYMBOL[part] * power[:len(part)], out=prefix[1:])
    value = (prefix[first + size] - prefix[first]) * inverse[first]
    return mix64(value + mix64((size * 4096 + place).astype(np.uint64)))
