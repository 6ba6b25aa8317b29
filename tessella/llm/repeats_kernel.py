"""Hashes of byte windows, in numpy, for the suffix passes of ``suffix_dedup``."""

from __future__ import annotations

import numpy as np

from tessella.llm._shared import mix64

#: Bytes of a digit: the stretch whose hash chooses a window's anchor.
DIGIT = 24
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What the bytes start from, in each family of hashes.
_BYTES = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches; not linear, so that repetitive texts do not cancel out."""
    x = left * _A
    x ^= x >> np.uint64(29)
    x += right
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def window_hashes(data: np.ndarray, sizes: tuple[int, ...], family: int = 0) -> list[np.ndarray]:
    """For each size, the hash of the window of that many bytes at every place where one begins.

    Stretches of doubling lengths are built from halves; a size that is no
    power of two is covered by two overlapping stretches.  Hashes of the two
    families are independent.
    """
    out, level, h = {}, 1, _BYTES[family][data]
    for size in sorted(sizes):
        while level * 2 <= size:
            h = _join(h[: max(0, len(h) - level)], h[level:])
            level *= 2
        n = max(0, len(data) - size + 1)
        out[size] = h[:n] if size == level else _join(h[:n], h[size - level : size - level + n] ^ np.uint64(size))
    return [out[s] for s in sizes]


def anchors(digits: np.ndarray, window: int, digit: int = DIGIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of every window: the leftmost least digit hash inside it.

    Returns the anchors' places and the first and last window start of each;
    windows of one anchor are neighbours.  Equal windows have their anchor at
    the same distance, since it depends on their own bytes alone.
    """
    span = window - digit + 1
    n = len(digits) - span + 1
    if n <= 0:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    least, place, level = digits, np.arange(len(digits), dtype=np.int32 if len(digits) < 1 << 31 else np.int64), 1
    while level < span:
        # The last step may overlap the one before; ties go to the left either way.
        step = min(level, span - level)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        level += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return place[first].astype(np.int64), first, last
