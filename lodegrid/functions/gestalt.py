"""The gestalt ratio (Ratcliff and Obershelp) of many pairs of short texts at once.

Twice the matched characters by the sum of the lengths. Matched is the longest common run, the one that begins first in the
left text and then in the right one if several are longest, and so on to its left and to its right. All pairs go through the same steps together: open
segments of all of them are compared in one table a round.
"""

from __future__ import annotations

import difflib

import numpy as np

#: From this length of the right text on the usual measure leaves out frequent characters; such pairs are given to it one by one.
LONG = 200
#: Pairs that are worked on together.
TOGETHER = 512


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    out = np.zeros(len(left))
    short = [k for k, (a, b) in enumerate(zip(left, right, strict=True)) if len(b) < LONG]
    for k in set(range(len(left))) - set(short):
        out[k] = difflib.SequenceMatcher(None, left[k], right[k]).ratio()
    short.sort(key=lambda k: len(left[k]) * len(right[k]))  # texts of like sizes together
    for at in range(0, len(short), TOGETHER):
        part = short[at : at + TOGETHER]
        a, b = [left[k] for k in part], [right[k] for k in part]
        sizes = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
        out[part] = np.where(sizes > 0, 2 * _matched(a, b) / np.maximum(sizes, 1), 1.0)
    return out


def _padded(texts: list[str], fill: int) -> np.ndarray:
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    out = np.full((len(texts), max(map(len, codes), default=0) + 1), fill, dtype=np.uint32)
    for k, c in enumerate(codes):
        out[k, : len(c)] = c
    return out


def _matched(left: list[str], right: list[str]) -> np.ndarray:
    a, b = _padded(left, 0x110000), _padded(right, 0x110001)
    total = np.zeros(len(left), dtype=np.int64)
    open_ = np.array([[k, 0, len(x), 0, len(y)] for k, (x, y) in enumerate(zip(left, right, strict=True)) if x and y], dtype=np.int64).reshape(-1, 5)
    while len(open_):
        pair, a0, a1, b0, b1 = open_.T
        size, i, j = _longest(a, b, pair, a0, a1, b0, b1)
        np.add.at(total, pair, size)
        before = np.stack([pair, a0, i, b0, j], axis=1)
        after = np.stack([pair, i + size, a1, j + size, b1], axis=1)
        open_ = np.concatenate([before, after])[np.tile(size > 0, 2)]
        open_ = open_[(open_[:, 1] < open_[:, 2]) & (open_[:, 3] < open_[:, 4])]
    return total


def _longest(a: np.ndarray, b: np.ndarray, pair: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest common run of each segment: (size, place in the left text, place in the right one)."""
    width = int((b1 - b0).max())
    at = b0[:, None] + np.arange(width)
    segment = np.where(at < b1[:, None], b[pair[:, None], np.minimum(at, b.shape[1] - 1)], 0x110001)
    run = np.zeros((len(pair), width + 1), dtype=np.int16)
    size, i, j = (np.zeros(len(pair), dtype=np.int64) for _ in range(3))
    for k in range(int((a1 - a0).max())):
        char = np.where(a0 + k < a1, a[pair, np.minimum(a0 + k, a.shape[1] - 1)], 0x110000)
        run[:, 1:] = np.where(segment == char[:, None], run[:, :-1] + 1, 0)
        end = run.argmax(axis=1)
        found = run[np.arange(len(pair)), end].astype(np.int64)
        longer = found > size
        size[longer] = found[longer]
        i[longer] = (a0 + k + 1)[longer] - found[longer]
        j[longer] = (b0 + end)[longer] - found[longer]
    return size, i, j
