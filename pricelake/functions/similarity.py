"""The sequence ratio of many pairs of short texts at once."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np

#: Longest texts and most pairs that are measured together; difflib measures longer ones one by one.
SHORT, TOGETHER = 64, 4096


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a text, and lengths."""
    lengths = np.fromiter(map(len, texts), np.int32, len(texts))
    out = np.zeros((len(texts), int(lengths.max(initial=0))), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def _cut(codes: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, outside: int) -> np.ndarray:
    """The ranges of rows, each from its own start; what lies beyond a range gets a code that no text has."""
    at = start[:, None] + np.arange(int((end - start).max()))
    inside = at < end[:, None]
    return np.where(inside, codes[row[:, None], np.where(inside, at, 0)], np.uint32(outside))


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and size of the longest common run of each row; the first in a, then the first in b."""
    n, width = b.shape
    size, i0, j0 = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    run = np.zeros((n, width + 1), np.int8)
    for i in range(a.shape[1]):
        grown = np.zeros_like(run)
        # A run that ends here is one longer than the one that ended before both places.
        np.multiply(run[:, :-1] + 1, b == a[:, i : i + 1], out=grown[:, 1:])
        run = grown
        top = run.max(axis=1)
        better = np.flatnonzero(top > size)
        if len(better):
            size[better] = top[better]
            i0[better] = i + 1 - size[better]
            j0[better] = run[better].argmax(axis=1) - size[better]
    return i0, j0, size


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in the longest common run and, to both sides of it, in the longest ones there."""
    (x, n), (y, m) = _codes(a), _codes(b)
    total = np.zeros(len(a), np.int64)
    row, a0, a1, b0, b1 = np.arange(len(a)), np.zeros_like(n), n, np.zeros_like(m), m
    while len(row):
        i, j, size = _longest(_cut(x, row, a0, a1, 0xFFFFFFFF), _cut(y, row, b0, b1, 0xFFFFFFFE))
        np.add.at(total, row, size)
        i, j = i + a0, j + b0
        hit = size > 0
        left = hit & (a0 < i) & (b0 < j)
        right = hit & (i + size < a1) & (j + size < b1)
        row, a0, a1, b0, b1 = (
            np.concatenate([row[left], row[right]]), np.concatenate([a0[left], (i + size)[right]]), np.concatenate([i[left], a1[right]]),
            np.concatenate([b0[left], (j + size)[right]]), np.concatenate([j[left], b1[right]]),
        )
    return total


def ratios(a: Sequence[str | None], b: Sequence[str | None]) -> list[float | None]:
    """Twice the matching characters over all characters of each pair, by longest matching blocks."""
    out: list[float | None] = [None] * len(a)
    short = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        if x == y:
            out[k] = 1.0
        elif not x or not y:
            out[k] = 0.0
        elif max(len(x), len(y)) <= SHORT:
            short.append(k)
        else:
            out[k] = difflib.SequenceMatcher(None, x, y).ratio()
    for at in range(0, len(short), TOGETHER):
        part = short[at : at + TOGETHER]
        first, second = [a[k] for k in part], [b[k] for k in part]
        for k, x, y, total in zip(part, first, second, _matched(first, second).tolist(), strict=True):
            out[k] = 2.0 * total / (len(x) + len(y))
    return out
