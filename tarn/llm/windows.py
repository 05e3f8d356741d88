"""Hashes of all windows of a sequence by doubling, and a choice of windows that equal stretches make alike."""

from __future__ import annotations

import numpy as np

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_POWERS = np.cumprod(np.full(1 << 16, 0x5851F42D4C957F2D, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    return (x ^ (x >> np.uint64(29))) * _ODD[2]


def word_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words of `data`, which single spaces separate, and where each starts."""
    if not data:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(b == 32) + 1))
    sizes = np.diff(np.append(starts, len(b) + 1))
    at = np.arange(len(b)) - np.repeat(starts, sizes)[: len(b)]
    far = at >> 16
    power = _POWERS[at & 0xFFFF]
    if far.any():
        power = power + far.astype(np.uint64) * _ODD[3]
    terms = (b.astype(np.uint64) + np.uint64(1)) * power
    terms[starts[1:] - 1] = 0  # the spaces
    return mixed(np.add.reduceat(terms, starts) + sizes.astype(np.uint64)), starts


def window_hashes(ids: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of `size` ids: hashes of runs of 1, 2, 4, ... are joined into it."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    double, out, done, length = mixed(ids + _ODD[seed]), None, 0, 1
    while True:
        if size & length:
            part = double[done : done + n]
            out = part if out is None else mixed(out * _ODD[3] + part)
            done += length
        if done == size:
            return out
        double = mixed(double[:-length] * _ODD[0] + double[length:])
        length *= 2


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of `width`."""
    length = 1
    while 2 * length <= width:
        x = pick(x[:-length], x[length:])
        length *= 2
    rest = width - length
    return pick(x[:-rest], x[rest:]) if rest else x


def chosen(hashes: np.ndarray, width: int, least: np.ndarray | None = None) -> np.ndarray:
    """Places whose hash is the smallest in some run of `width`: every run has one, and equal runs have the same.

    `least` is each run's smallest, where the caller has it.
    """
    if len(hashes) < width:
        return np.empty(0, np.int64)
    if least is None:
        least = slide(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(slide(np.concatenate((edge, least, edge)), width, np.maximum) == hashes)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places are in a window of `size` that starts at one of `starts`."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, n), -1)
    return np.cumsum(steps[:n]) > 0


def byte_window_hashes(data: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` bytes; size is 8 times a power of two."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    double, length = mixed(words + _ODD[0]), 8
    while length < size:
        double = mixed(double[:-length] * _ODD[0] + double[length:])
        length *= 2
    return double
